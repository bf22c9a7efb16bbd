"""Draws of Bayesian mixtures: a table (chain, draw, component, item, value) written as the chain runs.

A weight is a row without an item.  The table is partitioned by chain and by the draw at which a part begins; a part
counts once it is committed, and a chain that is taken up again goes on after the last draw of its committed parts.
Summaries, matching of components and R-hat are DataFrame operations over it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import solvers

SCHEMA = "chain int, draw int, component int, item int, value double"


class Store:
    """Draws in the folder ``at`` (or, without one, on the driver: components x items numbers a draw)."""

    def __init__(self, spark: SparkSession, at: str | None = None, every: int = 50):
        self.spark, self.at, self.every = spark, at.rstrip("/") if at else None, every
        self.held: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def add(self, chain: int, draw: int, u: np.ndarray, w: np.ndarray) -> None:
        self.held.append((chain, draw, u, w))
        if self.at and len(self.held) >= self.every:
            self.flush()

    def flush(self) -> None:
        """Writes what is held as one part."""
        if self.at and self.held:
            chain, first = self.held[0][:2]
            self._frame().drop("chain").coalesce(1).write.mode("overwrite").parquet(f"{self.at}/chain={chain}/part={first}")
            self.held = []

    def _frame(self) -> DataFrame:
        rows = [(c, t, k, None, float(x)) for c, t, _, w in self.held for k, x in enumerate(w)]
        rows += [(c, t, k, i, float(x)) for c, t, u, _ in self.held for k, row in enumerate(u) for i, x in enumerate(row)]
        return self.spark.createDataFrame(rows, SCHEMA)

    def _parts(self, chain: int | None = None) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/chain={'*' if chain is None else chain}/part=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return [x.getPath().getParent().toString() for x in found]

    def read(self) -> DataFrame:
        """(chain, draw, component, item, value)."""
        if not self.at:
            return self._frame()
        if not (parts := self._parts()):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(f"{SCHEMA}, part int").option("basePath", self.at).parquet(*parts).select("chain", "draw", "component", "item", "value")

    def last(self, chain: int) -> tuple[int, tuple[np.ndarray, np.ndarray] | None]:
        """(draws kept, the last of them)."""
        if not self.at or not self._parts(chain):
            return 0, None
        own = self.read().where(F.col("chain") == chain)
        draw = own.agg(F.max("draw")).first()[0]
        return draw + 1, matrices(own.where(F.col("draw") == draw))

    def means(self, burn: int = 0, until: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Means of utilities and weights after the first ``burn`` draws; components of several chains are matched."""
        kept = self.read().where(F.col("draw") >= burn)
        kept = kept.where(F.col("draw") < until) if until is not None else kept
        if kept.select("chain").distinct().count() > 1:
            kept = relabel(kept)
        return matrices(kept.groupBy("component", "item").agg(F.avg("value").alias("value")))


def matrices(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(utilities, weights) of (component, item, value): components x items numbers."""
    found = rows.select("component", "item", "value").collect()
    k, n = max(r.component for r in found) + 1, max((r.item for r in found if r.item is not None), default=-1) + 1
    u, w = np.zeros((k, n)), np.zeros(k)
    for r in found:
        if r.item is None:
            w[r.component] = r.value
        else:
            u[r.component, r.item] = r.value
    return u, w


def relabel(draws: DataFrame, pivot: np.ndarray | None = None) -> DataFrame:
    """Draws whose components are renamed, a draw at a time, to lie nearest to those of ``pivot`` (components x items).

    Without a pivot, the last draw of the first chain is one.  A draw is components x items numbers.
    """
    if pivot is None:
        first = draws.agg(F.min("chain")).first()[0]
        own = draws.where(F.col("chain") == first)
        pivot, _ = matrices(own.where(F.col("draw") == own.agg(F.max("draw")).first()[0]))

    def match(one: pd.DataFrame) -> pd.DataFrame:
        u = one[one["item"].notna()].pivot(index="component", columns="item", values="value").to_numpy()
        cost = ((pivot[:, None, :] - u[None, :, :]) ** 2).sum(axis=2)
        _, matched = solvers.best_permutation(cost)  # the draw's component for each of the pivot's
        name = {int(c): k for k, c in enumerate(matched)}
        return one.assign(component=one["component"].map(name).astype("int32"))

    return draws.groupBy("chain", "draw").applyInPandas(match, SCHEMA)


def summary(draws: DataFrame) -> DataFrame:
    """(component, item, mean, sd, draws)."""
    return draws.groupBy("component", "item").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("draws"))


def r_hat(draws: DataFrame) -> DataFrame:
    """(component, item, r_hat): the scale by which more draws could still narrow a value; chains are split in halves."""
    middle = F.avg("draw").over(Window.partitionBy("chain", "component", "item"))
    half = draws.withColumn("half", (F.col("draw") > middle).cast("int"))
    each = half.groupBy("component", "item", "chain", "half").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    both = each.groupBy("component", "item").agg(F.avg("v").alias("within"), F.var_samp("m").alias("between"), F.avg("n").alias("n"))
    return both.select("component", "item", F.sqrt((F.col("n") - 1) / F.col("n") + F.col("between") / F.col("within")).alias("r_hat"))
