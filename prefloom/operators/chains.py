"""Markov chains over items from pairwise statistics, and their stationary distributions.

Chains are coordinate tables (src, dst, p), a row-stochastic matrix with its diagonal; mass flows from loser
to winner, so stationary mass is strength.  ``scale`` tables hold the d that rows were divided by.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import solvers


def _finish(rates: DataFrame, scale: str, least: float = 0.0, plus: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Rows (src, dst, p) divided by d, with the diagonal that makes them add to 1; d is ``max`` of row sums, or each row's."""
    everything = Window.partitionBy()
    sums = rates.groupBy("src").agg(F.sum("p").alias("row"))
    d = F.greatest(F.col("row") + plus, F.lit(least))
    sums = sums.withColumn("d", F.max(d).over(everything) if scale == "max" else d)
    nodes = rates.select("src").union(rates.select("dst")).distinct()
    sums = nodes.join(sums, "src", "left").withColumn("row", F.coalesce("row", F.lit(0.0)))
    sums = sums.withColumn("d", F.coalesce("d", F.max("d").over(everything) if scale == "max" else F.lit(max(least, plus, 1e-300))))
    off = rates.join(sums.select("src", "d"), "src").select("src", "dst", (F.col("p") / F.col("d")).alias("p"))
    diagonal = sums.select("src", F.col("src").alias("dst"), (1 - F.col("row") / F.col("d")).alias("p"))
    return off.union(diagonal), sums.select(F.col("src").alias("item_id"), "d")


def rank_centrality(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chain, scale) from ``rankings.pairwise_matrix``: rates p from loser to winner over the largest row sum."""
    return _finish(pairs.select(F.col("loser").alias("src"), F.col("winner").alias("dst"), "p").where("src <> dst and p > 0"), "max")


def responses(df: DataFrame, lam: float = 1.0, accelerated: bool = True, same_d: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chain, scale) of binary responses: M_ij = users right on i and wrong on j, +lam where either way was seen.

    accelerated: d is the row sum, at least 1; otherwise the number of co-responses (own ones included) plus 1,
    or the largest of these (``same_d``).
    """
    m = co_counts(df, 1, 0).withColumnsRenamed({"i": "src", "j": "dst", "y": "p"})
    both = m.union(m.select("dst", "src", F.lit(0.0))).where("src <> dst").groupBy("src", "dst").agg((F.sum("p") + lam).alias("p"))
    if accelerated:
        return _finish(both, "row", least=1.0)
    b = co_responses(df).groupBy("i").agg((F.sum("b") + 1).alias("d")).select(F.col("i").alias("item_id"), F.col("d").cast("double").alias("d"))
    if same_d:
        b = b.withColumn("d", F.max("d").over(Window.partitionBy()))
    off = both.join(b, both["src"] == b["item_id"]).select("src", "dst", (F.col("p") / F.col("d")).alias("p"))
    rest = b.join(off.groupBy("src").agg(F.sum("p").alias("row")), F.col("item_id") == F.col("src"), "left")
    return off.union(rest.select("item_id", "item_id", 1 - F.coalesce("row", F.lit(0.0)))), b


def co_counts(df: DataFrame, k1: int, k2: int, weight: str | None = None, power: int = 2) -> DataFrame:
    """(i, j, y): over users with score k1 on i and k2 on j, the count, or the sum of weight^power.

    A user's scores are gathered once into a row (their number is bounded by the items), and pairs come from
    the row, so users are shuffled once and pairs are pre-aggregated.
    """
    w = F.first(weight) if weight else F.lit(1.0)
    g = df.groupBy("user_id").agg(F.collect_list(F.when(F.col("score") == k1, F.col("item_id"))).alias("a"), F.collect_list(F.when(F.col("score") == k2, F.col("item_id"))).alias("b"), w.alias("w"))
    x = g.select(F.explode("a").alias("i"), "b", "w").select("i", F.explode("b").alias("j"), "w")
    return x.groupBy("i", "j").agg(F.sum(F.pow("w", F.lit(power))).alias("y"))


def co_responses(df: DataFrame) -> DataFrame:
    """(i, j, b): users who answered both, i = j included."""
    g = df.groupBy("user_id").agg(F.collect_list("item_id").alias("a"))
    return g.select(F.explode("a").alias("i"), "a").select("i", F.explode("a").alias("j")).groupBy("i", "j").agg(F.count("*").alias("b"))


def graded(y: DataFrame, lam: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(chain, scale) of one level's co-occurrence (i, j, y): +lam on seen pairs, d the row sum, at least 1."""
    m = y.where("i <> j").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("y").alias("p"))
    both = m.union(m.select("dst", "src", F.lit(0.0))).groupBy("src", "dst").agg((F.sum("p") + lam).alias("p"))
    return _finish(both, "row", least=1.0)


def to_dense(chain: DataFrame, scale: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The chain and d on the driver: n x n cells; items without any row keep all their mass."""
    m, d = np.zeros((n, n)), np.ones(n)
    for r in chain.collect():
        m[r["src"], r["dst"]] += r["p"]
    for r in scale.collect():
        d[r["item_id"]] = r["d"]
    for i in np.flatnonzero(m.sum(axis=1) == 0):
        m[i, i] = 1.0
    return m, d


def power_iteration(chain: DataFrame, steps: int, start: DataFrame | None = None, every: int = 8) -> DataFrame:
    """(item_id, pi) after ``steps`` steps on DataFrames, for item sets beyond the driver; lineage is cut now and then."""
    items = chain.select(F.col("src").alias("item_id")).distinct()
    pi = items.withColumn("pi", F.lit(1.0) / F.count("*").over(Window.partitionBy())) if start is None else start
    for k in range(1, steps + 1):
        pi = chain.join(pi, chain["src"] == pi["item_id"]).groupBy("dst").agg(F.sum(F.col("p") * F.col("pi")).alias("pi")).withColumnRenamed("dst", "item_id")
        if k % every == 0 and chain.sparkSession.sparkContext.getCheckpointDir():
            pi = pi.checkpoint()
    return pi


def scores(chain: DataFrame, scale: DataFrame, n: int, method: str = "solve", iters: int = 10_000, eps: float = 1e-6, log: bool = True) -> np.ndarray:
    """Stationary mass over d, normalised; its centred logarithm unless ``log`` is off."""
    m, d = to_dense(chain, scale, n)
    pi = solvers.stationary(m) if method == "solve" else solvers.power(m, iters=iters, eps=eps)[0]
    pi = pi / d
    pi = pi / pi.sum()
    return solvers.centred(np.log(np.maximum(pi, 1e-300))) if log else pi
