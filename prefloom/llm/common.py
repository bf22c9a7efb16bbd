"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, read by Spark (so that any store it can open will do)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a private one is set only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), f"prefloom-{uuid.uuid4().hex}")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has the driver's JVM collect, so that Spark deletes the shuffle files of plans that nothing refers to any more.

    Spark deletes them only when its references are collected, which on a quiet driver may be long after; a job of
    many steps would then hold the files of all of them at once.
    """
    spark._jvm.System.gc()


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) over uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, *salt: int) -> np.ndarray:
    """Reproducible uniforms in (0, 1) that depend on the keys and the salts alone."""
    x = key.astype(np.uint64)
    with np.errstate(over="ignore"):
        for s in salt:
            x = mix64(x + np.uint64((s * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


class WordHash(dict):
    """Word (bytes) to a 64-bit hash, remembered; the memory is emptied when it holds ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (order matters); empty when there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = (out + hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return mix64(out)


#: edges that one task contracts in memory
MANY = 1 << 20


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the components of all the edges that a task is given; a root is the least node it knows of."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    kind = held[0].schema.field(0).type
    u, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(2))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (root[u] != root[v]).any():
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(nodes[root], kind)], ["node", "root"])


def connected(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60, many: int = MANY) -> DataFrame:
    """Connected components of an undirected edge list by alternating large-star and small-star steps.

    Tasks first contract the edges they hold, ``many`` of them at most, to one edge a node; where one task holds all
    edges, that is the result.  Returns (node, root) for every node that has an edge to another node; root is the
    smallest node of its component.  Nulls and loops are ignored; repeated edges do no harm; no edges give no rows.  A
    hub is only ever met as a join key: least neighbours are written before they are joined, so that both sides of the
    join come from shuffles of their own and adaptive execution can split the hub's rows.
    """
    spark = edges.sparkSession
    e = cut(
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    )
    kind = e.schema["u"].dataType
    out = f"node {kind.simpleString()}, root {kind.simpleString()}"
    n = e.count()
    if n == 0:
        return spark.createDataFrame([], out)
    if n <= many:
        return e.coalesce(1).mapInArrow(contract, out)
    e = cut(e.repartition(n // max(1, many) + 1).mapInArrow(contract, out).where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).distinct())
    state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u")
        e = cut(
            small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def component_ids(points: DataFrame, edges: DataFrame, node: str, least: str) -> DataFrame:
    """(node, component_id): the least value of ``least`` in the component of each point (points are distinct by ``node``).

    Only linked points meet by root, and what they meet there is written first, so that a component that holds a
    large share of all points is split rather than met in one task; nor does one node's row share its stage.
    """
    linked = cut(connected(edges).withColumnRenamed("node", node).join(points.select(node, F.col(least).alias("component_id")), node))
    low = cut(linked.groupBy("root").agg(F.min("component_id").alias("component_id")))
    named = cut(linked.select(node, "root").join(low, "root").select(node, "component_id", F.lit(True).alias("linked")))
    rest = points.select(node, F.col(least).alias("own")).join(named, node, "left")
    return cut(rest.select(node, F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("own")).alias("component_id")))
