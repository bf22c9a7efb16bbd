"""Ranking embeddings, as sparse long tables (ranking_id, k, x); only non-zero entries are rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordering
from . import rankings as R


def pair_index(i: Column, j: Column, n: int) -> Column:
    """Place of the pair i < j in the flattened upper triangle."""
    return (n * i - F.floor(i * (i + 1) / 2) + (j - i - 1)).cast("int")


def pairwise(rankings: DataFrame, n: int, encoding: str = "signed") -> DataFrame:
    """signed: +1/2 if the smaller id wins, -1/2 if the larger does; binary: 1 if the smaller wins, else no row."""
    b = R.break_full(R.to_arrays(rankings))
    k = pair_index(F.least("winner", "loser"), F.greatest("winner", "loser"), n)
    first = F.col("winner") < F.col("loser")
    if encoding == "binary":
        return b.where(first).select("ranking_id", k.alias("k"), F.lit(1.0).alias("x"))
    if encoding != "signed":
        raise ValueError("encoding must be signed or binary")
    return b.select("ranking_id", k.alias("k"), F.when(first, 0.5).otherwise(-0.5).alias("x"))


def all_pairs(signed: DataFrame, n: int) -> DataFrame:
    """(ranking_id, i, j, x) antisymmetric, from the signed triangle."""
    ij = [(i, j) for i in range(n) for j in range(i + 1, n)]
    names = signed.sparkSession.createDataFrame([(k, i, j) for k, (i, j) in enumerate(ij)], "k int, i int, j int")  # n (n - 1) / 2 rows
    a = signed.join(names, "k").select("ranking_id", "i", "j", "x")
    return a.union(a.select("ranking_id", F.col("j"), F.col("i"), -F.col("x")))


def partial_pairwise(rankings: DataFrame, n: int) -> DataFrame:
    """Mean binary embedding over all completions of a partial ranking, in closed form.

    With s ranked items and position r: both ranked 0 or 1; only the smaller (s - r) / (s + 1); only the larger
    (r + 1) / (s + 1); neither 1/2.
    """
    a = R.to_arrays(rankings).select("ranking_id", "items", F.size("items").alias("s"))
    ids = F.sequence(F.lit(0), F.lit(n - 1))
    a = a.withColumn("p", F.transform(ids, lambda i: F.array_position("items", i).cast("int") - 1))
    x = a.select("ranking_id", "s", F.posexplode("p").alias("i", "ri"), "p").select("ranking_id", "s", "i", "ri", F.posexplode("p").alias("j", "rj")).where("i < j")
    both, only_i, only_j = (F.col("ri") >= 0) & (F.col("rj") >= 0), F.col("ri") >= 0, F.col("rj") >= 0
    v = F.when(both, (F.col("ri") < F.col("rj")).cast("double")).when(only_i, (F.col("s") - F.col("ri")) / (F.col("s") + 1)).when(only_j, (F.col("rj") + 1) / (F.col("s") + 1)).otherwise(0.5)
    return x.select("ranking_id", pair_index(F.col("i"), F.col("j"), n).alias("k"), v.alias("x"))


def lehmer(rankings: DataFrame) -> DataFrame:
    """For the item at place k: how many items of larger id come before it; n log n steps a ranking."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, row, item in ordering.whole_groups(batches):
            start = np.searchsorted(row, np.arange(len(ids)))
            place = np.arange(len(row)) - start[row]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(place, pa.int32()), pa.array(ordering.earlier_larger(row, item).astype(np.float64))], ["ranking_id", "k", "x"])

    r = rankings.select("ranking_id", "item_id", "pos").repartition("ranking_id").sortWithinPartitions("ranking_id", "pos", "item_id")
    kind = rankings.schema["ranking_id"].dataType.simpleString()
    return r.select("ranking_id", "item_id").mapInArrow(work, f"ranking_id {kind}, k int, x double")


def positional(rankings: DataFrame) -> DataFrame:
    """An item's position; unranked items, like the first, are 0 and have no row."""
    return rankings.where("pos > 0").select("ranking_id", F.col("item_id").alias("k"), F.col("pos").cast("double").alias("x"))


def top_k(rankings: DataFrame, k: int) -> DataFrame:
    return rankings.where(F.col("pos") < k).select("ranking_id", F.col("item_id").alias("k"), F.lit(1.0).alias("x"))


def disjoint_pairs(rankings: DataFrame, n: int) -> DataFrame:
    """For items 2a and 2a + 1: +1 if the even one comes first, -1 otherwise; none if neither is ranked."""
    d = rankings.where(F.col("item_id") < n - n % 2)
    g = d.groupBy("ranking_id", F.floor(F.col("item_id") / 2).cast("int").alias("k")).agg(F.min_by("item_id", "pos").alias("first"))
    return g.select("ranking_id", "k", F.when(F.col("first") % 2 == 0, 1.0).otherwise(-1.0).alias("x"))


def square(rankings: DataFrame, n: int) -> DataFrame:
    """n x n signed matrix, flattened: +1 at [loser, winner], -1 at [winner, loser]."""
    b = R.break_full(R.to_arrays(rankings)).select("ranking_id", "winner", "loser")
    w, l = F.col("winner"), F.col("loser")
    return b.select("ranking_id", F.explode(F.array(F.struct((l * n + w).alias("k"), F.lit(1.0).alias("x")), F.struct((w * n + l).alias("k"), F.lit(-1.0).alias("x")))).alias("e")).select("ranking_id", "e.k", "e.x")


def gram(embedding: DataFrame, size: int) -> np.ndarray:
    """X'X of the embedding, for few features: features x features on the driver (``lowrank`` does without it)."""
    g = embedding.groupBy("ranking_id").agg(F.collect_list(F.struct("k", "x")).alias("a"))
    pairs = g.select(F.explode("a").alias("u"), "a").select("u", F.explode("a").alias("v"))
    out = np.zeros((size, size))
    for r in pairs.groupBy(F.col("u.k").alias("i"), F.col("v.k").alias("j")).agg(F.sum(F.col("u.x") * F.col("v.x")).alias("s")).collect():
        out[r.i, r.j] = r.s
    return out
