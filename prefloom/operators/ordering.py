"""Order statistics that no single task holds: prefix sums, exact selections, and inversion counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..sources.shared import cut

#: bits of a key, bits that one refinement looks at, rows of a bucket that are ranked at once, entries of a block
KEY_BITS, STEP_BITS, RANKED, BLOCK = 60, 12, 1 << 16, 1 << 17


def sums_before(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before, in the order of ``by`` (distinct, nulls first).

    Rows are dealt to ranges and written, so that a row's range holds whatever is computed again; a prefix sum over
    the ranges' totals (a row a range) and one within each range add up to the result.
    """
    rows = cut(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    ranges = rows.groupBy("_range").agg(F.sum(value).alias("_total"))
    earlier = F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    starts = ranges.select("_range", F.coalesce(earlier, F.lit(0)).alias("_start"))
    within = F.sum(value).over(Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    found = rows.withColumn(out, F.coalesce(within, F.lit(0))).join(starts, "_range")
    return found.withColumn(out, F.col(out) + F.col("_start")).drop("_range", "_start")


def key_of(seed: int, *columns: str) -> Column:
    """60 bits of a hash of a seed and columns."""
    return hashing.bits(KEY_BITS // 4, seed, *columns)


def least(df: DataFrame, by: list[str], key: str, ties: list[str], want: DataFrame, ranked: int = RANKED) -> DataFrame:
    """Adds ``taken``: whether a row is among the ``want`` (by, k) first of its group, by key (60 bits), then ``ties``.

    The key of the k-th row is found by histograms: 4,096 buckets a group, then as many within the bucket that
    holds it, until that bucket is small; only its rows are ranked.  So no group is ever gathered or sorted, however
    large.  Rows that agree in key and ties are told apart arbitrarily.
    """
    shift = lambda bits: F.shiftright(key, KEY_BITS - bits)
    zero = F.lit(0).cast("long")
    at = cut(want.select(*by, F.col("k").cast("long").alias("_k"), zero.alias("_at"), zero.alias("_before")))
    bits, n = 0, None
    while bits < KEY_BITS and (n is None or n > ranked):
        inside = df.select(*by, key).join(at, by).where(shift(bits) == F.col("_at"))
        bits += STEP_BITS
        counts = inside.groupBy(*by, shift(bits).alias("_at"), "_k", F.col("_before").alias("_base")).agg(F.count("*").alias("_n"))
        ordered = Window.partitionBy(*by).orderBy("_at")  # 4,096 rows a group at most
        upto = counts.withColumn("_upto", F.col("_base") + F.sum("_n").over(ordered)).withColumn("_last", F.row_number().over(ordered.orderBy(F.desc("_at"))))
        holds = upto.where((F.col("_upto") >= F.col("_k")) | (F.col("_last") == 1)).withColumn("_first", F.row_number().over(ordered)).where("_first = 1")
        at = cut(holds.select(*by, "_k", "_at", (F.col("_upto") - F.col("_n")).alias("_before"), "_n"))
        n = at.agg(F.max("_n")).first()[0] or 0
    placed = df.join(at.drop("_n"), by, "left").withColumn("_bucket", shift(bits))
    near = placed.where("_bucket = _at")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(key, *ties))
    near = near.withColumn("taken", F.col("_before") + rank <= F.col("_k"))
    rest = placed.where("_at is null or _bucket <> _at").withColumn("taken", F.coalesce(F.col("_bucket") < F.col("_at"), F.lit(False)))
    return near.unionByName(rest).drop("_bucket", "_at", "_before", "_k")


def whole_groups(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[tuple]:
    """(keys as Arrow, group of each entry, further columns as numpy) of whole groups; input comes sorted by its first column."""
    held: list[pa.RecordBatch] = []
    n = 0

    def of(table: pa.Table) -> tuple:
        keys = table.column(0).combine_chunks()
        new = np.concatenate([[True], _differs(keys)])
        return keys.take(pa.array(np.flatnonzero(new))), np.cumsum(new) - 1, *(c.to_numpy() for c in table.columns[1:])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= block:
            table = pa.Table.from_batches(held)
            starts = np.flatnonzero(_differs(table.column(0).combine_chunks())) + 1
            at = int(starts[-1]) if len(starts) else 0
            if at:
                yield of(table.slice(0, at))
                held, n = table.slice(at).combine_chunks().to_batches(), n - at
    if held:
        yield of(pa.Table.from_batches(held))


def _differs(keys: pa.Array) -> np.ndarray:
    """Whether each key but the first differs from the one before it; nulls are equal."""
    codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]


def earlier_larger(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each entry, how many entries before it in its group are larger; groups are ascending runs.

    A bit at a time, from the highest: among entries that agree in the bits above, those with a 0 have every 1 before
    them as a larger one.  n log n steps for all groups together.
    """
    _, rank = np.unique(value, return_inverse=True)
    out = np.zeros(len(value), np.int64)
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        order = np.lexsort((rank >> (bit + 1), group))  # stable, so entries of a class stay in their order
        one = (rank[order] >> bit) & 1
        head = np.concatenate([[True], (group[order][1:] != group[order][:-1]) | ((rank[order] >> (bit + 1))[1:] != (rank[order] >> (bit + 1))[:-1])])
        ones = np.cumsum(one)
        base = (ones - one)[np.flatnonzero(head)][np.cumsum(head) - 1]
        out[order] += np.where(one == 1, 0, ones - base)
    return out
