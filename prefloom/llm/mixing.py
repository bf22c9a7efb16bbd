"""Operator 3, mixing sources to target weights.

Every document gets a hash-random key; within its source, documents are taken in key order until the
source's budget of words is spent, in as many epochs as the budget asks for.  The order is found by range
partitioning on the key's leading digits (keys are uniform, so fixed ranges are even ones, however hot a
source is), with prefix sums in two levels: over the ranges of a source, then inside one range.  The last
document is cut at the exact word.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; a source of
size 0, or an empty table, takes nothing; rows that share a doc_id are separate documents, equal keys are taken by
doc_id, size and text hash; texts of any length are counted whole; other columns are ignored by ``mix`` and pass
through ``materialise``.  No document is taken more than twice its size, as no target is above two times its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: hex digits of a key that name its range: 256 ranges a source for each two digits
RANGE_DIGITS = 3


def size_of(text: Column) -> Column:
    """Number of words: each, with the space around it, becomes one character (no list of words is made)."""
    marks = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x"))
    return F.coalesce(F.when(text.rlike(r"[^\x20\x09-\x0D]"), marks), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Targets share ``share`` of all words by weight; one above ``most`` times its source stops there, and the
    excess is shared again by weight.  With sources ordered by cap per weight this has a closed form: the
    first sources stop at their caps, and the rest split what is left.  One row a source, so windows are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    s = s.withColumn("left", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    # once a source's share of what is left is within its cap, the same holds for all later ones
    s = s.withColumn("free", F.col("w") * F.col("left") <= F.col("cap") * F.col("w_left"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source", "left", "w_left"))).over(everything)
    return s.select("source", "source_size", F.when(F.col("free"), F.col("w") * first["left"] / first["w_left"]).otherwise(F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and ``full`` and ``part``: whole epochs and words of the last."""
    from .common import cut

    d = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")).withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))))
    d = cut(d.withColumn("part_no", F.substring("key", 1, RANGE_DIGITS)))
    ranges = d.groupBy("source", "part_no").agg(F.sum("size").alias("words"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("source").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source", "part_no", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    plan = ranges.join(targets, ranges["source"].eqNullSafe(targets["source"])).select(ranges["source"], "part_no", "start", "source_size", "target")
    inside = Window.partitionBy("source", "part_no").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    j = d.join(plan, d["source"].eqNullSafe(plan["source"]) & (d["part_no"] == plan["part_no"])).select(
        "doc_id", d["source"], "size", "source_size", "target", "key", "text_hash", (F.col("start") + F.col("before")).alias("start")
    )
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    j = j.withColumn("full", whole).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("full") * F.col("source_size") - F.col("start"))).cast("long"))
    return j.withColumn("taken", F.col("full") * F.col("size") + F.col("part"))


def materialise(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: each document once an epoch with ``epoch`` (1 and up); the last epoch's text is cut at ``part`` words.

    ``plan`` is ``mix(docs)``.  Rows that are equal in doc_id, source and text are written as often as all of them are
    taken.  A cut text's words are joined by spaces; other texts stay as they are.
    """
    same = ("doc_id", "source", "text_hash")
    whole = F.sum(F.col("full") + F.when((F.col("part") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0))
    p = plan.groupBy(*same).agg(F.count("*").alias("times"), whole.alias("whole"), F.max(F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.col("part"))).alias("short"))
    p = p.where("whole > 0 or short is not null").select(F.struct(*same).alias("of"), "times", "whole", "short")
    cols = [c for c in docs.columns if c != "epoch"]
    d = docs.select(F.struct("doc_id", "source", F.xxhash64("text").alias("text_hash")).alias("at"), F.struct(*cols).alias("d"))
    agrees = lambda x: F.col("at").eqNullSafe(x["of"])
    once, more = p.where("times = 1"), p.where("times > 1")
    j = d.join(once, agrees(once)).unionByName(d.join(more, agrees(more), "left_semi").dropDuplicates(["at"]).join(more, agrees(more)))
    n = (F.col("whole") + F.when(F.col("short").isNotNull(), 1).otherwise(0)).cast("int")
    j = j.select("d", "whole", "short", F.explode(F.sequence(F.lit(1), n)).alias("epoch"))
    words = F.slice(F.regexp_extract_all("d.text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.coalesce("short", F.lit(1)).cast("int"))
    j = j.select("d", F.when(F.col("epoch") > F.col("whole"), F.array_join(words, " ")).otherwise(F.col("d.text")).alias("text"), "epoch")
    return j.select(*[(F.col("text") if c == "text" else F.col("d").getField(c)).alias(c) for c in cols], "epoch")
