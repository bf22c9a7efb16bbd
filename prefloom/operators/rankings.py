"""Rankings to comparisons and pairwise statistics.

A ranking is held either long, (ranking_id, pos, item_id [, weight]), or as one row with an array of items,
best first.  Breaking works inside a row, so it needs no join and no shuffle; counting is one pre-aggregated
shuffle of at most items x items rows a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..schemas import require


def to_arrays(rankings: DataFrame) -> DataFrame:
    """(ranking_id, items, weight): one row a ranking; the weight is 1 where there is none."""
    require(rankings, ("ranking_id", "pos", "item_id"))
    w = F.first("weight", ignorenulls=True) if "weight" in rankings.columns else F.lit(1.0)
    sort = F.sort_array(F.collect_list(F.struct("pos", "item_id")))
    return rankings.groupBy("ranking_id").agg(F.transform(sort, lambda x: x["item_id"]).alias("items"), F.coalesce(w, F.lit(1.0)).cast("double").alias("weight"))


def to_long(arrays: DataFrame) -> DataFrame:
    return arrays.select("ranking_id", F.posexplode("items").alias("pos", "item_id"), "weight")


def collapse(arrays: DataFrame) -> DataFrame:
    """Equal rankings as one, with their weights added: few item orders repeat often in short rankings."""
    return arrays.groupBy("items").agg(F.sum("weight").alias("weight")).withColumn("ranking_id", F.xxhash64("items"))


def break_full(arrays: DataFrame) -> DataFrame:
    """(ranking_id, winner, loser, weight, pos): every ordered pair of every ranking."""
    a = arrays.select("ranking_id", "weight", "items", F.posexplode("items").alias("pos", "winner"))
    rest = F.slice("items", F.col("pos") + 2, F.greatest(F.size("items") - F.col("pos") - 1, F.lit(0)))
    return a.select("ranking_id", "winner", F.explode(rest).alias("loser"), "weight", "pos")


def break_random(arrays: DataFrame, seed: int = 0) -> DataFrame:
    """Disjoint random pairs of each ranking; with an odd number of items one sits out."""
    keyed = F.transform("items", lambda x, i: F.struct(hashing.bits(15, seed, "ranking_id", x).alias("h"), i.alias("pos"), x.alias("item")))
    s = F.sort_array(keyed)
    pair = lambda k: F.struct(F.get(s, k * 2).alias("a"), F.get(s, k * 2 + 1).alias("b"))
    n = F.floor(F.size("items") / 2).cast("int")
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), pair))
    x = arrays.select("ranking_id", "weight", F.explode(pairs).alias("x"))
    first = F.col("x.a.pos") < F.col("x.b.pos")
    return x.select("ranking_id", F.when(first, F.col("x.a.item")).otherwise(F.col("x.b.item")).alias("winner"), F.when(first, F.col("x.b.item")).otherwise(F.col("x.a.item")).alias("loser"), "weight")


def comparisons(rankings: DataFrame, scheme: str = "full", seed: int = 0) -> DataFrame:
    """Comparisons of long rankings, by the full or the random scheme."""
    if scheme not in ("full", "random"):
        raise ValueError("scheme must be full or random")
    a = to_arrays(rankings)
    return break_full(a) if scheme == "full" else break_random(a, seed)


def pairwise_counts(comps: DataFrame) -> DataFrame:
    """(winner, loser, cnt): weights added up."""
    w = F.sum("weight") if "weight" in comps.columns else F.count("*").cast("double")
    return comps.groupBy("winner", "loser").agg(w.alias("cnt"))


def pairwise_matrix(comps: DataFrame, smoothing: str = "one-sided", nu: float = 1.0) -> DataFrame:
    """(loser, winner, cnt, p): p estimates P(winner beats loser), for both orders of each observed pair.

    smoothing: ``none``, ``one-sided`` (only pairs with no win one way) or ``all``: (c + nu) / (total + 2 nu).
    The two directions of a pair meet in one aggregation, so no join is needed.
    """
    w = F.col("weight") if "weight" in comps.columns else F.lit(1.0)
    low, high = F.least("winner", "loser").alias("low"), F.greatest("winner", "loser").alias("high")
    g = comps.groupBy(low, high).agg(F.sum(F.when(F.col("winner") < F.col("loser"), w).otherwise(0.0)).alias("c_low"), F.sum(F.when(F.col("winner") > F.col("loser"), w).otherwise(0.0)).alias("c_high"))
    two = F.explode(F.array(F.struct(F.col("high").alias("loser"), F.col("low").alias("winner"), F.col("c_low").alias("cnt")), F.struct(F.col("low").alias("loser"), F.col("high").alias("winner"), F.col("c_high").alias("cnt"))))
    total = F.col("c_low") + F.col("c_high")
    raw, smooth = F.col("x.cnt") / F.col("total"), (F.col("x.cnt") + nu) / (F.col("total") + 2 * nu)
    one = (F.col("c_low") == 0) | (F.col("c_high") == 0)
    p = {"none": raw, "all": smooth, "one-sided": F.when(F.col("one"), smooth).otherwise(raw)}[smoothing]
    return g.where("low <> high").withColumn("total", total).withColumn("one", one).withColumn("x", two).select("x.loser", "x.winner", "x.cnt", p.alias("p"))


def dense(pairs: DataFrame, n: int, value: str = "p", diagonal: float = 0.5) -> np.ndarray:
    """The item-by-item matrix [loser, winner] on the driver; cells without a row are 0."""
    out = np.zeros((n, n))
    for r in pairs.select("loser", "winner", value).collect():  # at most n x n rows
        out[r[0], r[1]] = r[2]
    np.fill_diagonal(out, diagonal)
    return out


def choice_counts(rankings: DataFrame) -> DataFrame:
    """(item_id, wins): how often an item is ranked but not last."""
    last = F.max("pos").over(Window.partitionBy("ranking_id"))
    return rankings.withColumn("last", last).groupBy("item_id").agg(F.sum((F.col("pos") < F.col("last")).cast("long")).alias("wins"))


def choice_tensor(rankings: DataFrame) -> DataFrame:
    """(winner, loser, ranking_id, not_last): the un-aggregated comparisons; the winner is never last."""
    return break_full(to_arrays(rankings)).select("winner", "loser", "ranking_id", F.lit(True).alias("not_last"))


def win_matrix(rankings: DataFrame) -> DataFrame:
    """(ranking_id, item_id) where the item is not last."""
    last = F.max("pos").over(Window.partitionBy("ranking_id"))
    return rankings.withColumn("last", last).where("pos < last").select("ranking_id", "item_id")


def stage_statistics(rankings: DataFrame) -> DataFrame:
    """(ranking_id, item_id, u, stages): u is 1 if not last; the item is still there at stages 0 .. stages - 1."""
    last = F.max("pos").over(Window.partitionBy("ranking_id"))
    d = rankings.withColumn("last", last)
    return d.select("ranking_id", "item_id", (F.col("pos") < F.col("last")).cast("int").alias("u"), F.least(F.col("pos") + 1, F.col("last")).alias("stages"))


def pl_log_likelihood(rankings: DataFrame, utilities: DataFrame) -> DataFrame:
    """(ranking_id, component, loglik): Plackett-Luce log-likelihood by a suffix-sum window.

    ``utilities`` has one row an item and component; its size is checked by Spark's broadcast threshold.
    """
    u = utilities if "component" in utilities.columns else utilities.withColumn("component", F.lit(0))
    j = rankings.select("ranking_id", "pos", "item_id").join(u, "item_id")
    # the largest utility is taken out, so that no exponential overflows
    by = Window.partitionBy("ranking_id", "component")
    j = j.withColumn("top", F.max("u").over(by))
    suffix = F.log(F.sum(F.exp(F.col("u") - F.col("top"))).over(by.orderBy("pos").rowsBetween(0, Window.unboundedFollowing))) + F.col("top")
    j = j.withColumn("lse", suffix)
    last = F.max("pos").over(by)
    return j.withColumn("last", last).groupBy("ranking_id", "component").agg(F.sum(F.when(F.col("pos") < F.col("last"), F.col("u") - F.col("lse")).otherwise(0.0)).alias("loglik"))


def posterior(logliks: DataFrame, alpha: DataFrame, trim: float | None = None, hard: bool = False) -> DataFrame:
    """(ranking_id, component, q, lse): softmax over components of loglik + log alpha.

    ``trim`` sets smaller probabilities to 0 and normalises again; ``hard`` gives all to the likeliest component.
    """
    by = Window.partitionBy("ranking_id")
    j = logliks.join(alpha, "component").withColumn("z", F.col("loglik") + F.log("a"))
    j = j.withColumn("top", F.max("z").over(by)).withColumn("e", F.exp(F.col("z") - F.col("top")))
    j = j.withColumn("sum", F.sum("e").over(by)).withColumn("q", F.col("e") / F.col("sum")).withColumn("lse", F.col("top") + F.log("sum"))
    if trim is not None:
        j = j.withColumn("q", F.when(F.col("q") < trim, 0.0).otherwise(F.col("q")))
        j = j.withColumn("q", F.col("q") / F.sum("q").over(by))
    if hard:
        j = j.withColumn("q", (F.row_number().over(by.orderBy(F.desc("q"), "component")) == 1).cast("double"))
    return j.select("ranking_id", "component", "q", "lse")


def centre(utilities: DataFrame) -> DataFrame:
    """Utilities with non-finite values set to 0, centred within each component."""
    ok = F.when(F.isnan("u") | F.col("u").isNull() | (F.abs("u") == float("inf")), 0.0).otherwise(F.col("u"))
    u = utilities if "component" in utilities.columns else utilities.withColumn("component", F.lit(0))
    return u.withColumn("u", ok).withColumn("u", F.col("u") - F.avg("u").over(Window.partitionBy("component"))).select("component", "item_id", "u")


def normalise_alpha(alpha: DataFrame) -> DataFrame:
    """Mixture weights that add to 1; uniform where any is not finite."""
    by = Window.partitionBy()  # one row a component
    bad = F.max((F.isnan("a") | F.col("a").isNull() | (F.abs("a") == float("inf"))).cast("int")).over(by)
    return alpha.withColumn("bad", bad).select("component", F.when(F.col("bad") == 1, 1 / F.count("*").over(by)).otherwise(F.col("a") / F.sum("a").over(by)).alias("a"))
