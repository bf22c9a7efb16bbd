"""Synthetic rankings, comparisons and responses from known parameters.

Draws are hashes of seed and row keys, so a seed gives the same table on any cluster.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.hashing import uniform
from ..operators.metrics import level_arrays, pcm_probabilities


def normal_noise(scale: float = 1.0):
    """Box-Muller on two hashed uniforms."""
    return lambda seed, *keys: scale * F.sqrt(-2 * F.log(uniform(seed, *keys, F.lit(1)))) * F.cos(2 * math.pi * uniform(seed, *keys, F.lit(2)))


def gumbel_noise(scale: float = 1.0):
    return lambda seed, *keys: -scale * F.log(-F.log(uniform(seed, *keys)))


def exponential_noise(scale: float = 1.0):
    return lambda seed, *keys: -scale * F.log(1 - uniform(seed, *keys))


NOISES = {"normal": normal_noise(), "gumbel": gumbel_noise(), "exponential": exponential_noise(), "normal-half": normal_noise(0.5)}


def mean_pairwise(utilities: DataFrame, link, n: int) -> DataFrame:
    """(k, x): for i < j, F(Ui - Uj) / 2 - F(Uj - Ui) / 2 at the pair's place."""
    a, b = utilities.select(F.col("item_id").alias("i"), F.col("u").alias("ui")), utilities.select(F.col("item_id").alias("j"), F.col("u").alias("uj"))
    j = a.join(b, F.col("i") < F.col("j"))
    k = (n * F.col("i") - F.floor(F.col("i") * (F.col("i") + 1) / 2) + F.col("j") - F.col("i") - 1).cast("int")
    return j.select(k.alias("k"), (link.cdf_col(F.col("ui") - F.col("uj")) / 2 - link.cdf_col(F.col("uj") - F.col("ui")) / 2).alias("x"))


def _ranked(drawn: DataFrame, *carry: str) -> DataFrame:
    by = Window.partitionBy("ranking_id").orderBy(F.desc("x"), "item_id")
    return drawn.select("ranking_id", (F.row_number().over(by) - 1).cast("int").alias("pos"), "item_id", *carry)


def menus(spark: SparkSession, n: int, sizes: list[int], seed: int = 0) -> DataFrame:
    """(menu_id, item_id): random subsets of these sizes, repeated sets once."""
    m = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "menu_id long, size int")
    x = m.select("menu_id", "size", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("item_id"))
    by = Window.partitionBy("menu_id").orderBy(uniform(seed, "menu_id", "item_id"))
    g = x.withColumn("r", F.row_number().over(by)).where("r <= size").groupBy("menu_id").agg(F.sort_array(F.collect_list("item_id")).alias("a"))
    return g.groupBy("a").agg(F.min("menu_id").alias("menu_id")).select("menu_id", F.explode("a").alias("item_id"))


def partial_rankings(utilities: DataFrame, menu: DataFrame, noise="gumbel", m: int = 200, seed: int = 0) -> DataFrame:
    """m noisy rankings of each menu, best first."""
    x = menu.join(utilities, "item_id").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    x = x.withColumn("ranking_id", F.col("menu_id") * m + F.col("draw"))
    return _ranked(x.withColumn("x", F.col("u") + _noise(noise)(seed, "ranking_id", "item_id")), "menu_id")


def _noise(noise):
    return NOISES[noise] if isinstance(noise, str) else noise


def _beside(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Each row with each of the items, which are few: no join."""
    cells = [F.struct(*[F.lit(r[c]).cast(items.schema[c].dataType).alias(c) for c in items.columns]) for r in items.orderBy("item_id").collect()]
    return rows.withColumn("_i", F.explode(F.array(*cells))).select(*rows.columns, "_i.*")


def rankings(utilities: DataFrame, noise="gumbel", m: int = 1000, p0: float = 1.0, seed: int = 0, noises: dict | None = None) -> DataFrame:
    """m full rankings; with p0 < 1 each place is kept with that probability, and rankings of one item or none go.

    ``noises`` gives items noises of their own.
    """
    return rankings_of(utilities.sparkSession.range(m).select(F.col("id").alias("ranking_id")), utilities, noise, p0, seed, noises)


def rankings_of(rows: DataFrame, utilities: DataFrame, noise="gumbel", p0: float = 1.0, seed: int = 0, noises: dict | None = None) -> DataFrame:
    """The same, a ranking for each ``ranking_id`` of a table."""
    x = _beside(rows.select("ranking_id"), utilities.select("item_id", "u"))
    e = _noise(noise)(seed, "ranking_id", "item_id")
    for item, own in (noises or {}).items():
        e = F.when(F.col("item_id") == item, _noise(own)(seed, "ranking_id", "item_id")).otherwise(e)
    return thin(_ranked(x.withColumn("x", F.col("u") + e)), p0, seed + 1)


def thin(ranked: DataFrame, p0: float, seed: int) -> DataFrame:
    if p0 >= 1:
        return ranked
    kept = ranked.where(uniform(seed, "ranking_id", "pos") < p0).withColumn("n", F.count("*").over(Window.partitionBy("ranking_id"))).where("n > 1").drop("n")
    return kept.withColumn("pos", (F.row_number().over(Window.partitionBy("ranking_id").orderBy("pos")) - 1).cast("int"))


def mixture_rankings(u: np.ndarray, alpha: np.ndarray, spark: SparkSession, noise="gumbel", m: int = 200, p0: float = 1.0, seed: int = 0) -> DataFrame:
    """m rankings (ranking_id, pos, item_id, component) of a mixture."""
    return mixture_rankings_of(spark.range(m).select(F.col("id").alias("ranking_id")), u, alpha, noise, p0, seed)


def mixture_rankings_of(rows: DataFrame, u: np.ndarray, alpha: np.ndarray, noise="gumbel", p0: float = 1.0, seed: int = 0) -> DataFrame:
    """The same, a ranking for each ``ranking_id`` of a table; the component is drawn first and stays on the row."""
    cum = [float(c) for c in np.cumsum(alpha) / np.sum(alpha)]
    pick = F.least(F.size(F.filter(F.array(*[F.lit(c) for c in cum]), lambda c: c <= uniform(seed + 7, "ranking_id"))), F.lit(len(cum) - 1))
    r = rows.select("ranking_id").withColumn("component", pick)
    names = rows.sparkSession.createDataFrame([(k, i, float(v)) for k, row in enumerate(np.atleast_2d(u)) for i, v in enumerate(row)], "component int, item_id int, u double")
    x = r.join(names, "component")
    return thin(_ranked(x.withColumn("x", F.col("u") + _noise(noise)(seed, "ranking_id", "item_id")), "component"), p0, seed + 1)


def time_varying_utilities(spark: SparkSession, n: int, steps: int, frequency: float = 1.0, bias: float = 1.0, seed: int = 0) -> DataFrame:
    """(t, item_id, u): sin(t x frequency of the item) + bias of the item; both are normal draws."""
    items = spark.range(n).select(F.col("id").cast("int").alias("item_id"))
    items = items.withColumn("f", normal_noise(frequency)(seed, F.lit("f"), "item_id")).withColumn("b", normal_noise(bias)(seed, F.lit("b"), "item_id"))
    return items.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).select("t", "item_id", (F.sin(F.col("t") * F.col("f")) + F.col("b")).alias("u"))


def time_varying_comparisons(timed: DataFrame, n: int, noise="gumbel", draws: int = 100, p0: float | None = None, seed: int = 0) -> DataFrame:
    """(t, winner, loser): at each t a random graph (edge probability 1/n by default), ``draws`` comparisons an edge."""
    p0 = 1 / n if p0 is None else p0
    a, b = timed.select("t", F.col("item_id").alias("i"), F.col("u").alias("ui")), timed.select("t", F.col("item_id").alias("j"), F.col("u").alias("uj"))
    e = a.join(b, "t").where("i < j").where(uniform(seed, "t", "i", "j") < p0).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    f = _noise(noise)
    first = F.col("ui") + f(seed + 1, "t", "i", "j", "draw", F.lit(1)) > F.col("uj") + f(seed + 1, "t", "i", "j", "draw", F.lit(2))
    return e.select("t", F.when(first, F.col("i")).otherwise(F.col("j")).alias("winner"), F.when(first, F.col("j")).otherwise(F.col("i")).alias("loser"))


def timed_rankings(timed: DataFrame, noise="gumbel", m: int = 100, seed: int = 0) -> DataFrame:
    """(t, ranking_id, pos, item_id): m full rankings at each t."""
    x = timed.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("ranking_id", F.col("t").cast("long") * m + F.col("draw"))
    return _ranked(x.withColumn("x", F.col("u") + _noise(noise)(seed, "ranking_id", "item_id")), "t")


def timed_partial_rankings(timed: DataFrame, timed_menus: DataFrame, noise="gumbel", m: int = 100, seed: int = 0) -> DataFrame:
    """The same over menus (t, menu_id, item_id)."""
    x = timed.join(timed_menus, ["t", "item_id"]).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    x = x.withColumn("ranking_id", hashing.bits(15, seed, "t", "menu_id", "draw"))
    return _ranked(x.withColumn("x", F.col("u") + _noise(noise)(seed, "ranking_id", "item_id")), "t", "menu_id")


def comparisons_from_p(p: np.ndarray, pairs: DataFrame, draws: int = 100, seed: int = 0) -> DataFrame:
    """(winner, loser, weight): of ``draws`` meetings of each (i, j), those i wins with probability p[j, i]."""
    names = pairs.sparkSession.createDataFrame([(i, j, float(p[j, i])) for i in range(len(p)) for j in range(len(p)) if i != j], "i int, j int, p double")
    e = pairs.join(names, ["i", "j"]).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    first = uniform(seed, "i", "j", "draw") < F.col("p")
    e = e.select(F.when(first, F.col("i")).otherwise(F.col("j")).alias("winner"), F.when(first, F.col("j")).otherwise(F.col("i")).alias("loser"))
    return e.groupBy("winner", "loser").agg(F.count("*").cast("double").alias("weight"))


def rasch(thetas: DataFrame, betas: DataFrame, p: float = 1.0, seed: int = 0) -> DataFrame:
    """(user_id, item_id, score): observed with probability p, right with probability sigmoid(theta - beta)."""
    x = _beside(thetas, betas.select("item_id", "beta")).where(uniform(seed, "user_id", "item_id") < p)
    right = uniform(seed + 1, "user_id", "item_id") < 1 / (1 + F.exp(F.col("beta") - F.col("theta")))
    return x.select("user_id", "item_id", right.cast("int").alias("score"))


def graded(thetas: DataFrame, difficulties: DataFrame, seed: int = 0) -> DataFrame:
    """Partial-credit scores from (item_id, level, beta), by inverting the cumulative distribution."""
    x = _beside(thetas, level_arrays(difficulties)).withColumn("probs", pcm_probabilities(F.col("theta"), F.col("betas"))).withColumn("draw", uniform(seed, "user_id", "item_id"))
    run = F.aggregate("probs", F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k")), lambda a, q: F.struct((a["s"] + q).alias("s"), (a["k"] + (a["s"] + q <= F.col("draw")).cast("int")).alias("k")))
    return x.select("user_id", "item_id", F.least(run["k"], F.size("probs") - 1).alias("score"))
