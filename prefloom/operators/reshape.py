"""Splits, reshapes and masks of responses and pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..sources.shared import cut
from . import ordering

MISSING = -99999


def split_responses(responses: DataFrame, p: float = 0.8, seed: int = 0) -> DataFrame:
    """Adds ``split``: in each item, floor(p x count) responses (by hash of user and item) are train, the rest test.

    The last train response of an item is found by selection, so that an item with most of the responses is never
    gathered.
    """
    keyed = cut(responses.withColumn("_key", ordering.key_of(seed, "user_id", "item_id")))
    want = keyed.groupBy("item_id").agg(F.floor(F.lit(p) * F.count("*")).alias("k"))
    taken = ordering.least(keyed, ["item_id"], "_key", ["user_id"], want)
    return taken.withColumn("split", F.when(F.col("taken"), "train").otherwise("test")).drop("_key", "taken")


def split_users(responses: DataFrame, p_train: float = 0.8, p_test: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test): responses of the first int(n p_train) and the last int(n p_test) users in hash order."""
    users = cut(responses.select("user_id").distinct().withColumn("_key", ordering.key_of(seed, "user_id")).withColumn("_all", F.lit(0)))
    n = users.count()

    def first(k: int) -> DataFrame:
        want = users.sparkSession.createDataFrame([(0, k)], "_all int, k long")
        return ordering.least(users, ["_all"], "_key", ["user_id"], want)

    train = first(int(n * p_train)).where("taken").select("user_id")
    test = first(n - int(n * p_test)).where("not taken").select("user_id")
    return responses.join(train, "user_id", "left_semi"), responses.join(test, "user_id", "left_semi")


def graded_to_binary(responses: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """f on every observed score."""
    return responses.withColumn("score", f(F.col("score")).cast("int"))


def unpivot(wide: DataFrame, user: str = "user_id", missing: int = MISSING) -> DataFrame:
    """One column an item to long responses; nulls and the missing marker have no row."""
    items = [c for c in wide.columns if c != user]
    cells = F.array(*[F.struct(F.lit(k).alias("item_id"), F.col(c).cast("int").alias("score")) for k, c in enumerate(items)])
    return wide.select(F.col(user).alias("user_id"), F.explode(cells).alias("x")).select("user_id", "x.item_id", "x.score").where(F.col("score").isNotNull() & (F.col("score") != missing))


def pivot(responses: DataFrame, n: int, missing: int = MISSING) -> DataFrame:
    g = responses.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("item_id", "score"))).alias("m"))
    return g.select("user_id", *[F.coalesce(F.try_element_at("m", F.lit(i)), F.lit(missing)).alias(f"item_{i}") for i in range(n)])


def one_hot(responses: DataFrame, levels: int) -> DataFrame:
    """(user_id, item_id, level, z) for levels 0 .. levels of observed cells."""
    return responses.select("user_id", "item_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: (F.col("score") == k).cast("int"))).alias("level", "z"))


def score_pairs(responses: DataFrame, k1: int, k2: int) -> DataFrame:
    """(user_id, i, j): the user has k1 on i and k2 on j; not aggregated."""
    g = responses.groupBy("user_id").agg(F.collect_list(F.when(F.col("score") == k1, F.col("item_id"))).alias("a"), F.collect_list(F.when(F.col("score") == k2, F.col("item_id"))).alias("b"))
    return g.select("user_id", F.explode("a").alias("i"), "b").select("user_id", "i", F.explode("b").alias("j"))


def cartesian(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All combinations of rows of item-sized tables."""
    for o in others:
        first = first.crossJoin(o)
    return first


def mask(cells: DataFrame, index: DataFrame, complement: bool = False) -> DataFrame:
    """Cells (i, j, ..) in the index set, or outside it."""
    return cells.join(index.select("i", "j"), ["i", "j"], "left_anti" if complement else "left_semi")


def random_pairs(spark, n: int, p: float, seed: int = 0, symmetric: bool = False) -> DataFrame:
    """(i, j), i < j, each with probability p; with ``symmetric`` both ways."""
    i = spark.range(n).select(F.col("id").cast("int").alias("i"))
    e = i.select("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j")).where("i < j")
    e = e.where(uniform(seed, "i", "j") < p)
    return e.union(e.select("j", "i")) if symmetric else e
