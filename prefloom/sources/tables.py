"""Rankings, responses and labels derived from ordinary business tables, and readers and writers for their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.estimators import dense_ids


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """Long tables from parquet, orc, json or csv (with a header)."""
    r = spark.read if schema is None else spark.read.schema(schema)
    return r.csv(path, header=True) if kind == "csv" else r.format(kind).load(path)


def save(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", by: str | None = None) -> None:
    w = df.write.mode(mode)
    w = w.partitionBy(by) if by else w
    w.csv(path, header=True) if kind == "csv" else w.format(kind).save(path)


def _rank(firsts: DataFrame, user: str, order: list) -> DataFrame:
    by = Window.partitionBy(user).orderBy(*order)
    return firsts.select(F.col(user).cast("long").alias("ranking_id"), (F.row_number().over(by) - 1).cast("int").alias("pos"), "item_id", *[c for c in ("label", "t") if c in firsts.columns])


def event_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event types by first occurrence: full rankings of few items."""
    e = read(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("label")).agg(F.min("ts").alias("ts"))
    return _rank(dense_ids(e, "label"), "user_id", ["ts", "label"])


def order_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's order priorities by first order date: partial rankings, down to a single item."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("label")).agg(F.min("o_orderdate").alias("day"))
    return _rank(dense_ids(o, "label"), "o_custkey", ["day", "label"])


def brand_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's brands by highest price: short rankings of many items."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("label"))
    b = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", "label").agg(F.max("l_extendedprice").alias("price"))
    return _rank(dense_ids(b, "label"), "l_orderkey", [F.desc("price"), "label"])


def binary_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer x priority, right if the latest order has status F; pairs without an order are missing."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("label")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    return dense_ids(o, "label").select(F.col("user_id").cast("long"), "item_id", (F.col("status") == "F").cast("int").alias("score"))


def graded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer x priority, the number of orders beyond the first, at most 3."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("label")).agg(F.least(F.count("*") - 1, F.lit(3)).cast("int").alias("score"))
    return dense_ids(o, "label").select(F.col("user_id").cast("long"), "item_id", "score")
