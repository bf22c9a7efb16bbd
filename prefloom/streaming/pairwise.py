"""Pairwise statistics of comparisons that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(comparisons: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window, winner, loser, cnt) over event-time windows; rows later than the watermark are dropped by Spark."""
    w = F.sum("weight") if "weight" in comparisons.columns else F.count("*").cast("double")
    return comparisons.withWatermark(time, late).groupBy(F.window(time, window), "winner", "loser").agg(w.alias("cnt"))


def running_counts(comparisons: DataFrame) -> DataFrame:
    """(winner, loser, cnt) so far; state is bounded by the item pairs.  For ``complete`` or ``update`` output."""
    w = F.sum("weight") if "weight" in comparisons.columns else F.count("*").cast("double")
    return comparisons.groupBy("winner", "loser").agg(w.alias("cnt"))
