"""Checks of long-form tables.  Missing responses and unranked items are absent rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

def require(df: DataFrame, columns) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    if lack := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lack)}")
    return df
