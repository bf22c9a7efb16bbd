"""Draws and orders by hash that any engine can repeat: the leading bits of an MD5 of a seed and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits(digits: int, seed: int, *keys: str | Column) -> Column:
    """A whole number of ``digits`` hexadecimal digits (15 at most) for each combination of keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def uniform(seed: int, *keys: str | Column) -> Column:
    """A draw in (0, 1) for each combination of keys."""
    return (bits(13, seed, *keys) + 0.5) / float(1 << 52)
