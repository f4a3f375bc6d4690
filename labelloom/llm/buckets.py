"""Joins with short lists of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A list of at most so many short keys is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a stored table of short rows, with a broadcast hint where its row count is within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
