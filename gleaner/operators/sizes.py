"""What is sent to every task has a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def small_or_not(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its counted rows stay below `limit` bytes; unhinted (a shuffled join) beyond."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
