"""Broadcast decisions that rest on a counted size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import materialise

#: Rows of narrow keys up to which one side of a join is broadcast (about 16 MB of longs).
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, written once, with a broadcast hint if its count shows that it fits; else for a shuffled join."""
    held = materialise(df, "side")
    return F.broadcast(held) if held.count() <= limit else held
