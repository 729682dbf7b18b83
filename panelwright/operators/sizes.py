"""Which tables may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a side that may be broadcast; above it the join shuffles.
BROADCAST_ROWS = 500_000


def bounded(rows: DataFrame) -> DataFrame:
    """rows, of a few narrow columns, with a broadcast hint if they are few enough, else unchanged."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows
