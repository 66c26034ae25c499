"""Broadcasts behind a check of the table's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import enable_checkpoints

#: A table is broadcast by hint up to this many rows (a station's name and a few numbers:
#: some 30 MB); beyond it Spark picks the join.
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, computed once. Up to ``limit`` rows come back as a local table with a
    broadcast hint, from the same job that finds out their number; a larger table is
    stored in the shared checkpoint folder and joined as Spark sees fit. Meant for
    aggregates with one row per class, split or station, whose number only the data know."""
    head = df.limit(limit + 1).toArrow()
    if head.num_rows <= limit:
        return F.broadcast(df.sparkSession.createDataFrame(head, df.schema))
    enable_checkpoints(df.sparkSession)
    return df.checkpoint()
