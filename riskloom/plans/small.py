"""Broadcasting and driver-side tables, only for what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000


def local_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """The same narrow table held locally when it has at most `rows` rows, else None."""
    held = df.limit(rows + 1).toArrow()
    if held.num_rows > rows:
        return None
    return df.sparkSession.createDataFrame(held, df.schema)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a table of at most `rows` rows; leave a larger one to a shuffle join."""
    held = local_if_small(df, rows)
    return df if held is None else F.broadcast(held)


def has_rows(df: DataFrame) -> bool:
    """One job over all partitions, where take(1) would try them in growing rounds."""
    return df.agg(F.count_if(F.lit(True))).first()[0] > 0
