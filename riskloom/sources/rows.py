"""Positions of rows inside a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.plans.small import broadcast_if_small

# Splits held on the driver: about 25 TB of files at the usual split size; beyond it, a shuffle join.
SPLIT_ROWS = 200_000


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """0-based position of each row over the files of a scan, in file and offset order.

    Rows are numbered inside their file split; each split adds the row counts of the splits before
    it. Only the table of splits is ordered, the rows never move. Needs a direct file scan, for the
    scan gives every row its split.
    """
    mid = F.monotonically_increasing_id()
    tagged = df.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        mid.alias("_mid"),
    )
    splits = tagged.groupBy("_path", "_start").agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
    before = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "_path", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return tagged.join(broadcast_if_small(offsets, SPLIT_ROWS), ["_path", "_start"]).select(
        *df.columns, (F.col("_offset") + F.col("_mid") - F.col("_first")).alias(name)
    )
