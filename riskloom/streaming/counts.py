"""Event counts per entity over tumbling, sliding and session windows; batch and stream alike.

A stream that appends gives a window out once the watermark has passed it. `run_count_stream` gives every
window out whenever it grows, under the number of the batch; `current_counts` takes the newest of each, so a
stream and a batch over the same events agree at any time, open windows included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.schema import RAW_EVENTS
from riskloom.streaming.source import stream_events

WATERMARK = "24 hours"


def _counted(df: DataFrame, bounds: Column) -> DataFrame:
    return df.groupBy("entity_id", bounds.alias("w")).agg(F.count("*").alias("n")).select(
        "entity_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"
    )


def window_counts(df: DataFrame, size: str = "1 hour", slide: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Counts per entity and window. A stream emits a window once the watermark has passed it."""
    if df.isStreaming:
        df = df.withWatermark("ts", watermark)
    return _counted(df, F.window("ts", size, slide) if slide else F.window("ts", size))


def session_counts(df: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Counts per entity and session, a session ending after `gap` without events."""
    if df.isStreaming:
        df = df.withWatermark("ts", watermark)
    return _counted(df, F.session_window("ts", gap))


def run_count_stream(
    spark: SparkSession,
    source: str,
    out: str,
    checkpoint: str,
    size: str = "1 hour",
    slide: str | None = None,
    watermark: str = WATERMARK,
    files_per_batch: int = 100,
):
    """Count all files waiting in `source`, then stop; a batch done again overwrites its own folder."""

    def keep(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    counted = window_counts(stream_events(spark, source, RAW_EVENTS, files_per_batch), size, slide, watermark)
    query = counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def current_counts(spark: SparkSession, out: str) -> DataFrame:
    """The newest count of every window so far."""
    rows = spark.read.parquet(out)
    return rows.groupBy("entity_id", "window_start", "window_end").agg(F.max_by("n", "batch_id").alias("n"))
