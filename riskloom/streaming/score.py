"""Scoring arriving feature rows: anomalies explained, mapped to impact and logged, per micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.explain import explain
from riskloom.operators.feedback import log_predictions
from riskloom.operators.impact import IMPACT_COLUMNS, attach_impact, cost_label
from riskloom.streaming.source import stream_events


@dataclass
class Scoring:
    """What a batch needs: a scorer adding anomaly_score and is_anomaly, statistics and weights for the
    explanation, and impact rules."""

    score: Callable[[DataFrame], DataFrame]
    stats: dict[str, tuple[float, float]]
    importance: dict[str, float]
    rule_rows: DataFrame
    run: str = "stream"


def score_batch(df: DataFrame, scoring: Scoring, logged_at) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, anomalies with explanation and impact, prediction log rows)."""
    return tell_batch(scoring.score(df), scoring, logged_at)


def tell_batch(scored: DataFrame, scoring: Scoring, logged_at) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of rows that have their score."""
    hits = scored.filter(F.col("is_anomaly") == 1)
    told = attach_impact(explain(hits, scoring.stats, scoring.importance), scoring.rule_rows)
    anomalies = told.select(
        "event_id", "entity_id", "source_dataset", "entity_type", "ts", "anomaly_score", "summary", *IMPACT_COLUMNS
    ).withColumn("cost", F.when(F.col("estimated_cost").isNotNull(), cost_label()))
    counts = scored.agg(
        F.count("*").alias("processed"), F.count_if(F.col("is_anomaly") == 1).alias("anomaly_count")
    )
    return counts, anomalies, log_predictions(hits, scoring.run, logged_at)


def run_scoring_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    scoring: Scoring,
    out: str,
    checkpoint: str,
    files_per_batch: int = 100,
    source_dataset: str | None = None,
    interval: str | None = None,
):
    """Score feature files as they land; without an interval, all waiting files and stop.

    Each batch overwrites its own folders, so a replay after a failure leaves no duplicates.
    """

    def handle(df: DataFrame, batch_id: int) -> None:
        df = scoring.score(df).persist()  # three tables are made of it
        at = df.agg(F.max("ts")).first()[0]
        counts, anomalies, log = tell_batch(df, scoring, at)
        for name, table in (("counts", counts), ("anomalies", anomalies), ("predictions", log)):
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
        df.unpersist()

    stream = stream_events(spark, source, schema, files_per_batch, source_dataset)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if interval:
        return writer.trigger(processingTime=interval).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_totals(spark: SparkSession, out: str) -> DataFrame:
    """Totals over all batches so far, and the anomaly rate."""
    counts = spark.read.parquet(f"{out}/counts")
    total, hits = F.sum("processed"), F.sum("anomaly_count")
    return counts.agg(
        total.alias("total_processed"), hits.alias("total_anomalies"), (hits / F.greatest(total, F.lit(1))).alias("anomaly_rate")
    )
