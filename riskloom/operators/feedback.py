"""Prediction log and the feedback given on it. Both tables only grow; the current state is a view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.evaluate import ratio
from riskloom.schema import PREDICTIONS, conform


def log_predictions(
    scored: DataFrame, run: str, logged_at, score: str = "anomaly_score", label: str = "is_anomaly"
) -> DataFrame:
    """Log rows for scored events. The id hashes run and event, so logging twice gives the same rows."""
    return conform(
        scored.select(
            F.sha1(F.concat_ws("|", F.lit(run), "source_dataset", "event_id")).alias("prediction_id"),
            F.lit(logged_at).cast("timestamp").alias("timestamp"),
            F.coalesce("entity_id", F.lit("unknown")).alias("entity_id"),
            F.coalesce("source_dataset", F.lit("unknown")).alias("source_dataset"),
            F.coalesce(F.col(score), F.lit(0.0)).alias("anomaly_score"),
            F.coalesce(F.col(label), F.lit(0)).alias("predicted_label"),
        ),
        PREDICTIONS,
    )


def append_predictions(log: DataFrame, fresh: DataFrame) -> DataFrame:
    """Known prediction ids are left alone."""
    unique = fresh.dropDuplicates(["prediction_id"])
    return log.unionByName(unique.join(log.select("prediction_id"), "prediction_id", "left_anti"))


def accept_feedback(log: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feedback on known predictions, feedback on unknown ids)."""
    known = log.select("prediction_id")
    return (
        feedback.join(known, "prediction_id", "left_semi"),
        feedback.join(known, "prediction_id", "left_anti"),
    )


def feedback_view(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every prediction with its latest feedback."""
    rest = F.struct("actual_label", "notes")
    latest = feedback.groupBy("prediction_id").agg(F.max(F.struct("recorded_at", rest.alias("r"))).alias("_m")).select(
        "prediction_id",
        F.lit(True).alias("_given"),
        F.col("_m.r.actual_label").alias("actual_label"),
        F.col("_m.r.notes").alias("notes"),
    )
    given = F.coalesce(F.col("_given"), F.lit(False))
    return log.join(latest, "prediction_id", "left").select(
        *log.columns,
        given.alias("feedback_received"),
        "actual_label",
        F.when(given, F.col("predicted_label") == F.col("actual_label")).alias("is_correct"),
        "notes",
    )


def feedback_stats(view: DataFrame) -> DataFrame:
    """Accuracy over answered predictions; zero rows answered gives zeros."""
    given = F.col("feedback_received")
    cell = lambda p, a: F.count_if(given & (F.col("predicted_label") == p) & (F.col("actual_label") == a))
    counts = view.agg(
        F.count("*").alias("total_predictions"),
        F.count_if(given).alias("with_feedback"),
        F.count_if(given & F.col("is_correct")).alias("_correct"),
        cell(1, 1).alias("true_positives"),
        cell(1, 0).alias("false_positives"),
        cell(0, 0).alias("true_negatives"),
        cell(0, 1).alias("false_negatives"),
    )
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return counts.select(
        F.when(F.col("with_feedback") > 0, F.col("total_predictions")).otherwise(0).alias("total_predictions"),
        "with_feedback",
        ratio(F.col("_correct"), F.col("with_feedback")).alias("accuracy"),
        "true_positives",
        "false_positives",
        "true_negatives",
        "false_negatives",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
    )


def recent_predictions(view: DataFrame, n: int = 20) -> DataFrame:
    return view.orderBy(F.desc("timestamp"), F.asc("prediction_id")).limit(n)


def pending_feedback(view: DataFrame) -> DataFrame:
    return view.filter((F.col("predicted_label") == 1) & ~F.col("feedback_received"))
