"""Combining several detectors' scores, and choosing which detector suits an entity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import config as C

METHODS = ["weighted_average", "max", "min", "mean", "median"]


def ensemble_score(scores: Mapping[str, str], method: str = "weighted_average", weights: Mapping[str, float] | None = None) -> Column:
    """One score from several columns ({detector: column}); missing scores are left out and the
    remaining weights add up to one again."""
    weights = dict(weights or C.ENSEMBLE_WEIGHTS)
    cols = [F.col(c).cast("double") for c in scores.values()]
    if method == "max":
        return F.greatest(*cols, cols[0])
    if method == "min":
        return F.least(*cols, cols[0])
    if method == "weighted_average":
        w = [F.when(c.isNotNull(), F.lit(float(weights.get(d, 0.0)))).otherwise(0.0) for d, c in zip(scores, cols)]
        total = sum(w, F.lit(0.0))
        summed = sum((F.coalesce(c, F.lit(0.0)) * wi for c, wi in zip(cols, w)), F.lit(0.0))
        return F.when(total > 0, summed / total)
    present = F.array_sort(F.array_compact(F.array(*cols)))
    n = F.size(present)
    if method == "mean":
        added = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
        return F.when(n > 0, added / n)
    if method == "median":
        low = F.get(present, F.floor((n - 1) / 2).cast("int"))
        high = F.get(present, F.floor(n / 2).cast("int"))
        return F.when(n > 0, (low + high) / 2)
    raise ValueError(f"unknown method {method!r}; choose one of {METHODS}")


def route_models(events: DataFrame, labels: DataFrame, min_days: int = C.MIN_HISTORY_DAYS) -> DataFrame:
    """Detector family per entity: supervised with labels, time series with enough history, else
    unsupervised."""
    history = events.groupBy("entity_id").agg(
        F.count("*").alias("events"),
        ((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / F.lit(86_400e6)).alias("history_days"),
    )
    labelled = labels.select(F.col("scope_id").alias("entity_id")).distinct().withColumn("_l", F.lit(True))
    family = (
        F.when(F.col("_l"), "supervised")
        .when(F.col("history_days") >= min_days, "time_series")
        .otherwise("unsupervised")
    )
    return history.join(labelled, "entity_id", "left").select("entity_id", "events", "history_days", family.alias("model_family"))
