"""As-of lookups: the last label before an event, the last cached features at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.expressions import MICROS, epoch_micros
from riskloom.plans.hotkeys import DEFAULT_LIMITS, SkewLimits, find_hot, running


def asof_label(
    events: DataFrame,
    labels: DataFrame,
    label_types: Sequence[str] = ("fraud", "anomaly"),
    limits: SkewLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Events plus, per label type, seconds since the entity's last label that began strictly earlier.

    Scope, label value and source are ignored. Events and label starts are merged into one ordered
    stream, so nothing is joined pairwise and no row is multiplied.
    """
    points = events.select(
        "entity_id",
        epoch_micros("ts").alias("_t"),
        F.lit(0).alias("_kind"),
        F.struct(*[c for c in events.columns if c != "entity_id"]).alias("_row"),
    )
    starts = labels.filter(F.col("label_type").isin(list(label_types))).select(
        F.col("scope_id").alias("entity_id"),
        epoch_micros("ts_start").alias("_t"),
        F.lit(1).alias("_kind"),
        *[F.when(F.col("label_type") == t, epoch_micros("ts_start")).alias(f"_lab_{t}") for t in label_types],
    )
    hot = find_hot(points, ["entity_id"], "_t", 86_400, SkewLimits(limits.segment_rows, limits.segment_rows, limits.local_table_rows))
    merged = running(
        points.unionByName(starts, allowMissingColumns=True), hot, ["entity_id"], maxes=[f"_lab_{t}" for t in label_types]
    )
    out = merged.filter(F.col("_row").isNotNull()).select(
        "entity_id",
        "_row.*",
        *[
            ((F.col("_t") - F.col(f"_lab_{t}")) / F.lit(float(MICROS))).alias(f"time_since_last_{t}_seconds")
            for t in label_types
        ],
    )
    return out.select(*events.columns, *[f"time_since_last_{t}_seconds" for t in label_types])


def cache_rows(features: DataFrame, computed_at) -> DataFrame:
    """Cache form of feature rows: the whole row as JSON per (entity, time)."""
    return features.select(
        "entity_id",
        "ts",
        F.to_json(F.struct(*features.columns), {"ignoreNullFields": "false"}).alias("features"),
        F.lit(computed_at).cast("timestamp").alias("computed_at"),
    )


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Newest computation per (entity, time) wins."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    newest = F.struct("computed_at", "_new", "features")
    return both.groupBy("entity_id", "ts").agg(F.max(newest).alias("_m")).select(
        "entity_id", "ts", F.col("_m.features").alias("features"), F.col("_m.computed_at").alias("computed_at")
    )


def cache_lookup(cache: DataFrame, as_of, entity_ids: Sequence[str] | None = None) -> DataFrame:
    """Newest cached row at or before a time, per entity."""
    past = cache.filter(F.col("ts") <= F.lit(as_of).cast("timestamp"))
    if entity_ids is not None:
        past = past.filter(F.col("entity_id").isin(list(entity_ids)))
    return past.groupBy("entity_id").agg(
        F.max_by("features", "ts").alias("features"), F.max("ts").alias("ts")
    )
