"""Joining interval labels to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.expressions import MICROS, epoch_micros
from riskloom.plans.hotkeys import DEFAULT_LIMITS, HotKeys, SkewLimits, find_hot, running

INJECTED = "adversarial"
# Time span of a leaf; labels are matched exactly inside the leaves at their ends.
LEAF = 600 * MICROS


def label_interval_join(
    features: DataFrame, labels: DataFrame, limits: SkewLimits = DEFAULT_LIMITS
) -> DataFrame:
    """One row per (event, matching label), and one for an event without any.

    A label matches inside its interval (an open end never closes), or when event and label come from
    the same injected batch and entity. Adds is_anomaly, label_type and label_value.
    """
    side = labels.select(
        F.col("scope_id").alias("_scope"),
        F.col("ts_start").alias("_from"),
        F.col("ts_end").alias("_to"),
        F.col("ingest_batch_id").alias("_batch"),
        "label_type",
        F.col("label").alias("label_value"),
    )
    joined = _join(features, side, True, limits)
    is_anomaly = F.when(F.col("label_value") > 0, 1).otherwise(0).alias("is_anomaly")
    return joined.select(*features.columns, is_anomaly, "label_type", "label_value")


def label_between_join(
    features: DataFrame, labels: DataFrame, limits: SkewLimits = DEFAULT_LIMITS
) -> DataFrame:
    """Interval match only; adds label, label_type and severity."""
    side = labels.select(
        F.col("scope_id").alias("_scope"),
        F.col("ts_start").alias("_from"),
        F.col("ts_end").alias("_to"),
        F.col("ingest_batch_id").alias("_batch"),
        "label",
        "label_type",
        "severity",
    )
    return _join(features, side, False, limits).select(*features.columns, "label", "label_type", "severity")


def _inside() -> Column:
    return (F.col("ts") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("ts") <= F.col("_to")))


def _same_injection() -> Column:
    return F.col("ingest_batch_id").startswith(INJECTED) & (F.col("ingest_batch_id") == F.col("_batch"))


def _join(features: DataFrame, side: DataFrame, with_batches: bool, limits: SkewLimits) -> DataFrame:
    hot = find_hot(features.withColumn("_t", epoch_micros("ts")), ["entity_id"], "_t", 86_400, limits)
    same_entity = F.col("entity_id") == F.col("_scope")
    matches = (_inside() | _same_injection()) if with_batches else _inside()
    if hot is None:
        return features.join(side, same_entity & matches, "left")
    tagged = hot.tag(features.withColumn("_t", epoch_micros("ts")), "_t").drop("_seg")
    sparse = tagged.filter(~F.col("_hot")).drop("_hot", "_t").join(side, same_entity & matches, "left")
    dense = _dense_join(tagged.filter("_hot").drop("_hot"), side, with_batches, hot)
    return sparse.unionByName(dense.select(*sparse.columns))


def _cover(first: Column, last: Column, levels: int) -> Column:
    """The fewest dyadic nodes that make up the leaves from `first` to `last`, at most two of each level.

    Node n of level j stands for the leaves n * 2^j to (n + 1) * 2^j - 1; its key is n * 64 + j. Going up a
    level, an odd left end and the leaf before an odd right end are nodes of their own.
    """

    def at(j: Column) -> Column:
        size = F.pow(F.lit(2.0), j)
        low, high = F.ceil(first / size).cast("long"), F.floor((last + 1) / size).cast("long")
        some = low < high
        return F.array(
            F.when(some & (F.pmod(low, F.lit(2)) == 1), low * 64 + j),
            F.when(some & (F.pmod(high, F.lit(2)) == 1), (high - 1) * 64 + j),
        )

    nodes = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))
    return F.filter(nodes, lambda n: n.isNotNull())


def _dense_join(events: DataFrame, side: DataFrame, with_batches: bool, hot: HotKeys) -> DataFrame:
    """Pairs by the dyadic nodes of time: a label, however long or open, is at most two nodes a level, an event
    one of every level, and an event inside a label shares exactly one node with it."""
    keys = hot.table.select(F.col("entity_id").alias("_scope"))
    side = side.join(F.broadcast(keys) if hot.small else keys, "_scope", "left_semi")
    leaf = lambda t: F.floor(t / LEAF).cast("long")
    spans = events.groupBy("entity_id").agg(F.min(leaf(F.col("_t"))).alias("_first"), F.max(leaf(F.col("_t"))).alias("_last"))
    levels = (spans.agg(F.max(F.col("_last") - F.col("_first"))).first()[0] or 0).bit_length()
    low = F.greatest(leaf(epoch_micros("_from")), F.col("_first"))
    high = F.least(F.coalesce(leaf(epoch_micros("_to")), F.col("_last")), F.col("_last"))
    nodes = (
        side.join(spans, side["_scope"] == spans["entity_id"])
        .filter(low <= high)
        .select(*side.columns, F.explode(_cover(low, high, levels)).alias("_node"))
    )
    ids = ["source_dataset", "event_id"]
    up = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda j: F.floor(leaf(F.col("_t")) / F.pow(F.lit(2.0), j)).cast("long") * 64 + j)
    narrow = events.select(*ids, "entity_id", "ts", F.explode(up).alias("_node"))
    on = (F.col("entity_id") == F.col("_scope")) & (narrow["_node"] == nodes["_node"]) & _inside()
    pairs = narrow.join(nodes, on).select(*ids, *side.columns)
    out = events.join(pairs, ids, "left").drop("_t")
    if not with_batches:
        return out
    injected = events.filter(F.col("ingest_batch_id").startswith(INJECTED)).drop("_t")
    extra = injected.join(
        side.filter(F.col("_batch").startswith(INJECTED)),
        (F.col("entity_id") == F.col("_scope")) & (F.col("ingest_batch_id") == F.col("_batch")) & ~_inside(),
    )
    # An event matched only through its batch must not also appear as unmatched.
    matched = extra.select(*ids).distinct().withColumn("_by_batch", F.lit(True))
    out = out.join(matched, ids, "left").filter(F.col("_scope").isNotNull() | F.col("_by_batch").isNull())
    return out.drop("_by_batch").unionByName(extra.select(*[c for c in out.columns if c != "_by_batch"]))


def label_any(features: DataFrame, labels: DataFrame, limits: SkewLimits = DEFAULT_LIMITS) -> DataFrame:
    """One row per event: is_anomaly is 1 when any positive label matches.

    Counts open positive intervals while sweeping time, so overlapping or open-ended labels cost
    nothing extra; batch matches come from the distinct (batch, entity) pairs.
    """
    positive = labels.filter((F.col("label") > 0) & (F.col("ts_end").isNull() | (F.col("ts_end") >= F.col("ts_start"))))
    one = F.lit(1).cast("long")
    marks = positive.select(
        F.col("scope_id").alias("entity_id"),
        F.explode(
            F.filter(
                F.array(
                    F.struct(epoch_micros("ts_start").alias("_t"), F.lit(0).alias("_kind"), one.alias("_open")),
                    F.struct(epoch_micros("ts_end").alias("_t"), F.lit(2).alias("_kind"), (-one).alias("_open")),
                ),
                lambda m: m["_t"].isNotNull(),
            )
        ).alias("m"),
    ).select("entity_id", "m.*")
    points = features.select(
        "entity_id",
        epoch_micros("ts").alias("_t"),
        F.lit(1).alias("_kind"),
        F.lit(0).cast("long").alias("_open"),
        F.struct(*[c for c in features.columns if c != "entity_id"]).alias("_row"),
    )
    few = SkewLimits(limits.segment_rows, limits.segment_rows, limits.local_table_rows)
    hot = find_hot(points, ["entity_id"], "_t", 86_400, few)
    swept = (
        running(points.unionByName(marks, allowMissingColumns=True), hot, ["entity_id"], ["_open"])
        .filter(F.col("_row").isNotNull())
        .select("entity_id", "_row.*", "_open")
    )
    pairs = (
        labels.filter((F.col("label") > 0) & F.col("ingest_batch_id").startswith(INJECTED))
        .select("ingest_batch_id", F.col("scope_id").alias("entity_id"))
        .distinct()
        .withColumn("_injected", F.lit(True))
    )
    hit = (F.col("_open") > 0) | F.col("_injected").isNotNull()
    return swept.join(pairs, ["ingest_batch_id", "entity_id"], "left").select(
        *features.columns, F.when(hit, 1).otherwise(0).alias("is_anomaly")
    )
