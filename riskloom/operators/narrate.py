"""Evidence for an alert, and entity state in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.expressions import epoch_micros, iso_utc
from riskloom.plans.hotkeys import DEFAULT_LIMITS, SkewLimits, find_hot, with_tail_rows

TIMELINE = 5


def window_words(hours: int) -> str:
    """24 -> 'last 1 day', 6 -> 'last 6 hours'."""
    if hours % 24 == 0:
        days = hours // 24
        return f"last {days} day" + ("s" if days != 1 else "")
    return f"last {hours} hour" + ("s" if hours != 1 else "")


def count_sentence(kind: str, hours: int, count: Column, baseline: Column | None = None) -> Column:
    """'User has 150 events in the last 1 day', with a comparison when a baseline is given."""
    name = kind.replace("_", " ").capitalize()
    said = F.concat(F.lit(f"{name} has "), count.cast("long").cast("string"), F.lit(f" events in the {window_words(hours)}"))
    if baseline is None:
        return said
    factor = count / baseline
    versus = F.concat(F.lit(" ("), F.format_string("%.1f", factor), F.lit("x the usual "), F.format_string("%.0f", baseline), F.lit(")"))
    return F.when(baseline > 0, F.concat(said, versus)).otherwise(said)


def rate_sentence(rate: Column) -> Column:
    return F.concat(F.lit("success rate is "), F.round(rate * 100).cast("long").cast("string"), F.lit("%"))


def describe_state(df: DataFrame, kind: str, hours: int, baseline: str | None = None) -> DataFrame:
    """Add `state_text` from the trailing count and success rate of an entity kind."""
    count, rate = F.col(f"{kind}_{hours}h_event_count"), F.col(f"{kind}_{hours}h_success_rate")
    base = F.col(baseline) if baseline else None
    return df.withColumn("state_text", F.concat_ws("; ", count_sentence(kind, hours, count, base), rate_sentence(rate)))


def timeline(events: DataFrame, points: int = TIMELINE, limits: SkewLimits = DEFAULT_LIMITS) -> DataFrame:
    """Add each event's `timeline`: itself and up to `points` events of the entity before it."""
    rows = events.withColumn("_t", epoch_micros("ts"))
    few = SkewLimits(limits.segment_rows, limits.segment_rows, limits.local_table_rows)
    hot = find_hot(rows, ["entity_id"], "_t", 86_400, few)
    rows, part = with_tail_rows(rows, hot, ["entity_id"], ["_t", "event_id"], ["ts", "event_type", "status"], points)
    w = Window.partitionBy(*part).orderBy("_t", "event_id").rowsBetween(-points, 0)
    entry = F.struct(iso_utc("ts").alias("at"), "event_type", "status")
    return (
        rows.withColumn("timeline", F.collect_list(entry).over(w))
        .filter(~F.col("_ghost"))
        .select(*events.columns, "timeline")
    )


def evidence_pack(explained: DataFrame, events: DataFrame, points: int = TIMELINE) -> DataFrame:
    """Explained anomalies as one struct each: score, summary, contributors and recent events."""
    recent = timeline(events, points).select("source_dataset", "event_id", "timeline")
    joined = explained.join(recent, ["source_dataset", "event_id"], "left")
    return joined.select(
        "event_id",
        "entity_id",
        F.struct(
            F.col("summary"),
            F.col("top_contributors"),
            F.col("timeline"),
        ).alias("evidence"),
    )
