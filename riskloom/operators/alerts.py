"""From scores to alerts: severity, repeat suppression, daily budget, queries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.functions.expressions import MICROS, epoch_micros, micros_to_ts
from riskloom.plans.hotkeys import SkewLimits, find_hot, running
from riskloom.plans.lineage import cut_lineage
from riskloom.plans.sampling import top_per_group
from riskloom.plans.small import broadcast_if_small, has_rows


def severity(score: Column | str) -> Column:
    """Name of the highest threshold reached; null below all."""
    s = F.col(score) if isinstance(score, str) else score
    out = F.lit(None).cast("string")
    for name, threshold in sorted(C.SEVERITY_THRESHOLDS.items(), key=lambda kv: kv[1]):
        out = F.when(s >= threshold, name).otherwise(out)
    return out


def make_alerts(scored: DataFrame, score: str = "baseline_score") -> DataFrame:
    """Scored events that reach the lowest severity."""
    lowest = min(C.SEVERITY_THRESHOLDS.values())
    return (
        scored.filter(F.col(score) >= lowest)
        .withColumn("severity", severity(score))
        .select("event_id", "ts", "entity_type", "entity_id", "source_dataset", F.col(score).alias("score"), "severity")
    )


# An entity with more distinct alert times than this is resolved by pointer doubling.
FOLD_ROWS = 2_000


def dedup_alerts(
    alerts: DataFrame, window_hours: int = C.DEDUP_WINDOW_HOURS, fold_rows: int = FOLD_ROWS
) -> DataFrame:
    """Alerts left after suppressing repeats of an entity within the window of its last kept alert.

    Only distinct (entity, time) pairs take part; among alerts at one time the smallest event_id
    stands for all. Entities with few alerts are folded in order; crowded ones follow their
    next-kept pointers in doubling steps, so no entity's history is gathered in one place.
    """
    width = window_hours * 3600 * MICROS
    alerts = cut_lineage(alerts, "alerts")  # read several times below
    times = alerts.select("entity_id", epoch_micros("ts").alias("_t")).distinct()
    sizes = times.groupBy("entity_id").agg(F.count("*").alias("_n"))
    crowded = broadcast_if_small(sizes.filter(F.col("_n") > fold_rows).select("entity_id"))
    few = times.join(crowded, "entity_id", "left_anti")

    def step(acc, t):
        keep = acc["last"].isNull() | (t - acc["last"] >= width)
        return F.struct(
            F.when(keep, t).otherwise(acc["last"]).alias("last"),
            F.when(keep, F.concat(acc["kept"], F.array(t))).otherwise(acc["kept"]).alias("kept"),
        )

    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("kept"))
    kept = (
        few.groupBy("entity_id")
        .agg(F.sort_array(F.collect_list("_t")).alias("_ts"))
        .select("entity_id", F.explode(F.aggregate("_ts", start, step)["kept"]).alias("_t"))
    )
    if has_rows(crowded):
        kept = kept.unionByName(_follow(times.join(crowded, "entity_id", "left_semi"), width, fold_rows))
    w_key = ["entity_id", "_t"]
    chosen = alerts.withColumn("_t", epoch_micros("ts")).join(kept, w_key, "left_semi")
    return top_per_group(chosen, w_key, [F.asc("event_id")], 1).drop("_t")


def _follow(times: DataFrame, width: int, rows: int) -> DataFrame:
    """Kept times of crowded entities: start at the first, jump to the first time >= t + width."""
    probes = times.select("entity_id", (-(F.col("_t") + width)).alias("_t"), F.lit(1).alias("_kind"), F.col("_t").alias("_of"))
    points = times.select(
        "entity_id", (-F.col("_t")).alias("_t"), F.lit(0).alias("_kind"), (-F.col("_t")).alias("_m")
    )
    both = points.unionByName(probes, allowMissingColumns=True)
    limit = max(rows, 1)
    hot = find_hot(both, ["entity_id"], "_t", 86_400, SkewLimits(limit, max(limit, 1_000_000)))
    # In reversed time the nearest later point is the running maximum of the negated time.
    jumps = cut_lineage(
        running(both, hot, ["entity_id"], maxes=["_m"])
        .filter(F.col("_of").isNotNull() & F.col("_m").isNotNull())
        .select("entity_id", F.col("_of").alias("_t"), (-F.col("_m")).alias("_to"))
    )
    reached = times.groupBy("entity_id").agg(F.min("_t").alias("_t"))
    span = times.groupBy("entity_id").agg((F.max("_t") - F.min("_t")).alias("s")).agg(F.max("s")).first()[0] or 0
    rounds = max(math.ceil(math.log2(span // width + 2)), 1)
    for i in range(rounds):
        onward = reached.join(jumps, ["entity_id", "_t"]).select("entity_id", F.col("_to").alias("_t"))
        reached = cut_lineage(reached.unionByName(onward).distinct())
        if i + 1 < rounds:
            second = jumps.select("entity_id", F.col("_t").alias("_to"), F.col("_to").alias("_end"))
            jumps = cut_lineage(jumps.join(second, ["entity_id", "_to"]).select("entity_id", "_t", F.col("_end").alias("_to")))
    return reached


def apply_budget(alerts: DataFrame, per_day: int = C.DAILY_ALERT_BUDGET) -> DataFrame:
    """At most `per_day` alerts per calendar day, highest score first."""
    day = alerts.withColumn("_day", F.to_date("ts"))
    return top_per_group(day, ["_day"], [F.desc("score"), F.asc("event_id")], per_day).drop("_day")


def query_alerts(alerts: DataFrame, start=None, end=None, severities=None, entity_ids=None) -> DataFrame:
    if start is not None:
        alerts = alerts.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        alerts = alerts.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    if severities:
        alerts = alerts.filter(F.col("severity").isin(list(severities)))
    if entity_ids:
        alerts = alerts.filter(F.col("entity_id").isin(list(entity_ids)))
    return alerts


def alert_volume(alerts: DataFrame, hours: int | None = None, as_of=None) -> DataFrame:
    """Alerts and their mean score by severity and entity type; of the `hours` up to `as_of` (the last alert), if given."""
    if hours is not None:
        end = F.lit(as_of).cast("timestamp") if as_of is not None else F.lit(alerts.agg(F.max("ts")).first()[0]).cast("timestamp")
        alerts = alerts.filter((F.col("ts") > end - F.make_dt_interval(hours=F.lit(hours))) & (F.col("ts") <= end))
    return alerts.groupBy("severity", "entity_type").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"))
