"""Labelled synthetic events: real entities as templates, one row-local expansion per scenario."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.functions.expressions import (
    MICROS,
    epoch_micros,
    exponential,
    hash_order,
    micros_to_ts,
    stable_event_id,
    standard_normal,
    uniform,
)
from riskloom.operators.reports import first_per_entity
from riskloom.plans.sampling import top_per_group
from riskloom.schema import LABELS, RAW_EVENTS, conform

# Pattern defaults, floor of normal amounts, event types that carry an amount.
DEFAULT_COUNT, DEFAULT_WINDOW, DEFAULT_SEVERITY = 10, 3600, 3
AMOUNT_FLOOR = 0.01
PRICED_EVENTS = ["transaction_auth", "metric_observation"]
BATCH_PREFIX = "adversarial_"
# Columns that name an entity of another kind than the event's own.
NAMED_BESIDE = {"merchant": "merchant_id", "api_client": "api_client_id"}
INDEX_BLOCK = 10_000

SCENARIO_SCHEMA = (
    "scenario string, s_source string, s_entity_type string, s_event_type string, s_status string, s_channel string,"
    " label_type string, label_name string, severity int, labelled boolean, n int, window_seconds int,"
    " time_distribution string, hour_low int, hour_high int, silence_hours int, amount_type string, amount_mean double,"
    " amount_std double, amount_value double, amount_values array<double>, spike_baseline double,"
    " spike_multiplier double, drift_start double, drift_end double, drift_noise double"
)


def scenario_table(spark: SparkSession, scenarios: dict[str, Any] | None = None) -> DataFrame:
    """Scenario settings as one flat row each, gaps filled with the defaults."""
    rows = []
    for name, s in (C.SCENARIOS if scenarios is None else scenarios).items():
        pattern = s.get("injection_pattern", {})
        amount = pattern.get("amount_distribution", {"type": "normal", "mean": 100, "std": 30})
        label = s.get("anomaly_label") or {}
        hours = pattern.get("hour_range") or [None, None]
        rows.append(
            (
                name,
                s.get("source_dataset"),
                s.get("entity_type"),
                s.get("event_type"),
                s.get("status", "success"),
                s.get("channel"),
                label.get("label_type", "anomaly"),
                label.get("label", name),
                int(label.get("severity", DEFAULT_SEVERITY)),
                bool(label),
                int(pattern.get("count", DEFAULT_COUNT)),
                int(pattern.get("time_window_seconds", DEFAULT_WINDOW)),
                pattern.get("time_distribution", "uniform"),
                hours[0],
                hours[1],
                int(pattern.get("silence_before_hours", 0)),
                amount.get("type", "normal"),
                float(amount.get("mean", 100)),
                float(amount.get("std", 30)),
                float(amount.get("value", 100)),
                [float(v) for v in amount.get("values", [100, 200, 500])],
                float(amount.get("baseline_mean", 30)),
                float(amount.get("spike_multiplier", 5)),
                float(amount.get("start_value", 30)),
                float(amount.get("end_value", 80)),
                float(amount.get("noise", 5)),
            )
        )
    return spark.createDataFrame(rows, SCENARIO_SCHEMA)


# How strongly a scenario family acts, as a factor on its event rate.
INTENSITY = {"low": 0.5, "medium": 1.0, "high": 2.0}
# Event rates per hour of the three attack families; label and severity as for their kin above.
FAMILIES: dict[str, dict[str, Any]] = {
    "account_takeover": {"entity_type": "user", "event_type": "login", "rate": 20, "label": "account_takeover", "severity": 4},
    "api_abuse": {"entity_type": "api_client", "event_type": "api_call", "rate": 200, "label": "api_abuse", "severity": 3},
    "merchant_abuse": {"entity_type": "merchant", "event_type": "transaction_auth", "rate": 40, "label": "merchant_abuse", "severity": 4},
}


def family_scenario(
    family: str, source_dataset: str, intensity: str = "medium", duration_hours: int = 1, entity_type: str | None = None
) -> dict[str, Any]:
    """Scenario settings of an attack family, ready for `scenario_table`."""
    f = FAMILIES[family]
    return {
        "source_dataset": source_dataset,
        "entity_type": entity_type or f["entity_type"],
        "event_type": f["event_type"],
        "anomaly_label": {"label_type": "fraud", "label": f["label"], "severity": f["severity"]},
        "injection_pattern": {
            "count": max(int(f["rate"] * INTENSITY[intensity] * duration_hours), 1),
            "time_window_seconds": duration_hours * 3600,
            "time_distribution": "random",
        },
    }


def template_entities(
    events: DataFrame, scenarios: DataFrame, per_scenario: int = 5, seed: str = "", whole_row: bool = False
) -> DataFrame:
    """Scenario columns plus, for each scenario, the newest state of `per_scenario` random entities.

    Entities are drawn by hash among those of the scenario's source and type; their newest values
    come from all their events in that source. Merchants and API clients are entities too where an
    event only names them beside its own.
    """
    wanted = F.broadcast(scenarios)  # configuration: a handful of rows
    named = [F.struct(F.lit(kind).alias("entity_type"), F.col(c).alias("entity_id")) for kind, c in NAMED_BESIDE.items()]
    roles = F.array(F.struct("entity_type", "entity_id"), *named)
    roles = F.array_distinct(F.filter(roles, lambda r: r["entity_id"].isNotNull()))
    events = events.withColumn("_role", F.explode(roles)).withColumns({"entity_type": F.col("_role.entity_type"), "entity_id": F.col("_role.entity_id")}).drop("_role")
    members = events.select("source_dataset", "entity_type", "entity_id").distinct()
    candidates = members.join(
        wanted, (F.col("source_dataset") == F.col("s_source")) & (F.col("entity_type") == F.col("s_entity_type"))
    ).select(*scenarios.columns, "entity_id")
    drawn = top_per_group(candidates, ["scenario"], [hash_order("entity_id", seed), F.col("entity_id")], per_scenario)
    # At most scenarios x per_scenario rows, both configured.
    names = drawn.select(F.col("s_source").alias("source_dataset"), F.col("s_entity_type").alias("entity_type"), "entity_id").distinct()
    mine = events.join(F.broadcast(names), ["source_dataset", "entity_type", "entity_id"], "left_semi")
    parts = mine.withColumn("_entity", F.col("entity_id")).withColumn(
        "entity_id", F.concat_ws("\u0001", "source_dataset", "entity_type", "entity_id")
    )
    newest = first_per_entity(parts, whole_row).drop("entity_id").withColumnRenamed("_entity", "entity_id")
    return drawn.join(
        newest.withColumnRenamed("entity_id", "_e").withColumnRenamed("source_dataset", "_s"),
        (F.col("entity_id") == F.col("_e")) & (F.col("s_source") == F.col("_s")) & (F.col("s_entity_type") == F.col("entity_type")),
    ).drop("_e", "_s")


def _indexed(templates: DataFrame) -> DataFrame:
    """A row `i` of every event to make, in blocks `_b` that are dealt out, so a template may make any number."""
    last = F.floor((F.col("n") - 1) / INDEX_BLOCK).cast("long")
    blocks = templates.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    blocks = blocks.repartition("scenario", "entity_id", "_b")
    upto = F.least(F.col("n") - F.col("_b") * INDEX_BLOCK, F.lit(INDEX_BLOCK)).cast("int") - 1
    start = F.col("_b") * INDEX_BLOCK
    return blocks.withColumn("i", F.explode(F.sequence(start, start + upto)))


def _timed(templates: DataFrame, seed: str) -> DataFrame:
    """Rows of `_indexed` with `_offset`, the micros after the base time, growing with `i`.

    Evenly spaced events follow from their index. The two drawn patterns are sums of exponential gaps: up to
    an event for arrivals (a gap is at most half the window), and their share of the whole sum, which is how
    sorted uniform draws are distributed, for random times. Gaps are whole micros, so sums are exact: within
    a block by a window, across blocks by the blocks' totals.
    """
    n, i, window = F.col("n"), F.col("i"), F.col("window_seconds")
    rows = _indexed(templates)
    arrivals = F.col("time_distribution") == "poisson"
    mean = F.when(arrivals, window * F.lit(float(MICROS)) / n).otherwise(F.lit(float(MICROS)))
    gap = F.round(exponential(f"{seed}/gap", mean, "scenario", "entity_id", "i")).cast("long")
    gap = F.when(arrivals, F.least(gap, (window * (MICROS // 2)).cast("long"))).otherwise(gap)
    drawn = rows.withColumn("_gap", gap)
    who = ["scenario", "entity_id"]
    totals = drawn.groupBy(*who, "_b").agg(F.sum("_gap").alias("_sum"))
    by_block = Window.partitionBy(*who).orderBy("_b")
    before = F.coalesce(F.sum("_sum").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*who, "_b", before.alias("_before"), F.sum("_sum").over(Window.partitionBy(*who)).alias("_all"))
    inside = F.sum("_gap").over(Window.partitionBy(*who, "_b").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    upto = F.col("_before") + F.col("_inside")
    beyond = F.round(exponential(f"{seed}/gap", F.lit(float(MICROS)), "scenario", "entity_id", "n")).cast("long")  # the gap after the last
    even = F.round(i * window * F.lit(float(MICROS)) / F.greatest(n - 1, F.lit(1))).cast("long")
    anywhere = F.floor(upto / (F.col("_all") + beyond) * window * F.lit(float(MICROS))).cast("long")
    offset = (
        F.when(F.col("time_distribution") == "uniform", even)
        .when(F.col("time_distribution") == "random", anywhere)
        .when(arrivals, upto)
    )
    return drawn.withColumn("_inside", inside).join(totals, [*who, "_b"]).withColumn("_offset", offset).drop("_b", "_gap", "_inside", "_before", "_all")


def _amount(seed: str) -> Column:
    i, n = F.col("i"), F.col("n")
    who = (F.col("scenario"), F.col("entity_id"), i)
    draw = standard_normal(f"{seed}/amount", *who)
    kind = F.col("amount_type")
    normal = F.greatest(F.col("amount_mean") + F.col("amount_std") * draw, F.lit(AMOUNT_FLOOR))
    pick = F.floor(uniform(f"{seed}/pick", *who) * F.size("amount_values")).cast("int")
    spike = F.when(i < F.floor(n / 2), F.col("spike_baseline") + draw * 5.0).otherwise(
        F.col("spike_baseline") * F.col("spike_multiplier") + draw * 10.0
    )
    drift = (
        F.col("drift_start")
        + (F.col("drift_end") - F.col("drift_start")) * i / F.greatest(n - 1, F.lit(1))
        + draw * F.col("drift_noise")
    )
    value = (
        F.when(kind == "normal", normal)
        .when(kind == "fixed", F.col("amount_value"))
        .when(kind == "round", F.element_at("amount_values", pick + 1))
        .when(kind == "spike", spike)
        .when(kind == "drift", drift)
    )
    return F.when(F.col("s_event_type").isin(PRICED_EVENTS), value)


def synth_events(templates: DataFrame, run: str) -> DataFrame:
    """Events of every template entity. Random choices depend only on run, scenario, entity and index."""
    who = (F.col("scenario"), F.col("entity_id"), F.col("i"))
    rows = _timed(templates, run)
    at = epoch_micros("ts") + F.col("silence_hours").cast("long") * (3600 * MICROS) + F.col("_offset")
    day, hour, minute = 86_400 * MICROS, 3600 * MICROS, 60 * MICROS
    in_minute = F.pmod(at, F.lit(minute))
    drawn_hour = F.col("hour_low") + F.floor(uniform(f"{run}/hour", *who) * (F.col("hour_high") - F.col("hour_low") + 1))
    drawn_minute = F.floor(uniform(f"{run}/minute", *who) * 60)
    shifted = at - F.pmod(at, F.lit(day)) + drawn_hour * hour + drawn_minute * minute + in_minute
    note = F.to_json(F.struct(F.lit(True).alias("adversarial"), "scenario", F.lit(run).alias("run_id")))
    return conform(
        rows.select(
            stable_event_id(F.lit("adversarial"), F.lit(run), "scenario", "entity_id", "i").alias("event_id"),
            micros_to_ts(F.when(F.col("hour_low").isNull(), at).otherwise(shifted)).alias("ts"),
            F.coalesce("s_entity_type", "entity_type").alias("entity_type"),
            "entity_id",
            F.coalesce("s_event_type", "event_type").alias("event_type"),
            F.col("s_status").alias("status"),
            _amount(run).alias("amount"),
            "currency", "user_id", "merchant_id", "api_client_id", "device_id",
            "ip_hash", "ua_hash", "endpoint", "error_code",
            F.coalesce("s_channel", "channel").alias("channel"),
            F.col("s_source").alias("source_dataset"),
            F.lit(BATCH_PREFIX + run).alias("ingest_batch_id"),
            note.alias("metadata"),
        ),
        RAW_EVENTS,
    ).withColumn("_scenario", F.get_json_object("metadata", "$.scenario"))


def synth_labels(synthetic: DataFrame, scenarios: DataFrame, run: str) -> DataFrame:
    """One label per scenario and entity, spanning the events made for it."""
    spans = synthetic.groupBy("_scenario", "entity_id").agg(F.min("ts").alias("ts_start"), F.max("ts").alias("ts_end"))
    rows = spans.join(F.broadcast(scenarios.filter("labelled")), F.col("_scenario") == F.col("scenario"))
    note = F.to_json(F.struct("scenario", F.lit(run).alias("run_id"), F.col("label_name").alias("anomaly_type")))
    return conform(
        rows.select(
            "ts_start",
            "ts_end",
            F.col("s_entity_type").alias("label_scope"),
            F.col("entity_id").alias("scope_id"),
            "label_type",
            F.lit(1).alias("label"),
            "severity",
            F.concat(F.lit(BATCH_PREFIX), "scenario").alias("source_dataset"),
            F.lit(BATCH_PREFIX + run).alias("ingest_batch_id"),
            note.alias("metadata"),
        ),
        LABELS,
    )


def inject_all(
    events: DataFrame, run: str, scenarios: dict[str, Any] | None = None, per_scenario: int = 5, seed: str = ""
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(synthetic events, labels, scenario run log) for every scenario in one pass."""
    table = scenario_table(events.sparkSession, scenarios)
    made = synth_events(template_entities(events, table, per_scenario, seed), run)
    labels = synth_labels(made, table, run)
    log = made.groupBy(F.col("_scenario").alias("scenario"), "entity_type").agg(
        F.countDistinct("entity_id").alias("entities_affected"),
        F.count("*").alias("events_created"),
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
    )
    return made.drop("_scenario"), labels, log
