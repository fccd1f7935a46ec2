"""From an anomaly's signal to its business impact: category, cost, action, escalation."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import config as C

RULE_SCHEMA = (
    "position int, scenario string, source_dataset string, entity_type string, category string, risk_level string,"
    " estimated_cost double, cost_unit string, recommended_action string, compliance_flags array<string>,"
    " escalation_path string, escalation_sla_minutes int, escalation_contact string"
)
IMPACT_COLUMNS = [
    "scenario", "category", "risk_level", "estimated_cost", "cost_unit", "recommended_action",
    "compliance_flags", "escalation_path", "escalation_sla_minutes", "escalation_contact",
]
LEVELS = ["critical", "high", "medium", "low"]
_COST_UNITS = ["per_incident", "per_minute", "per_day"]


def rules(
    spark: SparkSession,
    scenarios: dict[str, Any] | None = None,
    paths: dict[str, Any] | None = None,
) -> DataFrame:
    """Scenario settings as one flat row each, in matching order, gaps filled with the defaults."""
    scenarios = C.SCENARIOS if scenarios is None else scenarios
    paths = C.ESCALATION_PATHS if paths is None else paths
    rows = []
    for position, (name, scenario) in enumerate(scenarios.items()):
        impact = scenario.get("business_impact")
        if not impact:
            continue
        unit = next((u for u in _COST_UNITS if f"estimated_cost_{u}" in impact), None)
        path = paths.get(impact.get("escalation_path", ""), {})
        rows.append(
            (
                position,
                name,
                scenario.get("source_dataset"),
                scenario.get("entity_type"),
                impact.get("category", "Unknown"),
                impact.get("risk_level", "medium"),
                float(impact[f"estimated_cost_{unit}"]) if unit else 0.0,
                unit or "per_incident",
                impact.get("recommended_action", "Investigate"),
                list(impact.get("compliance_flags", [])),
                impact.get("escalation_path", ""),
                int(path.get("response_sla_minutes", 60)),
                path.get("contact", "unknown"),
            )
        )
    return spark.createDataFrame(rows, RULE_SCHEMA)


def first_match(rule_rows: DataFrame) -> DataFrame:
    """The rule that answers for each (source, entity type): the earliest one."""
    rest = [c for c in rule_rows.columns if c not in ("source_dataset", "entity_type")]
    return (
        rule_rows.groupBy("source_dataset", "entity_type")
        .agg(F.min_by(F.struct(*rest), "position").alias("_r"))
        .select("source_dataset", "entity_type", "_r.*")
    )


def attach_impact(df: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """Rows with the impact of their signal, nulls where no rule matches.

    The rule table is configuration, a handful of rows, hence the broadcast.
    """
    side = first_match(rule_rows).select("source_dataset", "entity_type", *IMPACT_COLUMNS)
    return df.join(F.broadcast(side), ["source_dataset", "entity_type"], "left")


def match_scenario(df: DataFrame, rule_rows: DataFrame) -> DataFrame:
    side = first_match(rule_rows).select("source_dataset", "entity_type", F.col("scenario").alias("scenario_match"))
    return df.join(F.broadcast(side), ["source_dataset", "entity_type"], "left")


def all_impacts(rule_rows: DataFrame, by: str = "match") -> DataFrame:
    """Impact per scenario: by `match` it is that of the first rule with the same signal, by
    `scenario` its own."""
    if by == "scenario":
        return rule_rows.select(F.col("scenario").alias("name"), "source_dataset", "entity_type", *IMPACT_COLUMNS)
    names = rule_rows.select(F.col("scenario").alias("name"), "source_dataset", "entity_type")
    return attach_impact(names, rule_rows)


def risk_summary(rule_rows: DataFrame, by: str = "match") -> DataFrame:
    """Scenario count per risk level, all four levels present."""
    counts = all_impacts(rule_rows, by).agg(
        *[F.count_if(F.col("risk_level") == level).alias(level) for level in LEVELS]
    )
    pairs = F.array(*[F.struct(F.lit(x).alias("risk_level"), F.col(x).alias("scenarios")) for x in LEVELS])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def cost_label(cost: Column | str = "estimated_cost", unit: Column | str = "cost_unit") -> Column:
    cost = F.col(cost) if isinstance(cost, str) else cost
    unit = F.col(unit) if isinstance(unit, str) else unit
    per = F.when(unit == "per_minute", "minute").when(unit == "per_day", "day").otherwise("incident")
    return F.concat(F.lit("$"), F.format_string("%.0f", cost), F.lit("/"), per)


def exposure(anomalies: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """Anomalies, summed cost and tightest response time per risk level."""
    return (
        attach_impact(anomalies, rule_rows)
        .filter(F.col("risk_level").isNotNull())
        .groupBy("risk_level")
        .agg(
            F.count("*").alias("anomalies"),
            F.sum("estimated_cost").alias("estimated_cost"),
            F.min("escalation_sla_minutes").alias("tightest_sla_minutes"),
        )
    )
