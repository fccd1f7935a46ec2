"""Statistical baselines per signal (source and entity type), and scores of deviation from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.functions.expressions import day_of_week, hour_of_day
from riskloom.operators.reports import top_anomalies
from riskloom.plans.ranks import statistics
from riskloom.plans.sampling import sample_per_group
from riskloom.plans.small import broadcast_if_small

SIGNAL = ["source_dataset", "entity_type"]
# Percentiles of a profile, and how many values a feature needs (more than).
PERCENTILES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
MIN_VALUES = 10
STATS = ["mean", "std", *PERCENTILES, "iqr", "min", "max"]


def learn_profile(
    features: DataFrame,
    sample_size: int | None = None,
    columns: Sequence[str] = tuple(C.BASELINE_FEATURES),
    stored: bool = False,
) -> DataFrame:
    """One row per (signal, feature) with more than ten values.

    All rows count; quantiles come from distributed ranks. `stored` features are read as they are, others are written first. Only a caller that asks for a sample gets one:
    at most `sample_size` rows of each signal (smallest event-id hash), learnt from in the same way.
    """
    present = [c for c in columns if c in features.columns]
    known = features.filter(F.col("source_dataset").isNotNull())
    if sample_size is not None:
        known = sample_per_group(known, SIGNAL, sample_size)
    return (
        statistics(known, SIGNAL, present, PERCENTILES, stored and sample_size is None)
        .filter(F.col("n") > MIN_VALUES)
        .withColumn("iqr", F.col("p75") - F.col("p25"))
        .select(F.concat_ws("::", *SIGNAL).alias("signal_id"), *SIGNAL, "feature", "n", *STATS)
    )


def learn_calendar(features: DataFrame, sample_size: int | None = None) -> DataFrame:
    """Per signal: share of events per hour of day (24) and weekday (7, Sunday first), and row count."""
    known = features.filter(F.col("source_dataset").isNotNull())
    if sample_size is not None:
        known = sample_per_group(known, SIGNAL, sample_size)
    h, d = hour_of_day("ts"), day_of_week("ts")
    counted = known.groupBy(*SIGNAL).agg(
        F.count("*").alias("sample_size"),
        F.array(*[F.count_if(h == i) for i in range(24)]).alias("_h"),
        F.array(*[F.count_if(d == i) for i in range(7)]).alias("_d"),
    )
    share = lambda c: F.transform(c, lambda x: x / F.col("sample_size"))
    return counted.select(
        F.concat_ws("::", *SIGNAL).alias("signal_id"),
        *SIGNAL,
        "sample_size",
        share(F.col("_h")).alias("hourly_counts"),
        share(F.col("_d")).alias("daily_counts"),
    )


# Score rules as SQL text over operand texts: one parse per feature instead of a Column per operator.


def zscore(v: str, mean: str, std: str) -> str:
    return f"CASE WHEN {v} IS NULL OR {std} = 0 THEN 0D ELSE abs(({v} - {mean}) / {std}) END"


def iqr_score(v: str, low: str, high: str, iqr: str) -> str:
    """Distance beyond the whiskers `low` and `high` in units of the interquartile range, at most 5."""
    return (
        f"CASE WHEN {v} IS NULL OR {iqr} = 0 THEN 0D"
        f" ELSE least(greatest({low} - {v}, {v} - {high}, 0D) / {iqr}, 5D) END"
    )


def percentile_score(v: str, at: str = "") -> str:
    """Band of a value between the profile percentiles p1..p99, whose names follow the prefix `at`."""
    bands = [("p1", "p99", "1D"), ("p5", "p95", "0.7D"), ("p25", "p75", "0.3D")]
    cases = " ".join(f"WHEN {v} <= {at}{lo} OR {v} >= {at}{hi} THEN {points}" for lo, hi, points in bands)
    return f"CASE {cases} ELSE 0D END"


def combined_score(z: str, iqr: str, pct: str) -> str:
    return f"0.4D * least(({z}) / 5, 1D) + 0.3D * least(({iqr}) / 3, 1D) + 0.3D * ({pct})"


# Statistics a score needs; the whiskers are worked out once per profile row.
_SCORING = ["mean", "std", "iqr", "p1", "p5", "p25", "p75", "p95", "p99"]


def whiskers() -> tuple[str, str]:
    return "p25 - 1.5D * iqr", "p75 + 1.5D * iqr"


def wide_profile(profile: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per signal, one struct of scoring statistics per feature."""
    low, high = whiskers()
    stats = F.struct(*_SCORING, F.expr(low).alias("low"), F.expr(high).alias("high"))
    return profile.groupBy(*SIGNAL).agg(
        *[F.max(F.when(F.col("feature") == c, stats)).alias(f"_s_{c}") for c in columns]
    )


def score_events(
    features: DataFrame,
    profile: DataFrame,
    columns: Sequence[str] = tuple(C.BASELINE_FEATURES),
    parts: bool = False,
) -> DataFrame:
    """Add baseline_score (and its mean and maximum); `parts` also adds each feature's z and score.

    Null features are skipped; a row without profile or features scores 0.
    """
    present = [c for c in columns if c in features.columns]
    side = broadcast_if_small(wide_profile(profile, present))
    rows = features.join(side, SIGNAL, "left")
    z, combined = {}, {}
    usable = {c: f"(`{c}` IS NOT NULL AND `_s_{c}` IS NOT NULL)" for c in present}
    for c in present:
        v, at = f"CAST(`{c}` AS DOUBLE)", f"`_s_{c}`."
        zc = zscore(v, f"{at}mean", f"{at}std")
        ic = iqr_score(v, f"{at}low", f"{at}high", f"{at}iqr")
        z[c] = f"CASE WHEN {usable[c]} THEN {zc} END AS `{c}_zscore`"
        combined[c] = f"CASE WHEN {usable[c]} THEN {combined_score(zc, ic, percentile_score(v, at))} END AS `{c}_combined`"
    n = " + ".join(f"if({usable[c]}, 1, 0)" for c in present)
    rows = rows.selectExpr("*", f"{n} AS _n", *[z[c] for c in present if parts], *combined.values())
    scores = [f"`{c}_combined`" for c in present]
    total = " + ".join(f"coalesce({s}, 0D)" for s in scores)
    rows = rows.selectExpr("*", f"{total} AS _total", f"greatest({', '.join([*scores, scores[0]])}) AS baseline_score_max")
    extra = [f"{c}_{k}" for c in present for k in ("zscore", "combined")] if parts else []
    return rows.selectExpr("*", "CASE WHEN _n > 0 THEN _total / _n END AS baseline_score_mean").selectExpr(
        *[f"`{c}`" for c in [*features.columns, *extra]],
        "baseline_score_mean",
        "baseline_score_max",
        "coalesce(0.6D * baseline_score_mean + 0.4D * baseline_score_max, 0D) AS baseline_score",
    )


def baseline_anomalies(
    features: DataFrame, profile: DataFrame, threshold: float = 0.5, top_n: int | None = None
) -> DataFrame:
    return top_anomalies(score_events(features, profile), "baseline_score", threshold, top_n)
