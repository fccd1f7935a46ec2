"""Summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import (
    CALENDAR,
    SCORE_DIGITS,
    WAVES,
    WINDOWED,
    micros,
    query,
    rounded,
    with_features,
    with_labels,
    with_raw,
    with_scores,
)
from registry.fixtures import labels, r6, raw_events
from registry.q_features import features
from riskloom import config as C
from riskloom.operators import baseline, reports
from riskloom.operators import labels as lab
from riskloom.plans.lineage import cut_lineage
from riskloom.schema import EVENT_COLUMNS


def scoring_features(spark, d):
    """Features cut to the digits the checks use."""
    f = features(spark, d)
    return f.withColumns({c: F.round(F.col(c).cast("double"), SCORE_DIGITS) for c in C.BASELINE_FEATURES})


# What consumers of scores read: written once, so that filtering and ranking by a score neither
# recompute it nor carry its long expression through the optimizer.
SCORED_COLUMNS = [
    "event_id", "ts", "entity_type", "entity_id", "event_type", "source_dataset", "ingest_batch_id", "metric_z_24h",
]


def scores(spark, d, parts=False, every_feature=True):
    """Events scored against profiles learnt from the same, once written, feature table: of all its columns, or
    of those that scores and their consumers read."""
    f = scoring_features(spark, d)
    if not every_feature:
        f = f.select(*dict.fromkeys([*SCORED_COLUMNS, *C.BASELINE_FEATURES]))
    f = cut_lineage(f, "features")
    return baseline.score_events(f, baseline.learn_profile(f, stored=True), parts=parts)


def scored(spark, d, every_feature=False):
    """Score table, the score cut to the digits the checks use."""
    s = scores(spark, d, every_feature=every_feature).withColumn("baseline_score", F.round("baseline_score", SCORE_DIGITS))
    return cut_lineage(s if every_feature else s.select(*SCORED_COLUMNS, "baseline_score"), "scored")


@query(
    "source_summary",
    with_raw(
        """select source_dataset, count(*) as event_count, count(distinct entity_id) as entity_count,
 min(epoch_us(ts)) as first_event, max(epoch_us(ts)) as last_event from raw group by source_dataset"""
    ),
)
def source_summary(spark, d):
    return micros(reports.source_summary(raw_events(spark, d)), "first_event", "last_event")


@query(
    "value_counts",
    with_raw(
        """select 'entity_type' as column_name, entity_type as value, count(*) as n from raw group by all
union all select 'status', status, count(*) from raw group by all
union all select * from (select 'event_type', event_type, count(*) as n from raw group by all order by n desc, event_type limit 10)"""
    ),
)
def value_counts(spark, d):
    ev = raw_events(spark, d)
    named = [(c, reports.value_counts(ev, c, 10 if c == "event_type" else None)) for c in ("entity_type", "status", "event_type")]
    return reports.union_all([t.select(F.lit(c).alias("column_name"), "value", "n") for c, t in named])


@query(
    "amount_summary",
    with_raw(
        f"""select count(*) as row_count, count(amount) as amount_count, {r6("avg(amount)")} as amount_mean,
 {r6("min(amount)")} as amount_min, {r6("max(amount)")} as amount_max, min(epoch_us(ts)) as first_event, max(epoch_us(ts)) as last_event from raw"""
    ),
)
def amount_summary(spark, d):
    out = reports.amount_summary(raw_events(spark, d))
    return rounded(micros(out, "first_event", "last_event"), ["amount_mean", "amount_min", "amount_max"])


_PROFILE_PARTS = "\nunion all ".join(
    f"""select '{c}' as column_name, count(*) - count({c}) as null_count,
 case when count(distinct {c}) < 20 then count(distinct {c}) end as unique_count,
 case when count(distinct {c}) between 1 and 10 then array_to_string(list_sort(list(distinct cast({c} as varchar)) filter ({c} is not null)), '|') end as values_list from raw"""
    for c in EVENT_COLUMNS
    if c not in ("ts", "amount")
)


@query("column_profile", with_raw(_PROFILE_PARTS))
def column_profile(spark, d):
    return reports.column_profile(raw_events(spark, d).drop("ts", "amount"))


_FEATURE_OUT = [*WINDOWED, *CALENDAR, *WAVES]


@query(
    "null_report",
    with_features(
        "select column_name, null_count, round(null_count * 100.0 / n, 2)::double as null_pct from ("
        + "\nunion all ".join(
            f"select '{c}' as column_name, count(*) - count({c}) as null_count, count(*) as n from feat"
            for c in [*EVENT_COLUMNS, *_FEATURE_OUT]
        )
        + ") where null_count > 0"
    ),
)
def null_report(spark, d):
    return reports.null_report(features(spark, d))


_STATS_SQL = ", ".join(
    [
        "count(v) as n",
        *[
            f"{r6(e, 3)} as {n}"
            for n, e in (
                ("mean", "avg(v)"), ("std", "stddev_samp(v)"), ("min", "min(v)"), ("p25", "quantile_cont(v, 0.25)"),
                ("p50", "quantile_cont(v, 0.5)"), ("p75", "quantile_cont(v, 0.75)"), ("max", "max(v)"),
            )
        ],
    ]
)


@query(
    "describe_features",
    with_features(
        f"select feature, {_STATS_SQL} from ("
        + "\nunion all ".join(f"select '{c}' as feature, cast({c} as double) as v from feat" for c in _FEATURE_OUT)
        + ") group by feature"
    ),
)
def describe_features(spark, d):
    out = reports.describe(features(spark, d), _FEATURE_OUT)
    return rounded(out, ["mean", "std", "min", "p25", "p50", "p75", "max"], 3)


@query(
    "label_distribution",
    with_labels(
        """select l.label, count(*) as n from raw e left join lab l
 on e.entity_id = l.scope_id and e.ts between l.ts_start and coalesce(l.ts_end, e.ts) group by l.label"""
    ),
)
def label_distribution(spark, d):
    return reports.label_distribution(lab.label_between_join(raw_events(spark, d), labels(spark, d)))


@query("distinct_signals", with_raw("select distinct source_dataset, entity_type from raw"))
def distinct_signals(spark, d):
    return reports.distinct_signals(raw_events(spark, d))


def _newest(c: str) -> str:
    return f"arg_max({c}, (epoch_us(ts), event_id)) filter ({c} is not null)"


@query(
    "first_per_group",
    with_raw(
        f"""select entity_id, {_newest('merchant_id')} as merchant_id, {_newest('api_client_id')} as api_client_id,
 {_newest('error_code')} as error_code, {r6(_newest('amount'))} as amount, max(epoch_us(ts)) as ts from raw group by entity_id"""
    ),
)
def first_per_group(spark, d):
    cols = ["entity_id", "event_id", "ts", "merchant_id", "api_client_id", "error_code", "amount"]
    out = reports.first_per_entity(raw_events(spark, d).select(*cols))
    return rounded(micros(out, "ts"), ["amount"]).drop("event_id")


@query(
    "entity_span",
    with_raw("select entity_id, min(epoch_us(ts)) as ts_start, max(epoch_us(ts)) as ts_end from raw group by entity_id"),
)
def entity_span(spark, d):
    return micros(reports.entity_span(raw_events(spark, d)), "ts_start", "ts_end")


@query(
    "score_histogram",
    with_scores(
        """select source_dataset, cast(least(floor(round(baseline_score, 9) * 50), 49) as integer) as bin, count(*) as n from scored group by all"""
    ),
)
def score_histogram(spark, d):
    return reports.score_histogram(scored(spark, d))


def _quartile_sql(by: str) -> str:
    return with_scores(
        f"""select {by}, count(baseline_score) as n, {r6('min(baseline_score)')} as min, {r6('max(baseline_score)')} as max,
 {r6('avg(baseline_score)')} as mean, {r6('quantile_cont(baseline_score, 0.25)')} as p25,
 {r6('quantile_cont(baseline_score, 0.5)')} as p50, {r6('quantile_cont(baseline_score, 0.75)')} as p75 from scored group by {by}"""
    )


@query("score_quartiles_by_source", _quartile_sql("source_dataset"))
def score_quartiles_by_source(spark, d):
    out = reports.score_quartiles(scored(spark, d), "baseline_score", "source_dataset")
    return rounded(out, ["min", "max", "mean", "p25", "p50", "p75"])


@query("score_quartiles_by_type", _quartile_sql("entity_type"))
def score_quartiles_by_type(spark, d):
    out = reports.score_quartiles(scored(spark, d), "baseline_score", "entity_type")
    return rounded(out, ["min", "max", "mean", "p25", "p50", "p75"])


@query(
    "score_distribution",
    with_scores(
        f"""select 'baseline_score' as feature, count(*) as n, {r6('avg(baseline_score)', 3)} as mean, {r6('stddev_samp(baseline_score)', 3)} as std,
 {r6('min(baseline_score)', 3)} as min, {r6('quantile_cont(baseline_score, 0.25)', 3)} as p25, {r6('quantile_cont(baseline_score, 0.5)', 3)} as p50,
 {r6('quantile_cont(baseline_score, 0.75)', 3)} as p75, {r6('max(baseline_score)', 3)} as max from scored"""
    ),
)
def score_distribution(spark, d):
    out = reports.describe(scored(spark, d), ["baseline_score"])
    return rounded(out, ["mean", "std", "min", "p25", "p50", "p75", "max"], 3)


@query(
    "anomaly_rate",
    with_scores(
        f"""select count(*) as total, count(*) filter (baseline_score >= 0.5) as anomalies,
 {r6('count(*) filter (baseline_score >= 0.5) / count(*)')} as rate from scored"""
    ),
)
def anomaly_rate(spark, d):
    return rounded(reports.anomaly_rate(scored(spark, d)), ["rate"])


@query(
    "union_frames",
    with_raw("select source_dataset, count(*) * 2 as n, count(error_code) as coded from raw group by source_dataset"),
)
def union_frames(spark, d):
    ev = raw_events(spark, d)
    both = reports.union_all([ev, ev.drop("error_code")])
    return both.groupBy("source_dataset").agg(F.count("*").alias("n"), F.count("error_code").alias("coded"))


@query("schema_report")
def schema_report(spark, d):
    return reports.schema_report(raw_events(spark, d))

