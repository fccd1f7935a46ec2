"""Point-in-time features, as-of lookups and label joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import (
    CHECKS,
    CALENDAR,
    SINCE,
    WAVES,
    WINDOWED,
    feature_frame,
    feature_select,
    micros,
    query,
    rounded,
    with_features,
    with_labels,
    with_raw,
)
from registry.fixtures import labels, r6, raw_events
from riskloom.operators import asof
from riskloom.operators import features as feat
from riskloom.operators import labels as lab
from riskloom.plans.hotkeys import SkewLimits

AS_OF = "2024-01-20 12:00:00"


def features(spark, d, with_label_times=False):
    return feat.build_features(raw_events(spark, d), labels(spark, d) if with_label_times else None)


def _group(name: str, columns: list[str]) -> None:
    """Register one slice of the feature table."""

    @query(name, with_features(f"select event_id, {feature_select(columns)} from feat"))
    def run(spark, d):
        return feature_frame(features(spark, d), columns)


_group("feat_event_counts", ["event_count_1h", "event_count_24h"])
_group("feat_distinct_proxy", ["distinct_event_types_24h_proxy"])
_group("feat_metric_stats", ["metric_mean_24h", "metric_std_24h"])
_group("feat_metric_z", ["metric_z_24h"])
_group("feat_delta", ["delta_1"])
_group("feat_pct_change", ["pct_change_1h", "pct_change_24h"])
_group("feat_time_since_last", ["time_since_last_event_seconds"])
_group("feat_diff1", ["amount_diff_1"])
_group("feat_diff2", ["amount_diff_2"])
_group("feat_calendar", CALENDAR)
_group("feat_fourier", WAVES)


@query(
    "feat_distinct_exact",
    with_raw(
        """select a.event_id, count(distinct b.event_type) as distinct_event_types_24h from raw a join raw b
 on a.entity_id = b.entity_id and b.ts <= a.ts and b.ts >= a.ts - interval 24 hours group by a.event_id"""
    ),
)
def feat_distinct_exact(spark, d):
    return feat.distinct_in_window(raw_events(spark, d)).select("event_id", "distinct_event_types_24h")


_SINCE_SQL = ", ".join(
    f"""(select (epoch_us(e.ts) - max(epoch_us(l.ts_start))) / 1e6 from lab l
 where l.scope_id = e.entity_id and l.label_type = '{t}' and l.ts_start < e.ts) as time_since_last_{t}_seconds"""
    for t in ("fraud", "anomaly")
)


@query(
    "feat_since_label",
    with_labels(
        f"select event_id, {feature_select(SINCE)} from since",
        f"since as (select e.event_id, {_SINCE_SQL} from raw e)",
    ),
)
def feat_since_label(spark, d):
    return feature_frame(features(spark, d, True), SINCE)


@query(
    "asof_label",
    with_labels(
        f"select event_id, {feature_select(SINCE)} from since",
        f"since as (select e.event_id, {_SINCE_SQL} from raw e)",
    ),
)
def asof_label(spark, d):
    return feature_frame(asof.asof_label(raw_events(spark, d), labels(spark, d)), SINCE)


_ALL = [*WINDOWED, *CALENDAR, *WAVES, *SINCE]


@query(
    "features_full",
    with_features(
        f"select event_id, {feature_select(_ALL)} from (select e.*, {_SINCE_SQL} from feat e)", labels=True
    ),
)
def features_full(spark, d):
    return feature_frame(features(spark, d, True), _ALL)


# The plan for dense entities under the same checks: almost every entity counts as dense, in short segments.
CROWDED = SkewLimits(window_rows=2, segment_rows=40)


@query("features_full_dense", CHECKS["features_full"])
def features_full_dense(spark, d):
    return feature_frame(feat.build_features(raw_events(spark, d), labels(spark, d), limits=CROWDED), _ALL)


@query("feat_distinct_exact_dense", CHECKS["feat_distinct_exact"])
def feat_distinct_exact_dense(spark, d):
    return feat.distinct_in_window(raw_events(spark, d), limits=CROWDED).select("event_id", "distinct_event_types_24h")


@query(
    "features_asof",
    with_features(
        f"""select event_id, cast(rn as bigint) as rn, {feature_select([*WINDOWED, *CALENDAR])} from
 (select *, row_number() over (partition by entity_id order by ts desc, event_id desc) as rn from feat where ts <= timestamp '{AS_OF}') where rn = 1"""
    ),
)
def features_asof(spark, d):
    """Latest features at a time for every known entity."""
    ev = raw_events(spark, d)
    out = feat.features_asof(ev, AS_OF, ev.select("entity_id"))
    cols = [*WINDOWED, *CALENDAR]
    return feature_frame(out, cols).join(out.select("event_id", F.col("rn").cast("long").alias("rn")), "event_id")


@query(
    "row_number",
    with_raw("select event_id, row_number() over (partition by source_dataset, event_type order by md5(event_id), event_id) as rn from raw qualify rn <= 10"),
)
def row_number(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("source_dataset", "event_type").orderBy(F.md5("event_id"), "event_id")
    out = raw_events(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn <= 10")
    return out.select("event_id", F.col("rn").cast("long").alias("rn"))


_J2 = """(e.entity_id = l.scope_id and e.ts >= l.ts_start and (l.ts_end is null or e.ts <= l.ts_end))
 or (e.ingest_batch_id like 'adversarial%' and e.ingest_batch_id = l.ingest_batch_id and e.entity_id = l.scope_id)"""


@query(
    "label_interval_join",
    with_labels(
        f"""select e.event_id, case when l.label is not null and l.label > 0 then 1 else 0 end as is_anomaly, l.label_type,
 l.label as label_value from raw e left join lab l on {_J2}"""
    ),
)
def label_interval_join(spark, d):
    out = lab.label_interval_join(raw_events(spark, d), labels(spark, d))
    return out.select("event_id", "is_anomaly", "label_type", "label_value")


@query(
    "label_between_join",
    with_labels(
        """select e.event_id, l.label, l.label_type, l.severity from raw e left join lab l
 on e.entity_id = l.scope_id and e.ts between l.ts_start and coalesce(l.ts_end, e.ts)"""
    ),
)
def label_between_join(spark, d):
    out = lab.label_between_join(raw_events(spark, d), labels(spark, d))
    return out.select("event_id", "label", "label_type", "severity")


@query("label_interval_join_dense", CHECKS["label_interval_join"])
def label_interval_join_dense(spark, d):
    """By dyadic nodes of time."""
    out = lab.label_interval_join(raw_events(spark, d), labels(spark, d), CROWDED)
    return out.select("event_id", "is_anomaly", "label_type", "label_value")


@query("label_between_join_dense", CHECKS["label_between_join"])
def label_between_join_dense(spark, d):
    out = lab.label_between_join(raw_events(spark, d), labels(spark, d), CROWDED)
    return out.select("event_id", "label", "label_type", "severity")


LABEL_ANY_SQL = f"""anyl as (select e.event_id, max(case when l.label > 0 then 1 else 0 end) as is_anomaly
 from raw e left join lab l on {_J2} group by e.event_id)"""


@query("label_any", with_labels("select event_id, is_anomaly from anyl", LABEL_ANY_SQL))
def label_any(spark, d):
    return lab.label_any(raw_events(spark, d), labels(spark, d)).select("event_id", "is_anomaly")


@query("label_any_dense", CHECKS["label_any"])
def label_any_dense(spark, d):
    return lab.label_any(raw_events(spark, d), labels(spark, d), CROWDED).select("event_id", "is_anomaly")


@query(
    "cache_upsert",
    with_features(
        f"""select entity_id, epoch_us(ts) as ts, event_count_24h as stored_count, {r6('coalesce(amount, 0) + 1')} as amount_plus_one,
 epoch_us(timestamp '2024-02-02') as computed_at from feat"""
    ),
)
def cache_upsert(spark, d):
    """Every row cached, then cached again later with amounts raised by one."""
    rows = features(spark, d).select("entity_id", "ts", "event_count_24h", "amount")
    old = asof.cache_rows(rows, "2024-02-01 00:00:00")
    raised = rows.withColumn("amount", F.coalesce("amount", F.lit(0.0)) + 1)
    out = asof.cache_upsert(old, asof.cache_rows(raised, "2024-02-02 00:00:00"))
    read = F.from_json("features", "event_count_24h long, amount double")
    out = out.select(
        "entity_id", "ts", read["event_count_24h"].alias("stored_count"), read["amount"].alias("amount_plus_one"), "computed_at"
    )
    return rounded(micros(out, "ts", "computed_at"), ["amount_plus_one"])


@query(
    "cache_lookup",
    with_features(
        f"""select entity_id, max(epoch_us(ts)) as ts, arg_max(event_count_24h, ts) as stored_count from feat
 where ts <= timestamp '{AS_OF}' group by entity_id"""
    ),
)
def cache_lookup(spark, d):
    rows = features(spark, d).select("entity_id", "ts", "event_count_24h")
    out = asof.cache_lookup(asof.cache_rows(rows, "2024-02-01 00:00:00"), AS_OF)
    return micros(out.select("entity_id", "ts", F.get_json_object("features", "$.event_count_24h").cast("long").alias("stored_count")), "ts")
