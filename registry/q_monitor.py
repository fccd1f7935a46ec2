"""Alerts, drift, ensembles, entity windows, state, graph, series detectors, narratives."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import micros, query, rounded, with_features, with_labels, with_raw, with_scores
from registry.fixtures import labels, r6, raw_events
from registry.q_explain import WEIGHTS
from registry.q_features import features
from registry.q_reports import scored
from riskloom import config as C
from riskloom.operators import alerts, drift, ensemble, explain, graph, narrate, state, timeseries
from riskloom.operators.entity_windows import KEYS, entity_windows

# --- entity windows ----------------------------------------------------------------------------


def _entity_query(kind: str) -> None:
    hours = C.ENTITY_WINDOW_HOURS[kind]
    key = KEYS[kind]
    windows = ", ".join(
        f"w{h} as (partition by {key} order by ts range between interval {h} hours preceding and current row)" for h in hours
    )
    cols = ", ".join(
        f"count(*) over w{h} as {kind}_{h}h_event_count,"
        f" {r6(f'''sum(case when status = 'success' then 1 else 0 end) over w{h} / count(*) over w{h}''')} as {kind}_{h}h_success_rate"
        for h in hours
    )

    @query(f"entity_windows_{kind}", with_raw(f"select event_id, {cols} from raw where {key} is not null window {windows}"))
    def run(spark, d):
        out = entity_windows(raw_events(spark, d), kind)
        names = [f"{kind}_{h}h_{m}" for h in hours for m in ("event_count", "success_rate")]
        return rounded(out.select("event_id", *names), [n for n in names if n.endswith("rate")])


for _kind in KEYS:
    _entity_query(_kind)


# --- alerts ------------------------------------------------------------------------------------

_SEVERITY_SQL = "case when s >= 0.9 then 'critical' when s >= 0.7 then 'high' when s >= 0.5 then 'medium' when s >= 0.3 then 'low' end"
_ALERTS_CTE = f"""al as materialized (select event_id, ts, epoch_us(ts) as t, entity_id, entity_type, source_dataset, s as score, {_SEVERITY_SQL} as severity
 from (select *, baseline_score as s from scored) where s >= 0.3)"""


def _alerts(spark, d):
    return alerts.make_alerts(scored(spark, d))


@query("severity", with_scores(f"select event_id, {_SEVERITY_SQL} as severity from (select event_id, baseline_score as s from scored)"))
def severity(spark, d):
    return scored(spark, d).select("event_id", alerts.severity("baseline_score").alias("severity"))


@query(
    "alert_dedup",
    with_scores(
        """select event_id from al join kept using (entity_id, t) qualify row_number() over (partition by entity_id, t order by event_id) = 1""",
        _ALERTS_CTE,
        """kept as (select entity_id, min(t) as t from al group by entity_id
 union all select k.entity_id, min(a.t) from kept k join al a on a.entity_id = k.entity_id and a.t >= k.t + 86400000000 group by k.entity_id)""",
    ).replace("with ", "with recursive ", 1),
)
def alert_dedup(spark, d):
    return alerts.dedup_alerts(_alerts(spark, d)).select("event_id")


@query(
    "alert_budget",
    with_scores(
        "select event_id from al qualify row_number() over (partition by cast(ts as date) order by score desc, event_id) <= 100", _ALERTS_CTE
    ),
)
def alert_budget(spark, d):
    return alerts.apply_budget(_alerts(spark, d)).select("event_id")


@query(
    "alert_query",
    with_scores(
        f"""select event_id, severity, {r6('score')} as score from al
 where ts >= timestamp '2024-01-10' and ts <= timestamp '2024-01-25' and severity in ('medium', 'high', 'critical')""",
        _ALERTS_CTE,
    ),
)
def alert_query(spark, d):
    out = alerts.query_alerts(_alerts(spark, d), "2024-01-10 00:00:00", "2024-01-25 00:00:00", ["medium", "high", "critical"])
    return rounded(out.select("event_id", "severity", "score"), ["score"])


@query(
    "alert_volume",
    with_scores(f"select severity, entity_type, count(*) as n, {r6('avg(score)')} as avg_score from al group by all", _ALERTS_CTE),
)
def alert_volume(spark, d):
    return rounded(alerts.alert_volume(_alerts(spark, d)), ["avg_score"])


@query(
    "alert_volume_24h",
    with_scores(
        f"""select severity, entity_type, count(*) as n, {r6('avg(score)')} as avg_score from al where t > (select max(t) from al) - 86400000000 group by all""",
        _ALERTS_CTE,
    ),
)
def alert_volume_24h(spark, d):
    """The day up to the last alert."""
    return rounded(alerts.alert_volume(_alerts(spark, d), hours=24), ["avg_score"])


# --- drift -------------------------------------------------------------------------------------

DRIFT_DAYS = 10  # the events cover one month: the last ten days against the rest
_SHARE_CTES = (
    f"""cur as materialized (select baseline_score as score, epoch_us(ts) > (select max(epoch_us(ts)) from raw) - {DRIFT_DAYS} * 86400000000 as c from scored)""",
    "edges as (" + " union all ".join(f"select quantile_cont(score, {i / 10}) as e from cur where not c" for i in range(1, 10)) + ")",
    "binned as (select c, (select count(*) from edges where cur.score > e) as bin from cur)",
    """share as (select b.bin, coalesce(count(*) filter (not c), 0) / (select count(*) from cur where not c) as p,
 coalesce(count(*) filter (c), 0) / (select count(*) from cur where c) as q from (select unnest(range(10)) as bin) b left join binned using (bin) group by b.bin)""",
)


def _shares(spark, d):
    s = scored(spark, d).select("ts", F.col("baseline_score").alias("score"))
    return drift.bin_shares(drift.split_at(s, DRIFT_DAYS))


@query("drift_bins", with_scores(f"select cast(bin as integer) as bin, {r6('p')} as p, {r6('q')} as q from share", *_SHARE_CTES))
def drift_bins(spark, d):
    return rounded(_shares(spark, d), ["p", "q"])


@query(
    "psi",
    with_scores(
        f"""select {r6('v')} as psi, case when v >= 0.2 then 'major' when v >= 0.1 then 'moderate' else 'stable' end as band from
 (select sum((greatest(p, 1e-6) - greatest(q, 1e-6)) * ln(greatest(p, 1e-6) / greatest(q, 1e-6))) as v from share)""",
        *_SHARE_CTES,
    ),
)
def psi(spark, d):
    return rounded(drift.psi(_shares(spark, d)), ["psi"])


@query(
    "js_divergence",
    with_scores(
        f"""select {r6('v')} as js, v > 0.1 as drifted from (select
 sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end) / 2 + sum(case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2 as v from share)""",
        *_SHARE_CTES,
    ),
)
def js_divergence(spark, d):
    return rounded(drift.js_divergence(_shares(spark, d)), ["js"])


# --- ensembles ---------------------------------------------------------------------------------

_THREE_CTE = """three as (select event_id, least(abs(metric_z_24h) / 5, 1) as a, case when amount is not null then least(abs(pct_change_24h) / 1000, 1) end as b,
 least(time_since_last_event_seconds / 86400, 1) as c from feat)"""
_FOLD = "coalesce({0} * a, 0) + coalesce({1} * b, 0) + coalesce({2} * c, 0)"


@query(
    "ensemble",
    with_features(
        f"""select event_id, {r6(f"({_FOLD.format(0.4, 0.3, 0.3)}) / nullif(case when a is null then 0 else 0.4 end + case when b is null then 0 else 0.3 end + case when c is null then 0 else 0.3 end, 0)")} as weighted_average,
 {r6('greatest(a, b, c)')} as max, {r6('least(a, b, c)')} as min, {r6('list_avg([a, b, c])')} as mean, {r6('list_median([a, b, c])')} as median from three""",
        _THREE_CTE,
    ),
)
def ensemble_(spark, d):
    f = features(spark, d)
    one = F.lit(1.0)
    three = f.select(
        "event_id",
        F.least(F.abs("metric_z_24h") / 5, one).alias("a"),
        F.when(F.col("amount").isNotNull(), F.least(F.abs("pct_change_24h") / 1000, one)).alias("b"),
        F.least(F.col("time_since_last_event_seconds") / 86400, one).alias("c"),
    )
    cols = {"supervised": "a", "unsupervised": "b", "time_series": "c"}
    return rounded(three.select("event_id", *[ensemble.ensemble_score(cols, m).alias(m) for m in ensemble.METHODS]), ensemble.METHODS)


@query(
    "route_models",
    with_labels(
        f"""select entity_id, events, {r6('h')} as history_days, case when l then 'supervised' when h >= 30 then 'time_series' else 'unsupervised' end as model_family from
 (select entity_id, count(*) as events, (max(epoch_us(ts)) - min(epoch_us(ts))) / 86400e6 as h, entity_id in (select scope_id from lab) as l from raw group by entity_id)"""
    ),
)
def route_models(spark, d):
    return rounded(ensemble.route_models(raw_events(spark, d), labels(spark, d)), ["history_days"])


# --- state -------------------------------------------------------------------------------------

_SNAP_CTES = (
    """hr as (select entity_type, entity_id, epoch_us(ts) // 3600000000 as h, count(*) as e, count(*) filter (status = 'success') as k, coalesce(sum(amount), 0) as a
 from raw group by all)""",
    """grid as (select entity_type, entity_id, unnest(range(a, b + 1)) as h from (select entity_type, entity_id, min(h) as a, max(h) as b from hr group by all))""",
    """snap as materialized (select entity_type, entity_id, (h + 1) * 3600000000 as snapshot_ts, coalesce(e, 0) as events_1h,
 cast(sum(coalesce(e, 0)) over w as bigint) as events_24h, sum(coalesce(a, 0)) over w as amount_24h,
 sum(coalesce(k, 0)) over w / nullif(sum(coalesce(e, 0)) over w, 0) as success_rate_24h
 from grid left join hr using (entity_type, entity_id, h) window w as (partition by entity_type, entity_id order by h rows between 23 preceding and current row))""",
)
_SNAP_OUT = f"entity_type, entity_id, snapshot_ts, events_1h, events_24h, {r6('amount_24h')} as amount_24h, {r6('success_rate_24h')} as success_rate_24h"


def _snap_out(df):
    return rounded(micros(df, "snapshot_ts"), ["amount_24h", "success_rate_24h"])


def _us(text: str) -> str:
    return f"epoch_us(timestamp '{text}')"


@query("state_snapshots", with_raw(f"select {_SNAP_OUT} from snap", *_SNAP_CTES))
def state_snapshots(spark, d):
    return _snap_out(state.state_snapshots(raw_events(spark, d)))


@query(
    "state_intervals",
    with_raw(
        f"""select entity_type, entity_id, min(snapshot_ts) as valid_from, max(snapshot_ts) as valid_to, count(*) as snapshots, events_1h, events_24h,
 {r6('min(amount_24h)')} as amount_24h, {r6('min(success_rate_24h)')} as success_rate_24h from
 (select *, sum(new) over (partition by entity_type, entity_id order by h) as part from
  (select s.*, g.h, case when exists (select 1 from hr where hr.entity_type = g.entity_type and hr.entity_id = g.entity_id and g.h in (hr.h, hr.h + 1, hr.h + 24)) then 1 else 0 end as new
   from snap s join grid g on s.entity_type = g.entity_type and s.entity_id = g.entity_id and s.snapshot_ts = (g.h + 1) * 3600000000))
 group by entity_type, entity_id, part, events_1h, events_24h""",
        *_SNAP_CTES,
    ),
)
def state_intervals(spark, d):
    out = state.state_intervals(raw_events(spark, d))
    return rounded(micros(out, "valid_from", "valid_to"), ["amount_24h", "success_rate_24h"])


@query(
    "snapshot_asof",
    with_raw(
        f"""select {_SNAP_OUT} from (select * from snap where snapshot_ts <= {_us('2024-01-15 12:30:00')}
 qualify row_number() over (partition by entity_type, entity_id order by snapshot_ts desc) = 1)""",
        *_SNAP_CTES,
    ),
)
def snapshot_asof(spark, d):
    return _snap_out(state.snapshot_asof(raw_events(spark, d), "2024-01-15 12:30:00"))


@query(
    "state_history",
    with_raw(f"select {_SNAP_OUT} from snap where snapshot_ts between {_us('2024-01-10')} and {_us('2024-01-12')}", *_SNAP_CTES),
)
def state_history(spark, d):
    return _snap_out(state.state_history(raw_events(spark, d), "2024-01-10 00:00:00", "2024-01-12 00:00:00"))


@query(
    "entity_memory",
    with_raw(
        f"""select entity_type, entity_id, count(*) as snapshots, max(snapshot_ts) as latest_ts, arg_max(events_24h, snapshot_ts) as latest_events_24h,
 max(events_24h) as peak_events_24h, {r6('avg(events_24h)')} as mean_events_24h, cast(sum(events_1h) as bigint) as events from snap
 where snapshot_ts <= {_us('2024-01-20')} and snapshot_ts > {_us('2024-01-13')} group by all""",
        *_SNAP_CTES,
    ),
)
def entity_memory(spark, d):
    out = state.entity_memory(raw_events(spark, d), "2024-01-20 00:00:00")
    return rounded(micros(out, "latest_ts"), ["mean_events_24h"])


_TRANS_CTES = (
    *_SNAP_CTES,
    """lagged as (select *, lag(snapshot_ts) over w as from_ts, lag(events_24h) over w as pe, lag(amount_24h) over w as pa from snap
 window w as (partition by entity_type, entity_id order by snapshot_ts))""",
    """trans as (select *, events_24h - pe as de, amount_24h - pa as da, (events_24h - pe) / greatest(abs(pe), 1) as re, (amount_24h - pa) / greatest(abs(pa), 1) as ra
 from lagged where from_ts is not null)""",
)
_TRANS_OUT = f"""entity_type, entity_id, from_ts as from_snapshot_ts, snapshot_ts as to_snapshot_ts, cast(de as bigint) as delta_events_24h, {r6('da', 4)} as delta_amount_24h,
 {r6('greatest(abs(re), abs(ra))', 4)} as change_magnitude, case when re >= 1 then 'activity_spike' when round(ra, 9) >= 1 then 'amount_increase'
 when re <= -0.5 then 'activity_drop' when round(ra, 9) <= -0.5 then 'amount_decrease' else 'steady' end as change_type"""


def _transitions_out(df):
    return rounded(micros(df, "from_snapshot_ts", "to_snapshot_ts"), ["delta_amount_24h", "change_magnitude"], 4)


@query("state_transitions", with_raw(f"select {_TRANS_OUT} from trans", *_TRANS_CTES))
def state_transitions(spark, d):
    return _transitions_out(state.state_transitions(raw_events(spark, d)))


@query(
    "anomalous_transitions",
    with_raw(f"select * from (select {_TRANS_OUT} from trans) where change_magnitude >= 1 and change_type <> 'steady'", *_TRANS_CTES),
)
def anomalous_transitions(spark, d):
    return _transitions_out(state.anomalous_transitions(raw_events(spark, d)))


# --- graph -------------------------------------------------------------------------------------

_EDGE_CTES = (
    """edges as materialized (select 'user' as from_type, user_id as from_id, to_type, to_id, relationship, count(*) as interaction_count from (
 select user_id, 'merchant' as to_type, merchant_id as to_id, 'transaction' as relationship from raw
 union all select user_id, 'device', device_id, 'uses_device' from raw
 union all select user_id, 'api_client', api_client_id, 'api_access' from raw) where user_id is not null and to_id is not null group by all)""",
    """links as materialized (select from_type as a_type, from_id as a, to_type as b_type, to_id as b, relationship, interaction_count from edges
 union all select to_type, to_id, from_type, from_id, relationship, interaction_count from edges)""",
)


@query("graph_edges", with_raw(f"select *, {r6('ln(1 + interaction_count)')} as edge_weight from edges", _EDGE_CTES[0]))
def graph_edges(spark, d):
    return rounded(graph.graph_edges(raw_events(spark, d)), ["edge_weight"])


@query(
    "graph_nodes",
    with_raw(
        """select a_type as entity_type, a as entity_id, count(distinct (b_type, b)) as node_degree, cast(sum(interaction_count) as bigint) as total_interactions
 from links group by all""",
        *_EDGE_CTES,
    ),
)
def graph_nodes(spark, d):
    return graph.graph_nodes(graph.graph_edges(raw_events(spark, d)))


@query(
    "graph_neighbors",
    with_raw(
        "select b_type as entity_type, b as entity_id, relationship, interaction_count from links where a_type = 'merchant' and a = 'm_7'", *_EDGE_CTES
    ),
)
def graph_neighbors(spark, d):
    return graph.neighbors(graph.graph_edges(raw_events(spark, d)), "merchant", "m_7")


@query(
    "graph_khop",
    with_raw(
        """select * from (select entity_type, entity_id, min(hops)::integer as hops from (
 select b_type as entity_type, b as entity_id, 1 as hops from links where a_type = 'user' and a = 'user_3'
 union all select l2.b_type, l2.b, 2 from links l1 join links l2 on l1.b_type = l2.a_type and l1.b = l2.a where l1.a_type = 'user' and l1.a = 'user_3')
 group by all) where not (entity_type = 'user' and entity_id = 'user_3')""",
        *_EDGE_CTES,
    ),
)
def graph_khop(spark, d):
    return graph.community(graph.graph_edges(raw_events(spark, d)), "user", "user_3", 2)


# --- series detectors --------------------------------------------------------------------------

_PTS = "pts as (select *, amount as x from raw where amount is not null)"


def _rows(n: int | str) -> str:
    return f"(partition by entity_id order by ts, event_id rows between {n} preceding and 1 preceding)"


@query(
    "rolling_z",
    with_raw(
        f"""select event_id, {r6('case when s > 0 then (x - m) / s when s = 0 then 0 end')} as rolling_z from
 (select event_id, x, avg(x) over {_rows(30)} as m, stddev_samp(x) over {_rows(30)} as s from pts)""",
        _PTS,
    ),
)
def rolling_z(spark, d):
    return rounded(timeseries.rolling_z(raw_events(spark, d)).select("event_id", "rolling_z"), ["rolling_z"])


@query(
    "moving_avg_dev",
    with_raw(
        f"""select event_id, {r6('m')} as moving_avg, {r6('case when m <> 0 then abs(x - m) / abs(m) end')} as moving_avg_dev from
 (select event_id, x, avg(x) over {_rows(30)} as m from pts)""",
        _PTS,
    ),
)
def moving_avg_dev(spark, d):
    out = timeseries.moving_avg_dev(raw_events(spark, d))
    return rounded(out.select("event_id", "moving_avg", "moving_avg_dev"), ["moving_avg", "moving_avg_dev"])


# Amounts of two digits give means that end in exactly half a unit of the last place kept; a nudge on both
# sides keeps the engines' last bits from deciding which way those round.
NUDGE = 1.2345678e-9


@query(
    "ewma_dev",
    with_raw(
        f"""select event_id, {r6(f'w + {NUDGE}')} as ewma, {r6(f'abs(x - w) + {NUDGE}')} as ewma_dev from (select event_id, x,
 case when len(l) > 0 then list_reduce(l, lambda a, b: a * 0.7::double + b * 0.3::double) end as w from (select event_id, x, list(x) over {_rows('unbounded')} as l from pts))""",
        _PTS,
    ),
)
def ewma_dev(spark, d):
    """Over the whole history of every entity."""
    out = timeseries.ewma_dev(raw_events(spark, d)).withColumns({c: F.col(c) + NUDGE for c in ("ewma", "ewma_dev")})
    return rounded(out.select("event_id", "ewma", "ewma_dev"), ["ewma", "ewma_dev"])


@query(
    "stat_outliers",
    with_raw(
        f"""select event_id, {r6('case when x is null or s = 0 then 0 else abs((x - m) / s) end')} as global_z,
 {r6('case when x is null or i = 0 then 0 when x < q1 - 1.5 * i then least((q1 - 1.5 * i - x) / i, 5) when x > q3 + 1.5 * i then least((x - q3 - 1.5 * i) / i, 5) else 0 end')} as global_iqr
 from (select event_id, amount as x from raw), (select avg(amount) as m, stddev_samp(amount) as s, quantile_cont(amount, 0.25) as q1,
 quantile_cont(amount, 0.75) as q3, quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25) as i from raw)"""
    ),
)
def stat_outliers(spark, d):
    out = timeseries.stat_outliers(raw_events(spark, d))
    return rounded(out.select("event_id", "global_z", "global_iqr"), ["global_z", "global_iqr"])


# --- narratives --------------------------------------------------------------------------------


@query(
    "nl_state",
    with_raw(
        """select event_id, 'User has ' || n || ' events in the last 1 day; success rate is ' || cast(round(k / n * 100) as bigint) || '%' as state_text from
 (select event_id, count(*) over w as n, sum(case when status = 'success' then 1 else 0 end) over w as k from raw where user_id is not null
 window w as (partition by user_id order by ts range between interval 24 hours preceding and current row))"""
    ),
)
def nl_state(spark, d):
    rows = entity_windows(raw_events(spark, d), "user", [24])
    return narrate.describe_state(rows, "user", 24).select("event_id", "state_text")


@query(
    "timeline",
    with_raw(
        """select event_id, least(row_number() over (partition by entity_id order by ts, event_id), 6) as entries,
 string_agg(event_type || ':' || status, ',') over (partition by entity_id order by ts, event_id rows between 5 preceding and current row) as steps from raw"""
    ),
)
def timeline(spark, d):
    out = narrate.timeline(raw_events(spark, d))
    steps = F.array_join(F.transform("timeline", lambda e: F.concat_ws(":", e["event_type"], e["status"])), ",")
    return out.select("event_id", F.size("timeline").cast("long").alias("entries"), steps.alias("steps"))


@query("evidence_pack")
def evidence_pack(spark, d):
    s = scored(spark, d, every_feature=True)
    stats = explain.stats_dict(explain.feature_stats(s))
    hits = explain.explain_anomalies(s, stats, WEIGHTS, "baseline_score")
    out = narrate.evidence_pack(hits, raw_events(spark, d))
    return out.select("event_id", "entity_id", F.to_json("evidence").alias("evidence"))
