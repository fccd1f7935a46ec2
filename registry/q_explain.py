"""Explanations, business impact, feedback, synthetic events."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import micros, query, rounded, with_features, with_labels, with_raw, with_scores
from registry.fixtures import labels, r6, raw_events
from registry.q_baseline import fitted
from registry.q_features import LABEL_ANY_SQL, features
from registry.q_reports import scored
from riskloom import config as C
from riskloom.operators import explain, feedback, impact, model, reports, synth
from riskloom.operators import labels as lab

# Weights of the checked explanations: falling with the feature's position.
WEIGHTS = {c: 1.0 / (i + 1) for i, c in enumerate(C.MODEL_FEATURES)}

_STATS_CTE = (
    "stats as materialized ("
    + "\nunion all ".join(
        f"select '{c}' as feature, {i} as pos, {1.0 / (i + 1)!r}::double as w, avg(cast({c} as double)) as mean,"
        f" greatest(stddev_samp(cast({c} as double)), 1e-6) as std from feat"
        for i, c in enumerate(C.MODEL_FEATURES)
    )
    + ")"
)
_CONTRIB_CTES = (
    "val as ("
    + "\nunion all ".join(
        f"select event_id, '{c}' as feature, coalesce(cast({c} as double), 0) as value from feat" for c in C.MODEL_FEATURES
    )
    + ")",
    "con as (select event_id, feature, pos, value, (value - mean) / std as z, abs((value - mean) / std) * w as contribution from val join stats using (feature))",
    "ranked as materialized (select *, row_number() over (partition by event_id order by contribution desc, pos) as rank from con qualify rank <= 5)",
)


@query(
    "feature_stats",
    with_features(f"select feature, {r6('mean')} as mean, {r6('std')} as std from stats", _STATS_CTE),
)
def feature_stats(spark, d):
    return rounded(explain.feature_stats(features(spark, d)), ["mean", "std"])


def _explained(spark, d):
    f = features(spark, d)
    return explain.explain(f, explain.stats_dict(explain.feature_stats(f)), WEIGHTS, score="metric_z_24h")


@query(
    "signed_z",
    with_features(f"select event_id, {r6('z')} as z from con where feature = 'event_count_24h'", _STATS_CTE, *_CONTRIB_CTES[:2]),
)
def signed_z(spark, d):
    f = features(spark, d)
    stats = explain.stats_dict(explain.feature_stats(f))
    return rounded(f.select("event_id", F.expr(explain.signed_z("event_count_24h", stats)).alias("z")), ["z"])


@query(
    "contributions",
    with_features(
        f"""select event_id, rank, feature, {r6('value')} as value, {r6('z')} as zscore, {r6('contribution')} as contribution,
 case when z > 0 then 'high' else 'low' end as direction from ranked""",
        _STATS_CTE,
        *_CONTRIB_CTES,
    ),
)
def contributions(spark, d):
    out = _explained(spark, d).select("event_id", F.posexplode("top_contributors").alias("i", "c"))
    out = out.select("event_id", (F.col("i") + 1).cast("long").alias("rank"), "c.feature", "c.value", "c.zscore", "c.contribution", "c.direction")
    return rounded(out, ["value", "zscore", "contribution"])


def _phrase_sql() -> str:
    word = """case when z > 2 then 'very high' when z > 1 then 'high' when z < -2 then 'very low' when z < -1 then 'low' else 'unusual' end"""
    cases = []
    for c in C.MODEL_FEATURES:
        name = explain.display_name(c)
        if "count" in c:
            cases.append(f"when '{c}' then {word} || ' {name} (' || cast(value as bigint) || ')'")
        elif "seconds" in c:
            cases.append(
                f"when '{c}' then case when value / 3600 > 24 then {word} || ' time gap (' || printf('%.1f', value / 3600 / 24) || ' days)'"
                f" else {word} || ' time gap (' || printf('%.1f', value / 3600) || 'h)' end"
            )
        else:
            cases.append(f"when '{c}' then {word} || ' {name}'")
    return "case feature " + " ".join(cases) + " end"


@query(
    "summary_text",
    with_scores(
        """select event_id, 'Anomaly (score: ' || printf('%.2f', baseline_score * 100) || '%) due to ' || reason || '.' as summary
 from scored join (select event_id, string_agg(phrase, ' and ' order by rank) as reason from phrases where rank <= 2 group by event_id) using (event_id)""",
        _STATS_CTE,
        *_CONTRIB_CTES,
        f"phrases as (select event_id, rank, {_phrase_sql()} as phrase from ranked)",
    ),
)
def summary_text(spark, d):
    s = scored(spark, d, every_feature=True)
    stats = explain.stats_dict(explain.feature_stats(s))
    return explain.explain(s, stats, WEIGHTS, "baseline_score").select("event_id", "summary")


@query(
    "explain_anomalies",
    with_scores(
        f"""select event_id, {r6('baseline_score')} as baseline_score, feature as top_feature, {r6('contribution')} as top_contribution
 from scored join ranked using (event_id) where baseline_score >= 0.5 and rank = 1""",
        _STATS_CTE,
        *_CONTRIB_CTES,
    ),
)
def explain_anomalies(spark, d):
    s = scored(spark, d, every_feature=True)
    stats = explain.stats_dict(explain.feature_stats(s))
    out = explain.explain_anomalies(s, stats, WEIGHTS, "baseline_score")
    top = F.col("top_contributors")[0]
    out = out.select("event_id", "baseline_score", top["feature"].alias("top_feature"), top["contribution"].alias("top_contribution"))
    return rounded(out, ["baseline_score", "top_contribution"])


@query("explain_predictions")
def explain_predictions(spark, d):
    """Model anomalies explained by the model's own importances."""
    fit, data = fitted(spark, d)
    f = features(spark, d)
    stats = explain.stats_dict(explain.feature_stats(data.filter(~F.col("is_test"))))
    scored = model.predict(fit, f, impact.rules(spark))
    out = explain.explain_anomalies(scored, stats, model.importances(fit))
    return out.select("event_id", "entity_id", "anomaly_score", "scenario_match", "summary")


@query("global_importance")
def global_importance(spark, d):
    fit, _ = fitted(spark, d)
    return explain.global_importance(features(spark, d), model.importances(fit))


# --- impact ------------------------------------------------------------------------------------


def _text(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def _rule_values() -> str:
    rows = []
    for i, (name, s) in enumerate(C.SCENARIOS.items()):
        b = s["business_impact"]
        path = C.ESCALATION_PATHS[b["escalation_path"]]
        unit = next(u for u in ("per_incident", "per_minute", "per_day") if f"estimated_cost_{u}" in b)
        cells = [
            str(i), _text(name), _text(s["source_dataset"]), _text(s["entity_type"]), _text(b["category"]), _text(b["risk_level"]),
            f"{b[f'estimated_cost_{unit}']}::double", _text(unit), _text(b["recommended_action"]), _text("|".join(b["compliance_flags"])),
            _text(b["escalation_path"]), str(path["response_sla_minutes"]), _text(path["contact"]),
        ]
        rows.append("(" + ", ".join(cells) + ")")
    return ",\n".join(rows)


_RULE_COLUMNS = (
    "pos, scenario, source_dataset, entity_type, category, risk_level, estimated_cost, cost_unit, recommended_action,"
    " compliance_flags, escalation_path, sla, contact"
)
RULES_CTE = f"rules as (select * from (values {_rule_values()}) t({_RULE_COLUMNS}))"
MATCH_CTE = "matched as (select * from rules qualify row_number() over (partition by source_dataset, entity_type order by pos) = 1)"


@query(
    "impact_map",
    with_raw(
        """select r.event_id, m.scenario, m.category, m.risk_level, m.estimated_cost, m.cost_unit, m.recommended_action,
 m.compliance_flags, m.escalation_path, m.sla as escalation_sla_minutes, m.contact as escalation_contact
 from raw r left join matched m using (source_dataset, entity_type)""",
        RULES_CTE,
        MATCH_CTE,
    ),
)
def impact_map(spark, d):
    out = impact.attach_impact(raw_events(spark, d), impact.rules(spark))
    return out.select("event_id", *[F.array_join(c, "|").alias(c) if c == "compliance_flags" else c for c in impact.IMPACT_COLUMNS])


@query(
    "rule_join",
    with_raw("select r.event_id, m.scenario as scenario_match from raw r left join matched m using (source_dataset, entity_type)", RULES_CTE, MATCH_CTE),
)
def rule_join(spark, d):
    return impact.match_scenario(raw_events(spark, d), impact.rules(spark)).select("event_id", "scenario_match")


@query(
    "impacts_all",
    with_raw(
        """select r.scenario as name, m.scenario, m.risk_level, n.events from rules r join matched m using (source_dataset, entity_type)
 join (select source_dataset, entity_type, count(*) as events from raw group by all) n using (source_dataset, entity_type)""",
        RULES_CTE,
        MATCH_CTE,
    ),
)
def impacts_all(spark, d):
    """Impact per scenario, with the events its signal has."""
    every = impact.all_impacts(impact.rules(spark))
    sizes = raw_events(spark, d).groupBy("source_dataset", "entity_type").agg(F.count("*").alias("events"))
    return sizes.join(F.broadcast(every), ["source_dataset", "entity_type"]).select("name", "scenario", "risk_level", "events")


@query(
    "risk_summary",
    with_raw(
        """select l.risk_level, s.reading, count(x.risk_level) as scenarios, coalesce(sum(x.events), 0)::bigint as events
 from (values ('critical'), ('high'), ('medium'), ('low')) l(risk_level) cross join (values ('match'), ('scenario')) s(reading)
 left join (select 'match' as reading, m.risk_level, n.events from rules r join matched m using (source_dataset, entity_type) join sig n using (source_dataset, entity_type)
  union all select 'scenario', r.risk_level, n.events from rules r join sig n using (source_dataset, entity_type)) x
 on x.risk_level = l.risk_level and x.reading = s.reading group by all""",
        RULES_CTE,
        MATCH_CTE,
        "sig as (select source_dataset, entity_type, count(*) as events from raw group by all)",
    ),
)
def risk_summary(spark, d):
    """Scenarios per risk level by both readings, with the events of their signals."""
    rules = impact.rules(spark)
    sizes = raw_events(spark, d).groupBy("source_dataset", "entity_type").agg(F.count("*").alias("events"))
    out = []
    for by in ("match", "scenario"):
        hit = sizes.join(F.broadcast(impact.all_impacts(rules, by)), ["source_dataset", "entity_type"])
        events = hit.groupBy("risk_level").agg(F.sum("events").alias("events"))
        table = impact.risk_summary(rules, by).join(events, "risk_level", "left")
        out.append(table.select("risk_level", F.lit(by).alias("reading"), "scenarios", F.coalesce("events", F.lit(0)).alias("events")))
    return reports.union_all(out)


@query(
    "cost_label",
    with_raw(
        """select r.event_id, case when m.scenario is not null then '$' || printf('%.0f', m.estimated_cost) || '/' ||
 case m.cost_unit when 'per_minute' then 'minute' when 'per_day' then 'day' else 'incident' end end as cost
 from raw r left join matched m using (source_dataset, entity_type)""",
        RULES_CTE,
        MATCH_CTE,
    ),
)
def cost_label(spark, d):
    out = impact.attach_impact(raw_events(spark, d), impact.rules(spark))
    return out.select("event_id", F.when(F.col("scenario").isNotNull(), impact.cost_label()).alias("cost"))


@query(
    "impact_exposure",
    with_scores(
        """select m.risk_level, count(*) as anomalies, sum(m.estimated_cost) as estimated_cost, min(m.sla) as tightest_sla_minutes
 from scored s join matched m using (source_dataset, entity_type) where s.baseline_score >= 0.5 group by m.risk_level""",
        RULES_CTE,
        MATCH_CTE,
    ),
)
def impact_exposure(spark, d):
    hits = scored(spark, d).filter("baseline_score >= 0.5")
    return impact.exposure(hits, impact.rules(spark))


@query(
    "top_anomalies_with_impact",
    with_scores(
        f"""select t.event_id, t.entity_id, {r6('t.s')} as baseline_score, m.scenario, m.risk_level, m.category from
 (select *, baseline_score as s from scored where baseline_score >= 0.5 order by s desc, event_id limit 100) t
 left join matched m using (source_dataset, entity_type)""",
        RULES_CTE,
        MATCH_CTE,
    ),
)
def top_anomalies_with_impact(spark, d):
    """Flagship: features, baselines, scores, ranking, impact."""
    top = reports.top_anomalies(scored(spark, d), "baseline_score", 0.5, 100)
    out = impact.attach_impact(top, impact.rules(spark))
    return rounded(out.select("event_id", "entity_id", "baseline_score", "scenario", "risk_level", "category"), ["baseline_score"])


# --- feedback ----------------------------------------------------------------------------------

RUN, LOGGED = "run1", "2024-02-01 00:00:00"
_LOG_CTES = (
    LABEL_ANY_SQL,
    f"""plog as (select sha1('{RUN}|' || s.source_dataset || '|' || s.event_id) as prediction_id, s.event_id, s.entity_id, s.source_dataset,
 s.event_type, s.baseline_score as score, case when s.baseline_score >= 0.35 then 1 else 0 end as predicted_label, a.is_anomaly as truth
 from scored s join anyl a using (event_id))""",
    """fview as (select *, event_type <> 'view' as feedback_received,
 case when event_type = 'error' then 1 - truth when event_type <> 'view' then truth end as actual_label from plog)""",
)


def _with_log(body: str) -> str:
    return with_scores(body, *_LOG_CTES, labels=True)


def _predictions(spark, d):
    s = scored(spark, d).withColumn("is_anomaly", F.when(F.col("baseline_score") >= 0.35, 1).otherwise(0))
    return feedback.log_predictions(s, RUN, LOGGED, score="baseline_score")


def _feedback(spark, d):
    """True labels for all but views, then a correction turning the labels of errors round."""
    truth = lab.label_any(raw_events(spark, d), labels(spark, d)).filter("event_type <> 'view'")
    pid = F.sha1(F.concat_ws("|", F.lit(RUN), "source_dataset", "event_id")).alias("prediction_id")
    first = truth.select(
        pid, F.col("is_anomaly").alias("actual_label"), F.lit("first").alias("notes"),
        F.lit("2024-02-02 00:00:00").cast("timestamp").alias("recorded_at"), "event_type",
    )
    again = first.filter("event_type = 'error'").withColumns(
        {"actual_label": 1 - F.col("actual_label"), "notes": F.lit("again"), "recorded_at": F.lit("2024-02-03 00:00:00").cast("timestamp")}
    )
    return first.unionByName(again).drop("event_type")


@query(
    "log_predictions",
    _with_log(f"select prediction_id, entity_id, source_dataset, {r6('score')} as anomaly_score, predicted_label from plog"),
)
def log_predictions(spark, d):
    """Logged twice: the second time adds nothing."""
    p = _predictions(spark, d)
    out = feedback.append_predictions(p, p)
    return rounded(out.drop("timestamp"), ["anomaly_score"])


@query(
    "record_feedback",
    _with_log(
        """select prediction_id, feedback_received, actual_label, case when feedback_received then predicted_label = actual_label end as is_correct,
 case when event_type = 'error' then 'again' when feedback_received then 'first' end as notes from fview"""
    ),
)
def record_feedback(spark, d):
    view = feedback.feedback_view(_predictions(spark, d), _feedback(spark, d))
    return view.select("prediction_id", "feedback_received", "actual_label", "is_correct", "notes")


@query(
    "feedback_unknown",
    with_raw("select 'known' as side, count(*) filter (event_type <> 'view') + count(*) filter (event_type = 'error') as n from raw union all select 'unknown', count(*) from raw"),
)
def feedback_unknown(spark, d):
    """Feedback split by whether its prediction was ever logged."""
    real = _feedback(spark, d)
    stray = raw_events(spark, d).select(
        F.col("event_id").alias("prediction_id"), F.lit(1).alias("actual_label"), F.lit(None).cast("string").alias("notes"),
        F.lit(LOGGED).cast("timestamp").alias("recorded_at"),
    )
    log = raw_events(spark, d).select(F.sha1(F.concat_ws("|", F.lit(RUN), "source_dataset", "event_id")).alias("prediction_id"))
    known, unknown = feedback.accept_feedback(log, real.unionByName(stray))
    both = known.withColumn("side", F.lit("known")).unionByName(unknown.withColumn("side", F.lit("unknown")))
    return both.groupBy("side").agg(F.count("*").alias("n"))


@query(
    "feedback_stats",
    _with_log(
        f"""select total_predictions, with_feedback, true_positives, false_positives, true_negatives, false_negatives,
 {r6('(true_positives + true_negatives) / with_feedback')} as accuracy,
 {r6('true_positives / greatest(true_positives + false_positives, 1)')} as precision,
 {r6('true_positives / greatest(true_positives + false_negatives, 1)')} as recall from
 (select count(*) as total_predictions, count(actual_label) as with_feedback,
  count(*) filter (predicted_label = 1 and actual_label = 1) as true_positives, count(*) filter (predicted_label = 1 and actual_label = 0) as false_positives,
  count(*) filter (predicted_label = 0 and actual_label = 0) as true_negatives, count(*) filter (predicted_label = 0 and actual_label = 1) as false_negatives from fview)"""
    ),
)
def feedback_stats(spark, d):
    view = feedback.feedback_view(_predictions(spark, d), _feedback(spark, d))
    return rounded(feedback.feedback_stats(view), ["accuracy", "precision", "recall"])


@query("recent_predictions", _with_log("select prediction_id, predicted_label from plog order by prediction_id limit 20"))
def recent_predictions(spark, d):
    view = feedback.feedback_view(_predictions(spark, d), _feedback(spark, d))
    return feedback.recent_predictions(view, 20).select("prediction_id", "predicted_label")


@query("pending_feedback", _with_log("select prediction_id, entity_id from fview where predicted_label = 1 and not feedback_received"))
def pending_feedback(spark, d):
    view = feedback.feedback_view(_predictions(spark, d), _feedback(spark, d))
    return feedback.pending_feedback(view).select("prediction_id", "entity_id")


# --- synthetic events --------------------------------------------------------------------------

SYNTH_RUN = "fx01"


def _number(x) -> str:
    return "null" if x is None else repr(x)


def _scenario_values(scenarios: dict) -> str:
    rows = []
    for name, s in scenarios.items():
        p = s["injection_pattern"]
        a = p.get("amount_distribution", {"type": "normal", "mean": 100, "std": 30})
        low, high = p.get("hour_range") or (None, None)
        values = [float(v) for v in a.get("values", [100, 200, 500])]
        rows.append(
            f"({_text(name)}, {_text(s['source_dataset'])}, {_text(s['entity_type'])}, {_text(s['event_type'])}, {p.get('count', 10)}, {p.get('time_window_seconds', 3600)},"
            f" {p.get('silence_before_hours', 0)}, {_text(p.get('time_distribution', 'uniform'))}, {_number(low)}::bigint, {_number(high)}::bigint, {_text(a.get('type', 'normal'))},"
            f" {a.get('mean', 100)}::double, {a.get('std', 30)}::double, {a.get('value', 100)}::double, {values!r}::double[], {a.get('baseline_mean', 30)}::double,"
            f" {a.get('spike_multiplier', 5)}::double, {a.get('start_value', 30)}::double, {a.get('end_value', 80)}::double, {a.get('noise', 5)}::double,"
            f" {_text(s['anomaly_label'].get('label_type', 'anomaly'))}, {s['anomaly_label']['severity']})"
        )
    return ",\n".join(rows)


def _draw(salt: str, index: str = "i") -> str:
    """The uniform draw of a scenario, entity and index."""
    return f"(cast('0x' || substr(md5(concat_ws('|', '{SYNTH_RUN}/{salt}', scenario, entity_id, cast({index} as varchar))), 1, 13) as bigint) + 0.5) / 4503599627370496.0"


_HOUR, _DAY = 3_600_000_000, 86_400_000_000


def _synth_ctes(scenarios: dict) -> tuple[str, ...]:
    return (
        f"""scen as (select * from (values {_scenario_values(scenarios)}) t(scenario, src, typ, ev, n, win, silence, dist, hlo, hhi, atype, amean, astd, avalue, avalues,
 sbase, smult, dstart, dend, dnoise, label_type, severity))""",
        """role as (select source_dataset, entity_type, entity_id, ts from raw union all select source_dataset, 'merchant', merchant_id, ts from raw where merchant_id is not null
 union all select source_dataset, 'api_client', api_client_id, ts from raw where api_client_id is not null)""",
        """drawn as materialized (select s.*, m.entity_id from scen s join (select distinct source_dataset, entity_type, entity_id from role) m
 on m.source_dataset = s.src and m.entity_type = s.typ qualify row_number() over (partition by scenario order by md5(m.entity_id), m.entity_id) <= 5)""",
        """tmpl as materialized (select d.*, (select max(epoch_us(ts)) from role r where r.entity_id = d.entity_id and r.source_dataset = d.src and r.entity_type = d.typ) as base
 from drawn d)""",
        f"""gaps as materialized (select *, case when dist = 'poisson' then least(cast(round(-ln({_draw('gap')}) * (win * 1e6 / n)) as bigint), win * 500000)
 else cast(round(-ln({_draw('gap')}) * 1e6) as bigint) end as gap, cast(round(-ln({_draw('gap', 'n')}) * 1e6) as bigint) as beyond from (select *, unnest(range(n)) as i from tmpl))""",
        f"""placed as materialized (select *, base + silence * {_HOUR} + case dist when 'uniform' then cast(round(i * win * 1e6 / greatest(n - 1, 1)) as bigint)
 when 'poisson' then cast(upto as bigint) when 'random' then cast(floor(upto / (whole + beyond) * win * 1e6) as bigint) end as moment from
 (select *, sum(gap) over (partition by scenario, entity_id order by i) as upto, sum(gap) over (partition by scenario, entity_id) as whole from gaps))""",
        f"""syn as materialized (select *, sha1('adversarial|{SYNTH_RUN}|' || scenario || '|' || entity_id || '|' || i) as event_id,
 case when hlo is null then moment else moment - moment % {_DAY} + cast(hlo + floor({_draw('hour')} * (hhi - hlo + 1)) as bigint) * {_HOUR}
  + cast(floor({_draw('minute')} * 60) as bigint) * 60000000 + moment % 60000000 end as t,
 case when ev in ('transaction_auth', 'metric_observation') then case atype when 'fixed' then avalue when 'normal' then greatest(amean + astd * z, 0.01)
  when 'round' then avalues[cast(floor({_draw('pick')} * len(avalues)) as bigint) + 1]
  when 'spike' then case when i < n // 2 then sbase + z * 5.0 else sbase * smult + z * 10.0 end
  when 'drift' then dstart + (dend - dstart) * i / greatest(n - 1, 1) + z * dnoise end end as amount
 from (select *, sqrt(-2.0 * ln({_draw('amount/radius')})) * cos(2 * pi() * ({_draw('amount/angle')})) as z from placed))""",
    )


_SYNTH_CTES = _synth_ctes(C.SCENARIOS)


@query(
    "template_entities",
    with_raw("select scenario, entity_id, base as ts from tmpl", *_SYNTH_CTES[:4]),
)
def template_entities(spark, d):
    ev = raw_events(spark, d)
    out = synth.template_entities(ev, synth.scenario_table(spark))
    return micros(out.select("scenario", "entity_id", "ts"), "ts")


@query(
    "template_join",
    with_raw(
        "select t.scenario, r.event_id from raw r join tmpl t on r.entity_id = t.entity_id and r.source_dataset = t.src", *_SYNTH_CTES[:4]
    ),
)
def template_join(spark, d):
    """All events of the drawn entities, per scenario."""
    ev = raw_events(spark, d)
    drawn = synth.template_entities(ev, synth.scenario_table(spark)).select("scenario", "entity_id", F.col("s_source").alias("source_dataset"))
    return ev.join(F.broadcast(drawn), ["source_dataset", "entity_id"]).select("scenario", "event_id")  # scenarios x 5 rows


def _synthetic(spark, d):
    return synth.inject_all(raw_events(spark, d), SYNTH_RUN)


@query("synth_timestamps", with_raw("select event_id, t as ts from syn", *_SYNTH_CTES))
def synth_timestamps(spark, d):
    """Evenly spaced, random and Poisson times, and those moved into a range of hours."""
    return micros(_synthetic(spark, d)[0].select("event_id", "ts"), "ts")


@query("synth_amounts", with_raw(f"select event_id, {r6('amount')} as amount, ev as event_type, amount is not null as priced from syn", *_SYNTH_CTES))
def synth_amounts(spark, d):
    out = _synthetic(spark, d)[0].select("event_id", "amount", "event_type", F.col("amount").isNotNull().alias("priced"))
    return rounded(out, ["amount"])


@query(
    "synth_events",
    with_raw(
        f"""select event_id, t as ts, {r6('amount')} as amount, ev as event_type, 'success' as status, typ as entity_type, entity_id, src as source_dataset, 'adversarial_{SYNTH_RUN}' as ingest_batch_id,
 '{{"adversarial":true,"scenario":"' || scenario || '","run_id":"{SYNTH_RUN}"}}' as metadata from syn""",
        *_SYNTH_CTES,
    ),
)
def synth_events(spark, d):
    columns = ["event_id", "ts", "amount", "event_type", "status", "entity_type", "entity_id", "source_dataset", "ingest_batch_id", "metadata"]
    return rounded(micros(_synthetic(spark, d)[0].select(*columns), "ts"), ["amount"])


@query(
    "synth_labels",
    with_raw(
        f"""select scenario, entity_id as scope_id, label_type, severity, min(t) as ts_start, max(t) as ts_end, 1 as label, 'adversarial_' || scenario as source_dataset
 from syn group by all""",
        *_SYNTH_CTES,
    ),
)
def synth_labels(spark, d):
    made = _synthetic(spark, d)[1]
    out = made.select(F.get_json_object("metadata", "$.scenario").alias("scenario"), "scope_id", "label_type", "severity", "ts_start", "ts_end", "label", "source_dataset")
    return micros(out, "ts_start", "ts_end")


@query(
    "inject_all",
    with_labels(
        f"""select ingest_batch_id, count(*) as events, cast(sum(hit) as bigint) as labelled from (select e.ingest_batch_id, case when exists (select 1 from every_label l
 where l.scope_id = e.entity_id and l.label > 0 and ((e.t >= l.a and (l.b is null or e.t <= l.b)) or (e.ingest_batch_id like 'adversarial%' and e.ingest_batch_id = l.batch)))
 then 1 else 0 end as hit from every_event e) group by ingest_batch_id""",
        *_SYNTH_CTES,
        f"""every_event as (select entity_id, epoch_us(ts) as t, ingest_batch_id from raw union all select entity_id, t, 'adversarial_{SYNTH_RUN}' from syn)""",
        f"""every_label as (select scope_id, epoch_us(ts_start) as a, epoch_us(ts_end) as b, label, ingest_batch_id as batch from lab
 union all select entity_id, min(t), max(t), 1, 'adversarial_{SYNTH_RUN}' from syn group by scenario, entity_id)""",
    ),
)
def inject_all(spark, d):
    """Synthetic and real events together: how many synthetic events their labels find."""
    ev, lb = raw_events(spark, d), labels(spark, d)
    made, made_labels, _ = synth.inject_all(ev, SYNTH_RUN)
    both = lab.label_any(ev.unionByName(made), lb.unionByName(made_labels))
    return both.groupBy("ingest_batch_id").agg(F.count("*").alias("events"), F.sum("is_anomaly").alias("labelled"))


# The three attack families on entities of their own kind, at two intensities.
_FAMILY_RUNS = {
    f"{family}_{intensity}": synth.family_scenario(family, source, intensity, 2)
    for family, source in (("account_takeover", "CERT"), ("api_abuse", "IEEE_CIS"), ("merchant_abuse", "CREDITCARD"))
    for intensity in ("medium", "high")
}


@query(
    "scenario_families",
    with_raw(
        """select scenario, typ as entity_type, count(distinct entity_id) as entities_affected, count(*) as events_created, min(t) as start_time, max(t) as end_time
 from syn group by all""",
        *_synth_ctes(_FAMILY_RUNS),
    ),
)
def scenario_families(spark, d):
    """Run log of the three attack families at two intensities."""
    return micros(synth.inject_all(raw_events(spark, d), SYNTH_RUN, _FAMILY_RUNS)[2], "start_time", "end_time")
