"""Baselines, evaluation of scores, and the supervised model."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import (
    COMBINED_CTE,
    LONG_CTE,
    PARTS_CTE,
    PROFILE_CTE,
    SCORE_DIGITS,
    query,
    rounded,
    with_features,
    with_labels,
    with_raw,
    with_scores,
)
from registry.fixtures import labels, r6, raw_events
from registry.q_features import LABEL_ANY_SQL, features
from registry.q_reports import scored, scores, scoring_features
from riskloom import config as C
from riskloom.operators import baseline, evaluate, impact, model
from riskloom.operators import labels as lab
from riskloom.operators.model_store import ModelStore
from riskloom.operators.reports import top_anomalies
from riskloom.plans.lineage import cut_lineage, scratch_folder

_STATS = baseline.STATS
_PROFILE_OUT = ", ".join(f"{r6(s)} as {s}" for s in _STATS)


@query(
    "baseline_profile",
    with_features(f"select source_dataset, entity_type, feature, n, {_PROFILE_OUT} from prof", LONG_CTE, PROFILE_CTE),
)
def baseline_profile(spark, d):
    out = baseline.learn_profile(scoring_features(spark, d)).drop("signal_id")
    return rounded(out, _STATS)


@query(
    "baseline_profile_exact",
    with_features(f"select source_dataset, entity_type, feature, n, {_PROFILE_OUT} from prof", LONG_CTE, PROFILE_CTE),
)
def baseline_profile_exact(spark, d):
    """No sample: quantiles by distributed ranks."""
    out = baseline.learn_profile(scoring_features(spark, d), sample_size=None).drop("signal_id")
    return rounded(out, _STATS)


@query(
    "temporal_profile",
    with_raw(
        f"""select source_dataset, entity_type, 'hour' as unit, k as slot, {r6("count(*) filter (extract(hour from ts) = k) / count(*)")} as share
 from raw, (select unnest(range(24)) as k) group by all
union all select source_dataset, entity_type, 'weekday', k, {r6("count(*) filter (dayofweek(ts) = k) / count(*)")}
 from raw, (select unnest(range(7)) as k) group by all"""
    ),
)
def temporal_profile(spark, d):
    p = baseline.learn_calendar(raw_events(spark, d))
    slots = lambda c, unit: p.select(
        *baseline.SIGNAL, F.lit(unit).alias("unit"), F.posexplode(c).alias("slot", "share")
    )
    out = slots("hourly_counts", "hour").unionByName(slots("daily_counts", "weekday"))
    return rounded(out.withColumn("slot", F.col("slot").cast("long")), ["share"])


def _part_sql(expr: str, name: str) -> str:
    return with_features(
        f"select event_id, feature, {r6(expr)} as {name} from comb", LONG_CTE, PROFILE_CTE, PARTS_CTE, COMBINED_CTE
    )


def _parts(spark, d, suffix, name):
    s = scores(spark, d, parts=True, every_feature=False)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_{suffix}").alias(name)) for c in C.BASELINE_FEATURES])
    out = s.select("event_id", F.explode(pairs).alias("p")).select("event_id", "p.*").filter(F.col(name).isNotNull())
    return rounded(out, [name])


@query("zscore", _part_sql("z", "zscore"))
def zscore(spark, d):
    return _parts(spark, d, "zscore", "zscore")


@query("combined_score", _part_sql("c", "combined"))
def combined_score(spark, d):
    return _parts(spark, d, "combined", "combined")


def _amount_part(spark, d, expression, name):
    """One score of the amount against its signal's profile."""
    f = scoring_features(spark, d)
    prof = baseline.learn_profile(f).filter("feature = 'amount'").drop("feature")
    rows = f.join(F.broadcast(prof), baseline.SIGNAL).filter(F.col("amount").isNotNull())  # one row per signal
    return rounded(rows.select("event_id", F.expr(expression).alias(name)), [name])


def _amount_sql(expr: str, name: str) -> str:
    return with_features(
        f"select event_id, {r6(expr)} as {name} from parts where feature = 'amount'", LONG_CTE, PROFILE_CTE, PARTS_CTE
    )


@query("iqr_score", _amount_sql("i", "iqr_score"))
def iqr_score(spark, d):
    return _amount_part(spark, d, baseline.iqr_score("amount", *[f"({w})" for w in baseline.whiskers()], "iqr"), "iqr_score")


@query("percentile_score", _amount_sql("p", "percentile_score"))
def percentile_score(spark, d):
    return _amount_part(spark, d, baseline.percentile_score("amount"), "percentile_score")


@query("baseline_score", with_scores(f"select event_id, {r6('baseline_score')} as baseline_score from scored"))
def baseline_score(spark, d):
    return rounded(scores(spark, d, every_feature=False).select("event_id", F.round("baseline_score", SCORE_DIGITS).alias("baseline_score")), ["baseline_score"])


@query("profile_join", with_scores("select source_dataset, entity_type, count(*) as events, count(*) filter (baseline_score > 0) as scored from scored group by all"))
def profile_join(spark, d):
    s = scored(spark, d)
    return s.groupBy(*baseline.SIGNAL).agg(F.count("*").alias("events"), F.count_if(F.col("baseline_score") > 0).alias("scored"))


@query(
    "baseline_anomalies",
    with_scores(f"select event_id, {r6('baseline_score')} as baseline_score from scored where baseline_score >= 0.5"),
)
def baseline_anomalies(spark, d):
    out = top_anomalies(scored(spark, d), "baseline_score", 0.5)
    return rounded(out.select("event_id", "baseline_score"), ["baseline_score"])


@query(
    "top_anomalies",
    with_scores(
        f"""select event_id, {r6('s')} as baseline_score from (select event_id, baseline_score as s from scored
 where baseline_score >= 0.5 order by s desc, event_id limit 20)"""
    ),
)
def q_top_anomalies(spark, d):
    return rounded(top_anomalies(scored(spark, d), "baseline_score", 0.5, 20).select("event_id", "baseline_score"), ["baseline_score"])


# --- evaluation over the baseline score --------------------------------------------------------

_EVAL_CTE = "ev as materialized (select s.event_id, s.baseline_score as score, a.is_anomaly as y from scored s join anyl a using (event_id))"


def _with_eval(body: str, *ctes: str) -> str:
    return with_scores(body, LABEL_ANY_SQL, _EVAL_CTE, *ctes, labels=True)


def labelled_scores(spark, d):
    s = lab.label_any(scored(spark, d), labels(spark, d))
    return cut_lineage(s.select("event_id", F.col("baseline_score").alias("score"), F.col("is_anomaly").alias("y")), "labelled")


_CELLS = """count(*) filter (score >= 0.5 and y > 0) as tp, count(*) filter (score >= 0.5 and y = 0) as fp,
 count(*) filter (score < 0.5 and y = 0) as tn, count(*) filter (score < 0.5 and y > 0) as fn"""


@query(
    "eval_confusion",
    _with_eval(
        f"""select tp, fp, tn, fn, {r6('tp / greatest(tp + fp, 1)')} as precision, {r6('tp / greatest(tp + fn, 1)')} as recall,
 {r6('case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end')} as f1, {r6('(tp + tn) / greatest(tp + fp + tn + fn, 1)')} as accuracy,
 tp + fp + tn + fn as total, {r6('(tp + fn) / greatest(tp + fp + tn + fn, 1)')} as anomaly_rate from cells""",
        f"cells as (select {_CELLS} from ev)",
    ),
)
def eval_confusion(spark, d):
    out = evaluate.confusion(labelled_scores(spark, d), "score", "y")
    return rounded(out, ["precision", "recall", "f1", "accuracy", "anomaly_rate"])


_AUC_CTES = (
    "bys as (select score, count(*) filter (y > 0) as p, count(*) filter (y = 0) as n from ev group by score)",
    "cum as (select *, sum(n) over (order by score) - n as below, sum(p) over (order by score desc) as tp, sum(n) over (order by score desc) as fp from bys)",
)


@query(
    "eval_roc_auc",
    _with_eval(f"select {r6('sum(p * (below + n / 2)) / (sum(p) * sum(n))')} as roc_auc from cum", *_AUC_CTES),
)
def eval_roc_auc(spark, d):
    return rounded(evaluate.roc_auc(labelled_scores(spark, d), "score", "y"), ["roc_auc"])


@query(
    "eval_curves",
    _with_eval(
        f"""select {r6('score', 9)} as threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp, {r6('tp / (select sum(p) from bys)')} as tpr,
 {r6('fp / (select sum(n) from bys)')} as fpr, {r6('tp / (tp + fp)')} as precision from cum""",
        *_AUC_CTES,
    ),
)
def eval_curves(spark, d):
    out = evaluate.curve_points(labelled_scores(spark, d), "score", "y").drop("recall_step")
    return rounded(rounded(out, ["threshold"], 9), ["tpr", "fpr", "precision"])


@query(
    "eval_pr_auc",
    _with_eval(f"select {r6('sum(tp / (tp + fp) * p / (select sum(p) from bys))')} as pr_auc from cum", *_AUC_CTES),
)
def eval_pr_auc(spark, d):
    return rounded(evaluate.pr_auc(labelled_scores(spark, d), "score", "y"), ["pr_auc"])


@query(
    "compare_detectors",
    _with_eval(
        f"""select detector, tp, fp, fn, tn, {r6('tp / greatest(tp + fp, 1)')} as precision, {r6('tp / greatest(tp + fn, 1)')} as recall,
 {r6('(tp + tn) / greatest(tp + fp + tn + fn, 1)')} as accuracy from
 (select 'baseline' as detector, {_CELLS} from ev union all select 'amount_z', {_CELLS.replace('score', 'z')} from
 (select s.event_id, round(least(abs(coalesce(s.metric_z_24h, 0)) / 5, 1), 9) as z, ev.y from scored s join ev using (event_id)))"""
    ),
)
def compare_detectors(spark, d):
    s = scored(spark, d).select(
        "source_dataset", "event_id", "entity_id", "ts", "ingest_batch_id",
        F.col("baseline_score").alias("baseline"),
        F.round(F.least(F.abs(F.coalesce("metric_z_24h", F.lit(0.0))) / 5, F.lit(1.0)), 9).alias("amount_z"),
    )
    s = lab.label_any(s, labels(spark, d)).withColumnRenamed("is_anomaly", "y")
    return rounded(evaluate.compare_detectors(s, ["baseline", "amount_z"], "y"), ["precision", "recall", "accuracy"])


# --- supervised model --------------------------------------------------------------------------

_MODEL_SQL = ", ".join(f"{r6(f'coalesce({c}, 0)')} as {c}" for c in C.MODEL_FEATURES)
_J2 = """(e.entity_id = l.scope_id and e.ts >= l.ts_start and (l.ts_end is null or e.ts <= l.ts_end))
 or (e.ingest_batch_id like 'adversarial%' and e.ingest_batch_id = l.ingest_batch_id and e.entity_id = l.scope_id)"""


@query(
    "training_set",
    with_features(
        f"select event_id, source_dataset, {_MODEL_SQL}, case when l_label > 0 then 1 else 0 end as is_anomaly from"
        f" (select e.*, l.label as l_label from feat e left join lab l on {_J2})",
        labels=True,
    ),
)
def training_set(spark, d):
    return rounded(model.training_set(features(spark, d), labels(spark, d), one_row_per_event=False), C.MODEL_FEATURES)


@query(
    "stratified_split",
    with_labels(
        """select event_id, is_anomaly, k <= round(n * 0.2) as is_test from (select event_id, is_anomaly,
 row_number() over (partition by is_anomaly order by md5(event_id)) as k, count(*) over (partition by is_anomaly) as n from anyl)""",
        LABEL_ANY_SQL,
    ),
)
def stratified_split(spark, d):
    rows = lab.label_any(raw_events(spark, d), labels(spark, d)).select("event_id", "is_anomaly")
    return model.stratified_split(rows)


@query(
    "class_weight",
    with_labels(
        f"""select count(*) filter (is_anomaly > 0) as positives, count(*) filter (is_anomaly = 0) as negatives,
 {r6('least(count(*) filter (is_anomaly = 0) / greatest(count(*) filter (is_anomaly > 0), 1), 100)')} as class_weight from anyl""",
        LABEL_ANY_SQL,
    ),
)
def class_weight(spark, d):
    rows = lab.label_any(raw_events(spark, d), labels(spark, d))
    return rounded(model.class_weight(rows), ["class_weight"])


_FITTED: dict[tuple[str, str], tuple] = {}


def fitted(spark, d):
    """Model and its split, one row per event; trained once per application and data folder."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _FITTED:
        rows = cut_lineage(model.training_set(features(spark, d), labels(spark, d)))
        data = model.stratified_split(rows).persist()
        _FITTED[at] = (model.train(data.filter(~F.col("is_test"))), data)
    return _FITTED[at]


@query("train_model")
def train_model(spark, d):
    """Held-out quality of the boosted trees."""
    fit, data = fitted(spark, d)
    return model.evaluate(fit, data.filter("is_test"))


@query("training_report")
def training_report(spark, d):
    """Quality, sizes and anomaly rates of the training."""
    fit, data = fitted(spark, d)
    return model.training_report(fit, data.filter(~F.col("is_test")), data.filter("is_test"))


@query("stored_model")
def stored_model(spark, d):
    """Events scored by the model as it was saved and loaded again."""
    fit, data = fitted(spark, d)
    store = ModelStore(spark, scratch_folder(spark, "models"))
    store.save(fit, data.filter(~F.col("is_test")), data.filter("is_test"))
    return store.load().score(features(spark, d)).select("event_id", "anomaly_score", "is_anomaly")


@query("predict")
def predict(spark, d):
    fit, _ = fitted(spark, d)
    out = model.predict(fit, features(spark, d), impact.rules(spark))
    return out.select("event_id", "anomaly_score", "is_anomaly", "scenario_match")


@query("feature_importance")
def feature_importance(spark, d):
    fit, _ = fitted(spark, d)
    return model.importance_table(fit, spark)

