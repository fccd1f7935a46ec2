from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import baseline, drift, ensemble, evaluate, explain, features, impact, model, reports
from riskloom.operators.model_store import ModelStore
from riskloom.streaming.score import score_batch
from tests.helpers import by_id, events, labels


def _rows(spark, amounts, source="CERT"):
    return events(spark, [(f"{source}{i:03d}", f"u{i % 3}", i * 7000, a, {"source_dataset": source}) for i, a in enumerate(amounts)])


def test_profile_needs_more_than_ten_values(spark):
    df = _rows(spark, [1.0] * 10, "TEN").unionByName(_rows(spark, [1.0] * 11, "ELEVEN"))
    got = {r["source_dataset"] for r in baseline.learn_profile(df).filter("feature = 'amount'").collect()}
    assert got == {"ELEVEN"}


@pytest.mark.parametrize("sample", [None, 100_000])
def test_profile_matches_numpy(spark, sample):
    rng = random.Random(2)
    amounts = [round(rng.uniform(0, 50), 2) for _ in range(40)]
    row = baseline.learn_profile(_rows(spark, amounts), sample).filter("feature = 'amount'").first()
    assert row["mean"] == pytest.approx(np.mean(amounts)) and row["std"] == pytest.approx(np.std(amounts, ddof=1))
    for name, p in baseline.PERCENTILES.items():
        assert row[name] == pytest.approx(np.quantile(amounts, p))
    assert row["iqr"] == pytest.approx(np.quantile(amounts, 0.75) - np.quantile(amounts, 0.25))


def _expected(v, s):
    z = 0.0 if s["std"] == 0 else abs((v - s["mean"]) / s["std"])
    i = 0.0
    if s["iqr"] != 0:
        low, high = s["p25"] - 1.5 * s["iqr"], s["p75"] + 1.5 * s["iqr"]
        i = min(max(low - v, v - high, 0) / s["iqr"], 5.0)
    p = 1.0 if v <= s["p1"] or v >= s["p99"] else 0.7 if v <= s["p5"] or v >= s["p95"] else 0.3 if v <= s["p25"] or v >= s["p75"] else 0.0
    return 0.4 * min(z / 5, 1) + 0.3 * min(i / 3, 1) + 0.3 * p


def test_scores_match_the_rule(spark):
    rng = random.Random(4)
    amounts = [round(rng.gauss(20, 5), 2) for _ in range(30)] + [400.0, None, -90.0]
    df = _rows(spark, amounts)
    prof = baseline.learn_profile(df, columns=["amount"])
    s = prof.first()
    out = by_id(baseline.score_events(df, prof, ["amount"]), "baseline_score")
    for i, v in enumerate(amounts):
        assert out[f"CERT{i:03d}"] == pytest.approx(0.0 if v is None else _expected(v, s))


def test_constant_feature_scores_its_band_and_unknown_signal_zero(spark):
    df = _rows(spark, [5.0] * 12)
    prof = baseline.learn_profile(df, columns=["amount"])
    assert by_id(baseline.score_events(df, prof, ["amount"]), "baseline_score")["CERT000"] == pytest.approx(0.3)
    other = _rows(spark, [5.0], "NEW")
    row = baseline.score_events(other, prof, ["amount"]).first()
    assert row["baseline_score"] == 0.0 and row["baseline_score_mean"] is None
    assert baseline.baseline_anomalies(df, prof, 0.2, 3).count() == 3


def test_calendar(spark):
    row = baseline.learn_calendar(events(spark, [("a", "u", 0, 1), ("b", "u", 3600, 1), ("c", "u", 86400, 1)])).first()
    assert row["sample_size"] == 3 and sum(row["hourly_counts"]) == pytest.approx(1) and len(row["daily_counts"]) == 7
    assert row["hourly_counts"][12] == pytest.approx(2 / 3) and row["daily_counts"][0] == pytest.approx(2 / 3)


def _auc(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_evaluation(spark):
    rng = random.Random(8)
    pairs = [(rng.choice([0.1, 0.2, 0.5, 0.5, 0.9, rng.random()]), int(rng.random() < 0.3)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "s double, y int")
    assert evaluate.roc_auc(df, "s", "y").first()[0] == pytest.approx(_auc(pairs))
    assert evaluate.roc_auc(df.filter("y = 0"), "s", "y").first()[0] == 0.0
    c = evaluate.confusion(df, "s", "y").first()
    tp = sum(s >= 0.5 and y == 1 for s, y in pairs)
    assert c["tp"] == tp and c["total"] == 200 and c["recall"] == pytest.approx(tp / sum(y for _, y in pairs))
    none = evaluate.confusion(df.filter("s < 0"), "s", "y").first()
    assert none["total"] == 0 and none["f1"] == 0.0 and none["precision"] == 0.0
    points = evaluate.curve_points(df, "s", "y").orderBy(F.desc("threshold")).collect()
    assert points[-1]["tpr"] == points[-1]["fpr"] == 1.0
    ap = sum(p["precision"] * p["recall_step"] for p in points)
    assert evaluate.pr_auc(df, "s", "y").first()[0] == pytest.approx(ap)


def test_split_weight_and_model(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"e{i:04d}", f"u{i % 9}", i * 900, rng.gauss(10, 1) if i % 10 else 60 + rng.random()) for i in range(400)]
    ev = events(spark, rows)
    lb = labels(spark, [(f"u{i % 9}", i * 900, i * 900, "fraud", 1) for i in range(0, 400, 10)])
    data = model.stratified_split(model.training_set(features.build_features(ev), lb, one_row_per_event=True)).persist()
    got = {(r["is_anomaly"], r["is_test"]): r["count"] for r in data.groupBy("is_anomaly", "is_test").count().collect()}
    assert got == {(0, True): 72, (0, False): 288, (1, True): 8, (1, False): 32}
    w = model.class_weight(data.filter("not is_test")).first()
    assert w["class_weight"] == pytest.approx(9.0)
    fit = model.train(data.filter("not is_test"), trees=3, depth=3)
    quality = model.evaluate(fit, data.filter("is_test")).first()
    assert quality["roc_auc"] > 0.9 and quality["total"] == 80
    weights = model.importances(fit)
    assert set(weights) == set(model.model_columns(fit)) and sum(weights.values()) == pytest.approx(1.0)
    f = features.build_features(ev)
    store = ModelStore(spark, str(tmp_path / "models"))
    with pytest.raises(ValueError):
        store.load()
    parts = data.filter("not is_test"), data.filter("is_test")
    assert (store.save(fit, *parts), store.save(model.train(parts[0], trees=1, depth=1), *parts), store.versions()) == (1, 2, [1, 2])
    # another session of the application shares no state with the one that saved
    other = spark.newSession()
    again = ModelStore(other, str(tmp_path / "models")).load(1)
    f.write.parquet(str(tmp_path / "features"))
    a, b = by_id(model.predict(fit, f), "anomaly_score"), by_id(again.score(other.read.parquet(str(tmp_path / "features"))), "anomaly_score")
    assert a == b and store.load().version == 2 and again.columns == model.model_columns(fit) and again.importance == weights
    report = again.report.first()
    assert (report["train_size"], report["test_size"], report["feature_count"], report["roc_auc"]) == (320, 80, len(again.columns), quality["roc_auc"])
    assert report["anomaly_rate_train"] == pytest.approx(0.1) and report["anomaly_rate_test"] == pytest.approx(0.1)
    assert [r["version"] for r in store.reports().orderBy("version").collect()] == [1, 2]
    with pytest.raises(ValueError):
        again.score(f.drop(again.columns[0]))
    counts, hits, log = score_batch(f, again.scoring(impact.rules(spark)), "2024-04-01 00:00:00")
    assert counts.first()["processed"] == 400 and hits.count() == log.count() == counts.first()["anomaly_count"] > 0
    raw_nulls = f.filter(F.col("delta_1").isNull()).count()
    assert model.predict(fit, f).filter(F.col("delta_1").isNull()).count() == raw_nulls


def test_small_class_is_split_without_strata(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("event_id"), (F.col("id") < 5).cast("int").alias("is_anomaly"))
    assert model.stratified_split(df).filter("is_test").count() == 20


def test_explanations(spark):
    df = spark.createDataFrame(
        [("a", 150.0, 180_000.0, 3.0, 0.876), ("b", None, 7200.0, 1.0, 0.5)],
        "event_id string, event_count_1h double, time_since_last_event_seconds double, delta_1 double, s double",
    )
    stats = {"event_count_1h": (50.0, 20.0), "time_since_last_event_seconds": (90_000.0, 60_000.0), "delta_1": (1.0, 1.0)}
    weights = {"event_count_1h": 0.5, "time_since_last_event_seconds": 0.3, "delta_1": 0.2}
    out = {r["event_id"]: r for r in explain.explain(df, stats, weights, "s").collect()}
    a = out["a"]
    assert [c["feature"] for c in a["top_contributors"]] == ["event_count_1h", "time_since_last_event_seconds", "delta_1"]
    assert a["top_contributors"][0]["zscore"] == pytest.approx(5.0) and a["top_contributors"][0]["direction"] == "high"
    assert a["summary"] == "Anomaly (score: 87.60%) due to very high Event Count 1H (150) and high time gap (2.1 days)."
    assert out["b"]["summary"] == "Anomaly (score: 50.00%) due to very low Event Count 1H (0) and low time gap (2.0h)."
    assert explain.explain(df, stats, weights, "s", columns=[]).first()["summary"] == "Anomaly score: 87.60%. No significant contributors."
    tied = explain.explain(df, {c: (0.0, 1.0) for c in stats}, {c: 0.0 for c in stats}, "s", top_n=2).first()
    assert [c["feature"] for c in tied["top_contributors"]] == ["event_count_1h", "delta_1"]  # model feature order


def test_feature_stats_floor(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "delta_1 double, amount_diff_1 double")
    assert explain.stats_dict(explain.feature_stats(df)) == {"delta_1": (1.0, 1e-6)}


def test_ensemble_methods(spark):
    df = spark.createDataFrame([(0.2, 0.4, 0.9), (0.2, None, 0.9), (None, None, None)], "a double, b double, c double")
    cols = {"supervised": "a", "unsupervised": "b", "time_series": "c"}
    got = {m: [r[0] for r in df.select(ensemble.ensemble_score(cols, m)).collect()] for m in ensemble.METHODS}
    assert got["weighted_average"][:2] == pytest.approx([0.47, (0.08 + 0.27) / 0.7]) and got["weighted_average"][2] is None
    assert got["median"][:2] == pytest.approx([0.4, 0.55]) and got["mean"][:2] == pytest.approx([0.5, 0.55])
    assert got["max"][:2] == [0.9, 0.9] and got["min"][:2] == [0.2, 0.2] and got["median"][2] is None
    with pytest.raises(ValueError):
        ensemble.ensemble_score(cols, "vote")


def test_drift_bounds(spark):
    same = spark.range(2000).select((F.col("id") % 1000 / 1000).alias("score"), (F.col("id") >= 1000).alias("is_current"))
    shares = drift.bin_shares(same)
    assert drift.psi(shares).first()["psi"] == pytest.approx(0, abs=1e-9)
    assert drift.js_divergence(shares).first()["js"] == pytest.approx(0, abs=1e-9)
    apart = same.withColumn("score", F.when(F.col("is_current"), F.col("score") + 5).otherwise(F.col("score")))
    moved = drift.bin_shares(apart)
    assert drift.psi(moved).first()["band"] == "major" and drift.js_divergence(moved).first()["drifted"]
    halves = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 1.0)], "bin int, p double, q double")
    assert drift.js_divergence(halves).first()["js"] == pytest.approx(1.0)


def test_reports(spark):
    ev = events(spark, [("a", "u", 0, 1, {"channel": "x"}), ("b", "u", 10, None), ("c", "v", 5, 3)])
    prof = {r["column_name"]: r for r in reports.column_profile(ev).collect()}
    assert prof["channel"]["null_count"] == 2 and prof["channel"]["values_list"] == "x"
    assert prof["ip_hash"]["unique_count"] == 0 and prof["event_id"]["unique_count"] == 3
    nulls = {r["column_name"]: r["null_pct"] for r in reports.null_report(ev).collect()}
    assert nulls["channel"] == pytest.approx(66.67) and "event_id" not in nulls
    first = by_id(reports.first_per_entity(ev), "amount", "channel")
    assert first["b"] == (1.0, "x")  # newest non-null per column mixes rows
    assert by_id(reports.first_per_entity(ev, whole_row=True), "amount", "channel")["b"] == (None, None)
    stats = reports.describe(ev.withColumn("delta_1", F.col("amount")), ["delta_1"]).first()
    assert (stats["n"], stats["mean"], stats["p50"]) == (2, 2.0, 2.0)
    rate = reports.anomaly_rate(ev.withColumn("baseline_score", F.lit(0.7)).limit(0)).first()
    assert rate["total"] == 0 and rate["rate"] == 0.0
    assert reports.schema_report(ev).count() == 20 and not math.isnan(reports.amount_summary(ev).first()["amount_mean"])
