from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.operators import alerts, feedback, graph, impact, narrate, state, synth
from riskloom.operators import labels as lab
from tests.helpers import at, by_id, events, labels


def test_risk_summary_readings(spark):
    rules = impact.rules(spark)
    count = lambda by: {r["risk_level"]: r["scenarios"] for r in impact.risk_summary(rules, by).collect()}
    assert count("match") == {"critical": 1, "high": 6, "medium": 0, "low": 0}
    assert count("scenario") == {"critical": 1, "high": 4, "medium": 2, "low": 0}


def test_impact_defaults_and_no_match(spark):
    rules = impact.rules(spark, {"s": {"source_dataset": "A", "entity_type": "user", "business_impact": {"category": "c"}}, "t": {"source_dataset": "B"}}, {})
    row = rules.first()
    assert rules.count() == 1
    assert (row["risk_level"], row["estimated_cost"], row["recommended_action"], row["escalation_sla_minutes"], row["escalation_contact"]) == (
        "medium", 0.0, "Investigate", 60, "unknown",
    )
    ev = events(spark, [("a", "u", 0, 1, {"source_dataset": "Z"})])
    assert impact.attach_impact(ev, rules).first()["scenario"] is None
    labels_ = impact.rules(spark).select("scenario", impact.cost_label().alias("c")).collect()
    assert {r["scenario"]: r["c"] for r in labels_}["metric_spike"] == "$200/minute"


def test_feedback(spark):
    scored = events(spark, [(f"e{i}", "u", i, 1) for i in range(4)]).withColumns(
        {"anomaly_score": F.lit(0.6), "is_anomaly": F.when(F.col("event_id") < "e2", 1).otherwise(0)}
    )
    log = feedback.log_predictions(scored, "r", "2024-04-01 00:00:00")
    assert feedback.append_predictions(log, log).count() == 4
    ids = {f"e{i}": hashlib.sha1(f"r|CERT|e{i}".encode()).hexdigest() for i in range(4)}
    assert {r["prediction_id"] for r in log.collect()} == set(ids.values())
    given = spark.createDataFrame(
        [(ids["e0"], 0, "first", at(0)), (ids["e0"], 1, "second", at(1)), (ids["e2"], 1, None, at(0)), ("ghost", 1, None, at(0))],
        "prediction_id string, actual_label int, notes string, recorded_at timestamp",
    )
    known, unknown = feedback.accept_feedback(log, given)
    assert unknown.count() == 1
    view = feedback.feedback_view(log, known)
    s = feedback.feedback_stats(view).first()
    assert (s["total_predictions"], s["with_feedback"], s["true_positives"], s["false_negatives"], s["accuracy"]) == (4, 2, 1, 1, 0.5)
    assert feedback.pending_feedback(view).count() == 1
    assert feedback.recent_predictions(view, 3).count() == 3
    none = feedback.feedback_stats(feedback.feedback_view(log, known.limit(0))).first()
    assert none["total_predictions"] == 0 and none["accuracy"] == 0.0


def _scenarios(**patterns):
    base = {"source_dataset": "CERT", "entity_type": "user", "event_type": "transaction_auth", "anomaly_label": {"label_type": "fraud", "label": "x", "severity": 4}}
    return {n: {**base, "injection_pattern": p} for n, p in patterns.items()}


def test_synthetic_patterns(spark):
    ev = events(spark, [(f"e{i}", f"u{i % 4}", i * 60, 5, {"currency": "USD" if i < 4 else None}) for i in range(12)])
    sc = _scenarios(
        even={"count": 5, "time_window_seconds": 400, "silence_before_hours": 1, "amount_distribution": {"type": "fixed", "value": 7}},
        drawn={"count": 6, "time_window_seconds": 100, "time_distribution": "random", "amount_distribution": {"type": "round", "values": [1, 2]}},
        gaps={"count": 30, "time_window_seconds": 300, "time_distribution": "poisson", "amount_distribution": {"type": "normal", "mean": 0, "std": 5}},
        night={"count": 8, "hour_range": [2, 5], "amount_distribution": {"type": "drift", "start_value": 10, "end_value": 20, "noise": 0}},
        spike={"count": 4, "amount_distribution": {"type": "spike", "baseline_mean": 30, "spike_multiplier": 5}},
    )
    made, lb, log = synth.inject_all(ev, "r1", sc, per_scenario=2)
    made = made.withColumn("sc", F.get_json_object("metadata", "$.scenario")).persist()
    assert {r["sc"]: r["count"] for r in made.groupBy("sc").count().collect()} == {"even": 10, "drawn": 12, "gaps": 60, "night": 16, "spike": 8}
    assert made.select("event_id").distinct().count() == made.count()
    rows = made.collect()
    newest = {r["entity_id"]: r["t"] for r in ev.groupBy("entity_id").agg(F.max("ts").alias("t")).collect()}
    for r in rows:
        gap = (r["ts"] - newest[r["entity_id"]]).total_seconds()
        if r["sc"] == "even":
            assert r["amount"] == 7.0 and gap - 3600 in (0, 100, 200, 300, 400) and r["currency"] == "USD"
        if r["sc"] == "drawn":
            assert 0 <= gap <= 100 and r["amount"] in (1.0, 2.0)
        if r["sc"] == "gaps":
            assert gap <= 30 * 150 and r["amount"] >= 0.01
        if r["sc"] == "night":
            assert 2 <= r["ts"].hour <= 5 and 10 <= r["amount"] <= 20
    spikes = sorted(r["amount"] for r in rows if r["sc"] == "spike")
    assert spikes[3] < 80 < spikes[4]
    spans = {(r["scope_id"], r["ts_start"], r["ts_end"]) for r in lb.collect()}
    assert len(spans) == 10 and all(a <= b for _, a, b in spans)
    assert {r["events_created"] for r in log.collect()} == {10, 12, 60, 16, 8}
    found = lab.label_any(made.drop("sc"), lb)
    assert found.filter("is_anomaly = 0").count() == 0
    again, _, _ = synth.inject_all(ev, "r1", sc, per_scenario=2)
    assert by_id(again, "ts", "amount") == by_id(made, "ts", "amount")


def test_arrivals_in_blocks_are_those_of_one_block(spark, monkeypatch):
    """Patterns of many events, over more than one block, sorted and inside their bounds; merchants as entities."""
    ev = events(spark, [("a", "u", 0, 1, {"merchant_id": "m1"}), ("b", "m1", 5, 1)])
    sc = _scenarios(
        gaps={"count": 700, "time_window_seconds": 300, "time_distribution": "poisson"},
        drawn={"count": 500, "time_window_seconds": 100, "time_distribution": "random"},
        even={"count": 101, "time_window_seconds": 100},
    )
    sc["drawn"]["entity_type"] = "merchant"
    whole = synth.inject_all(ev, "r1", sc, per_scenario=1)[0].select("event_id", "ts", "entity_id", "metadata").collect()
    monkeypatch.setattr(synth, "INDEX_BLOCK", 64)
    cut = synth.inject_all(ev, "r1", sc, per_scenario=1)[0].select("event_id", "ts", "entity_id", "metadata").collect()
    assert sorted(whole) == sorted(cut) and len(whole) == 1301
    of = lambda name: sorted(r["ts"] for r in cut if f'"{name}"' in r["metadata"])
    gaps = [(b - a).total_seconds() for a, b in zip(of("gaps"), of("gaps")[1:], strict=False)]
    assert 0.3 < sum(gaps) / len(gaps) < 0.6 and max(gaps) <= 150
    assert {r["entity_id"] for r in cut if '"drawn"' in r["metadata"]} == {"m1"}
    spread = of("drawn")
    assert (spread[-1] - spread[0]).total_seconds() <= 100 and 30 < (spread[250] - spread[0]).total_seconds() < 70


def test_unpriced_events_have_no_amount(spark):
    ev = events(spark, [("a", "u", 0, 5)])
    made, _, _ = synth.inject_all(ev, "r", {"suspicious_login_burst": C.SCENARIOS["suspicious_login_burst"]})
    assert made.count() == 20 and made.filter("amount is not null").count() == 0
    family = synth.family_scenario("account_takeover", "CERT", "high", 2)
    assert family["injection_pattern"]["count"] == 80


def test_alert_severity_budget_and_queries(spark):
    ev = events(spark, [(f"e{i}", "u", i, 1) for i in range(10)]).withColumn("s", F.substring("event_id", 2, 2).cast("double") / 10)
    got = by_id(ev.select("event_id", alerts.severity("s").alias("v")), "v")
    assert [got[f"e{i}"] for i in (2, 3, 5, 7, 9)] == [None, "low", "medium", "high", "critical"]
    al = alerts.make_alerts(ev, "s")
    assert al.count() == 7
    assert sorted(r["event_id"] for r in alerts.apply_budget(al, 2).collect()) == ["e8", "e9"]
    assert alerts.query_alerts(al, at(4), at(8), ["high"], ["u"]).count() == 2
    assert {r["severity"]: r["n"] for r in alerts.alert_volume(al).collect()} == {"low": 2, "medium": 2, "high": 2, "critical": 1}


def test_state(spark):
    ev = events(spark, [("a", "u", 0, 1), ("b", "u", 60, 2, {"status": "fail"}), ("c", "u", 3 * 3600, 10), ("d", "u", 30 * 3600, 1)])
    snaps = state.state_snapshots(ev).orderBy("snapshot_ts").collect()
    assert len(snaps) == 31
    assert [s["events_24h"] for s in snaps[:4]] == [2, 2, 2, 3] and snaps[0]["success_rate_24h"] == 0.5
    assert snaps[26]["events_24h"] == 1 and snaps[27]["events_24h"] == 0 and snaps[27]["success_rate_24h"] is None
    assert state.snapshot_asof(ev, at(3600 * 2 + 1)).first()["snapshot_ts"] == at(3600 * 2).replace(tzinfo=None)
    memory = state.entity_memory(ev, at(31 * 3600), 6).first()
    assert memory["snapshots"] == 6 and memory["latest_events_24h"] == 1
    kinds = {r["to_snapshot_ts"]: r["change_type"] for r in state.state_transitions(ev).collect()}
    assert len(kinds) == 30
    assert kinds[at(4 * 3600).replace(tzinfo=None)] == "amount_increase"
    assert kinds[at(28 * 3600).replace(tzinfo=None)] == "activity_drop"
    assert state.anomalous_transitions(ev).count() >= 2


def test_state_of_any_range_is_that_part_of_the_snapshots(spark):
    rng = random.Random(6)
    rows = [(f"e{i}", rng.choice("uvw"), 3600 * rng.choice([0, 1, 2, 40, 90, 91, 300]) + rng.randrange(3600), rng.randrange(100), {"status": rng.choice(["success", "fail"])}) for i in range(40)]
    ev = events(spark, rows).cache()
    snaps = sorted(tuple(r) for r in state.state_snapshots(ev).collect())
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    for a, b in ((-5, 3), (1.5, 1.7), (1, 60), (45, 95), (120, 250), (100, 400), (500, 600)):
        low, high = at(3600 * a), at(3600 * b)
        want = [s for s in snaps if low.replace(tzinfo=None) <= s[2] <= high.replace(tzinfo=None)]
        assert plain(state.state_history(ev, low, high)) == want
        spans = state.state_intervals(ev, low, high)
        assert (spans.agg(F.sum("snapshots")).first()[0] or 0) == len(want)
        latest = {s[:2]: s for s in snaps if s[2] <= high.replace(tzinfo=None)}
        assert plain(state.snapshot_asof(ev, high)) == sorted(latest.values())


def test_state_reads_only_the_hours_it_needs_and_grows_with_events(spark, tmp_path):
    path = str(tmp_path / "events")
    events(spark, [("a", "u", 0, 1), ("b", "u", 3600 * 24 * 365 * 3, 2), ("c", "u", 3600 * 24 * 365 * 3 + 5, 2)]).write.parquet(path)
    stored = spark.read.parquet(path)
    assert state.state_intervals(stored).count() == 4  # enters, leaves the hour, leaves the day; three years later
    plan = state.state_history(stored, "2024-03-04 00:00:00", "2024-03-05 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-03-03" in plan and "LessThan(ts,2024-03-05" in plan


def test_graph(spark):
    rows = [("a", "u1", 0, 1, {"user_id": "u1", "merchant_id": "m1"}), ("b", "u1", 1, 1, {"user_id": "u1", "merchant_id": "m1", "device_id": "d1"}),
            ("c", "u2", 2, 1, {"user_id": "u2", "merchant_id": "m1"}), ("d", "u2", 3, 1, {"user_id": "u2", "device_id": "d2"}), ("e", "x", 4, 1, {"merchant_id": "m9"})]
    edges = graph.graph_edges(events(spark, rows))
    assert {(r["from_id"], r["to_id"], r["interaction_count"]) for r in edges.collect()} == {("u1", "m1", 2), ("u1", "d1", 1), ("u2", "m1", 1), ("u2", "d2", 1)}
    nodes = {r["entity_id"]: (r["node_degree"], r["total_interactions"]) for r in graph.graph_nodes(edges).collect()}
    assert nodes["m1"] == (2, 3) and nodes["u1"] == (2, 3)
    assert graph.neighbors(edges, "user", "u1", "transaction").count() == 1
    near = lambda hops: {(r["entity_id"], r["hops"]) for r in graph.community(edges, "user", "u1", hops).collect()}
    assert near(2) == {("m1", 1), ("d1", 1), ("u2", 2)}
    assert near(3) == near(2) | {("d2", 3)}


def test_words(spark):
    df = spark.createDataFrame([(150, 0.95, 50.0)], "user_24h_event_count long, user_24h_success_rate double, base double")
    assert narrate.describe_state(df, "user", 24).first()["state_text"] == "User has 150 events in the last 1 day; success rate is 95%"
    said = narrate.describe_state(df, "user", 24, "base").first()["state_text"]
    assert said.startswith("User has 150 events in the last 1 day (3.0x the usual 50)")
    assert narrate.window_words(168) == "last 7 days" and narrate.window_words(1) == "last 1 hour"


def test_interval_join_rules(spark):
    ev = events(spark, [("a", "u", 0, 1), ("b", "u", 10, 1), ("c", "u", 20, 1, {"ingest_batch_id": "adversarial_1"}), ("d", "v", 0, 1)])
    lb = labels(spark, [("u", 10, 10, "fraud", 1), ("u", 10, None, "anomaly", 0), ("u", 500, 600, "fraud", 1, "adversarial_1")])
    out = sorted((r["event_id"], r["is_anomaly"], r["label_type"]) for r in lab.label_interval_join(ev, lb).fillna("-", ["label_type"]).collect())
    assert out == [("a", 0, "-"), ("b", 0, "anomaly"), ("b", 1, "fraud"), ("c", 0, "anomaly"), ("c", 1, "fraud"), ("d", 0, "-")]
    assert by_id(lab.label_any(ev, lb), "is_anomaly") == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert lab.label_between_join(ev, lb).count() == 5
