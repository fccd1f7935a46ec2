from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import explain, features, impact
from riskloom.plans.hotkeys import SkewLimits
from riskloom.schema import RAW_EVENTS
from riskloom.streaming import counts
from riskloom.streaming import features as stream_features
from riskloom.streaming.features import FeatureStream, run_feature_stream
from riskloom.streaming.score import Scoring, run_scoring_stream, stream_totals
from riskloom.streaming.source import deduplicated, stream_events
from tests.helpers import at, by_id, events, labels, same_rows


def _series(spark, n=60, seed=9):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([1, 300, 4000, 90_000])
        rows.append((f"e{i:03d}", rng.choice(["u", "v", "w"]), t, None if rng.random() < 0.2 else rng.randrange(1, 90)))
    return events(spark, rows)


def _land(ev, path, ids):
    ev.filter(F.col("event_id").isin(ids)).coalesce(1).write.mode("append").parquet(path)


def test_stream_features_equal_batch_and_replay_is_idempotent(spark, tmp_path):
    ev = _series(spark)
    lb = labels(spark, [("u", 500, None, "fraud", 1), ("v", 5000, None, "anomaly", 1)])
    ids = [f"e{i:03d}" for i in range(60)]
    src, state, out, ck = (str(tmp_path / n) for n in ("src", "state", "out", "ck"))
    for part in (ids[:25], ids[25:26], ids[26:]):
        _land(ev, src, part)
        run_feature_stream(spark, src, state, out, ck, lb, files_per_batch=1)
    want = features.build_features(ev, lb)
    same_rows(spark.read.parquet(out).select(*want.columns), want)
    # The last batch processed again leaves the same output.
    FeatureStream(state, out, lb).process(ev.filter(F.col("event_id") >= "e026"), 2)
    same_rows(spark.read.parquet(out).select(*want.columns), want)


def _arrive(worker, ev, parts, first=0):
    for i, ids in enumerate(parts, first):
        worker.process(ev.filter(F.col("event_id").isin(ids)), i)


def test_late_rows_have_features_and_correct_earlier_ones(spark, tmp_path):
    worker = FeatureStream(str(tmp_path / "state"), str(tmp_path / "out"))
    ev = events(spark, [("a", "u", 100, 1), ("far", "u", 40 * 86_400, 7), ("farther", "u", 80 * 86_400, 9), ("late", "u", 50, 1), ("b", "u", 200, 3), ("c", "v", 10, 1)])
    _arrive(worker, ev, [["a", "far", "farther"], ["late", "b", "c"]])
    got = worker.current(spark)
    assert by_id(got, "event_count_1h") == {"a": 2, "b": 3, "c": 1, "late": 1, "far": 1, "farther": 1}
    assert by_id(got, "amount_diff_1")["far"] == 4.0 and by_id(got, "amount_diff_2")["farther"] == -2.0
    assert by_id(got, "version") == {"a": 1, "far": 1, "farther": 1, "late": 1, "b": 1, "c": 1}
    same_rows(got.drop("version"), features.build_features(ev))


def test_only_rows_a_late_one_reaches_are_corrected(spark, tmp_path):
    worker = FeatureStream(str(tmp_path / "state"), str(tmp_path / "out"))
    day = 86_400
    rows = [(f"e{k:02d}", "u", k * day // 2, k) for k in range(20)] + [("late", "u", 5 * day // 2 + 9, 4), ("other", "v", 0, 1)]
    ev = events(spark, rows)
    _arrive(worker, ev, [[r[0] for r in rows if r[0] != "late"], ["late"]])
    # one day forward, which holds more than two rows' worth of time
    assert {k for k, v in by_id(worker.current(spark), "version").items() if v == 1} == {"late", "e06", "e07"}
    same_rows(worker.current(spark).drop("version"), features.build_features(ev))


def test_any_order_of_arrival_equals_batch(spark, tmp_path, monkeypatch):
    from riskloom.streaming import features as sf

    monkeypatch.setattr(sf, "COMPACT_EVERY", 1)
    monkeypatch.setattr(sf, "NAMED_DAYS", 3)
    ev = _series(spark, 24)
    lb = labels(spark, [("u", 500, None, "fraud", 1)])
    ids = [f"e{i:03d}" for i in range(24)]
    random.Random(1).shuffle(ids)
    parts = [ids[:9], ids[9:22], ids[22:]]
    worker = FeatureStream(str(tmp_path / "s"), str(tmp_path / "o"), lb)
    _arrive(worker, ev, parts)
    _arrive(worker, ev, parts[-1:], 2)  # the last batch again
    want = features.build_features(ev, lb)
    same_rows(worker.current(spark).select(*want.columns), want)


@pytest.mark.parametrize("segment_rows", [200_000, 4])
def test_rows_that_late_ones_change(spark, segment_rows):
    """Against the definition, with an entity in one segment and in many."""
    rng, day = random.Random(7), 86_400
    at_ = sorted(rng.randrange(0, 20 * day) for _ in range(40))
    late = {rng.randrange(40) for _ in range(5)}
    rows = events(spark, [(f"e{i:02d}", "u", t, 1) for i, t in enumerate(at_)])
    names = [f"e{i:02d}" for i in late]
    rows = rows.select("source_dataset", "event_id", "entity_id", "ts", F.col("event_id").isin(names).alias("_late"), (~F.col("event_id").isin(names)).alias("_stored"))
    worker = FeatureStream("unused", "unused", limits=SkewLimits(window_rows=2_000, segment_rows=segment_rows))
    got = {r["event_id"] for r in worker._changed(rows).collect()}
    reached = {i for i, t in enumerate(at_) if any(k <= i <= k + 2 or k < i and t - at_[k] <= day for k in late)}
    assert got == {f"e{i:02d}" for i in reached - late}


def test_edges_of_days_by_one_sort(spark):
    day = 86_400
    sizes = (1, 6, 3)
    ids = [(e, d, i) for e in ("u", "v", None) for d, n in enumerate(sizes) for i in range(n)]
    rows = events(spark, [(f"{e}{d}{i}", e, d * day + (i // 2) * 60, i) for e, d, i in ids])
    plain = lambda df: sorted((str(r["entity_id"]), r["event_id"]) for r in df.collect())
    ends = stream_features._edge_rows(rows.repartition(4), in_tasks=True)
    assert plain(ends) == plain(stream_features._edge_rows(rows)) == sorted((str(e), f"{e}{d}{i}") for e, d, i in ids if min(i, sizes[d] - 1 - i) < 2)
    twice = rows.unionByName(rows)
    assert plain(stream_features._edge_rows(twice, in_tasks=True)) == plain(stream_features._edge_rows(twice))
    plan = ends._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_compacted_tails_serve_later_batches(spark, tmp_path):
    worker = FeatureStream(str(tmp_path / "state"), str(tmp_path / "out"))
    worker.process(events(spark, [("a", "u", 0, 1), ("b", "u", 10, 4)]), 49)
    worker.process(events(spark, [("x", "v", 20, 1)]), 50)
    out = worker.process(events(spark, [("c", "u", 3 * 86_400, 9)]), 51)
    row = out.first()
    assert (row["delta_1"], row["amount_diff_2"], row["event_count_24h"]) == (5.0, 2.0, 1)


def test_scoring_stream(spark, tmp_path):
    rows = features.build_features(_series(spark, 30)).withColumns(
        {"anomaly_score": F.when(F.col("amount") > 60, 0.9).otherwise(0.1), "is_anomaly": F.when(F.col("amount") > 60, 1).otherwise(0)}
    )
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows.filter("event_id < 'e015'").coalesce(1).write.parquet(src)
    rows.filter("event_id >= 'e015'").coalesce(1).write.mode("append").parquet(src)
    stats = explain.stats_dict(explain.feature_stats(rows))
    scoring = Scoring(lambda df: df, stats, {"delta_1": 1.0}, impact.rules(spark))
    run_scoring_stream(spark, src, rows.schema, scoring, out, str(tmp_path / "ck"), files_per_batch=1)
    hits = rows.filter("is_anomaly = 1").count()
    total = stream_totals(spark, out).first()
    assert (total["total_processed"], total["total_anomalies"]) == (30, hits)
    assert spark.read.parquet(f"{out}/anomalies").count() == spark.read.parquet(f"{out}/predictions").count() == hits
    assert spark.read.parquet(f"{out}/anomalies").filter("summary is null or risk_level is null").count() == 0


def test_ties_at_batch_edges_are_kept_and_copies_dropped(spark, tmp_path):
    src = str(tmp_path / "src")
    _land(events(spark, [("a", "u", 0, 1), ("b", "u", 0, 1)]), src, ["a"])
    _land(events(spark, [("a", "u", 0, 1), ("b", "u", 0, 1)]), src, ["a", "b"])
    q = (
        deduplicated(stream_events(spark, src, RAW_EVENTS, 1))
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_window_and_session_counts(spark):
    ev = events(spark, [("a", "u", 0, 1), ("b", "u", 60, 1), ("c", "u", 3600, 1), ("d", "u", 3600 + 1799, 1)])
    hourly = {r["window_start"]: r["n"] for r in counts.window_counts(ev).collect()}
    assert hourly == {at(0).replace(tzinfo=None): 2, at(3600).replace(tzinfo=None): 2}
    assert sorted(r["n"] for r in counts.session_counts(ev).collect()) == [2, 2]
    assert counts.window_counts(ev, "2 hours", "1 hour").count() == 3


def test_counts_of_open_windows_agree_with_batch(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    ev = _series(spark, 40)
    ids = [f"e{i:03d}" for i in range(40)]
    for part in (ids[:15], ids[15:18], ids[18:]):
        _land(ev, src, part)
        counts.run_count_stream(spark, src, out, ck, watermark="3650 days")
        seen = spark.read.schema(RAW_EVENTS).parquet(src)
        plain = lambda df: sorted(map(tuple, df.collect()))
        assert plain(counts.current_counts(spark, out)) == plain(counts.window_counts(seen))
