from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.operators import features as feat
from riskloom.plans.hotkeys import SkewLimits, find_hot
from tests.helpers import at, by_id, events, labels, same_rows

HOUR, DAY = 3600, 86400
LIMITS = [SkewLimits(3, 10_000), SkewLimits(2, 8), SkewLimits(2, 8, local_table_rows=0)]


def test_single_event(spark):
    row = feat.build_features(events(spark, [("a", "u", 0, 5)])).first()
    assert row["event_count_1h"] == row["event_count_24h"] == 1
    assert row["metric_mean_24h"] == 5.0 and row["metric_std_24h"] is None and row["metric_z_24h"] == 0.0
    assert row["delta_1"] is None and row["time_since_last_event_seconds"] is None and row["amount_diff_2"] is None
    assert row["pct_change_1h"] == 0.0
    assert row["hour_of_day"] == 12 and row["day_of_week"] == 0


def test_window_edges_are_inclusive(spark):
    ev = events(spark, [("a", "u", 0, 1), ("b", "u", HOUR, 1), ("c", "u", HOUR + 1e-6, 1), ("d", "u", DAY, 1), ("e", "u", DAY + 1e-6, 1)])
    counts = by_id(feat.build_features(ev), "event_count_1h", "event_count_24h")
    assert counts == {"a": (1, 1), "b": (2, 2), "c": (2, 3), "d": (1, 4), "e": (2, 4)}


def test_equal_times_count_each_other_and_order_by_id(spark):
    ev = events(spark, [("b", "u", 0, 7), ("a", "u", 0, 4), ("c", "u", 10, 1)])
    out = by_id(feat.build_features(ev), "event_count_1h", "delta_1", "pct_change_1h")
    assert out["a"][:2] == (2, None) and out["b"][:2] == (2, 3.0) and out["c"][:2] == (3, -6.0)
    assert out["b"][2] == pytest.approx(75.0) and out["c"][2] == pytest.approx(-75.0)


def test_null_and_sign_rules(spark):
    ev = events(
        spark,
        [
            ("a", "n", 0, None), ("b", "n", 10, 4), ("c", "n", 20, 8), ("d", "n", 30, None),
            ("e", "z", 0, 0), ("f", "z", 10, 4),
            ("g", "m", 0, -2), ("h", "m", 10, 4),
        ],
    )
    out = by_id(feat.build_features(ev), "pct_change_1h", "metric_z_24h", "delta_1")
    assert out["b"] == (0.0, 0.0, None)  # the window's first amount is null
    assert out["c"][0] == 0.0 and out["c"][2] == 4.0
    assert out["d"][1] is None and out["d"][2] is None  # null amount against a valid deviation
    assert out["f"][0] == 0.0 and out["h"][0] == 0.0  # first is zero, first is negative


def test_constant_amounts_have_zero_z(spark):
    ev = events(spark, [(f"e{i}", "u", i * 60, 0.1) for i in range(8)])
    for limits in [SkewLimits(), SkewLimits(2, 4)]:
        out = feat.build_features(ev, limits=limits).collect()
        assert all(r["metric_z_24h"] == 0.0 for r in out)
        assert all(r["metric_std_24h"] in (None, 0.0) for r in out)


def test_second_difference(spark):
    ev = events(spark, [("a", "u", 0, 1), ("b", "u", 1, 4), ("c", "u", 2, 9), ("d", "u", 3, 16)])
    assert by_id(feat.build_features(ev), "amount_diff_2") == {"a": None, "b": None, "c": 2.0, "d": 2.0}


def test_label_times_are_strictly_earlier(spark):
    ev = events(spark, [("a", "u", 0, 1), ("b", "u", 10, 1), ("c", "v", 10, 1)])
    lb = labels(spark, [("u", 0, None, "fraud", 1), ("u", 10, None, "fraud", 0), ("u", -5, None, "anomaly", 1)])
    for limits in [SkewLimits(), SkewLimits(1, 1)]:
        out = by_id(feat.build_features(ev, lb, limits=limits), "time_since_last_fraud_seconds", "time_since_last_anomaly_seconds")
        assert out == {"a": (None, 5.0), "b": (10.0, 15.0), "c": (None, None)}


def test_settings_switch_features_off(spark):
    import copy

    settings = copy.deepcopy(C.FEATURES)
    settings["time_windows"].append({"name": "5m", "interval": "5 minutes"})
    settings["features"]["event_counts"]["windows"] = ["5m"]
    settings["features"]["deltas"]["include_pct_change"] = False
    settings["features"]["higher_order_diffs"]["order"] = 1
    settings["features"]["seasonality"]["enabled"] = False
    out = feat.build_features(events(spark, [("a", "u", 0, 1), ("b", "u", 301, 2)]), settings=settings)
    assert "event_count_5m" in out.columns and "event_count_1h" not in out.columns
    assert not {"pct_change_1h", "amount_diff_2", "hour_of_day", "sin_daily"} & set(out.columns)
    assert by_id(out, "event_count_5m") == {"a": 1, "b": 1}


def _skewed(spark, n=240, seed=5):
    """A third of all rows on one entity, bursts, repeated times, null amounts."""
    rng = random.Random(seed)
    rows, t = [], 0.0
    for i in range(n):
        entity = "hot" if rng.random() < 0.4 else f"u{rng.randrange(6)}"
        t += rng.choice([0, 0, 1, 30, 900, 5000])
        amount = None if rng.random() < 0.15 else round(rng.uniform(-5, 100), 2)
        rows.append((f"e{rng.random():.9f}-{i}", entity, t, amount, {"event_type": rng.choice("abcd"), "status": rng.choice(["success", "fail"])}))
    rng.shuffle(rows)
    return events(spark, rows)


@pytest.mark.parametrize("limits", LIMITS)
def test_dense_plan_equals_sparse_plan(spark, limits):
    ev = _skewed(spark)
    lb = labels(spark, [("hot", 100, None, "fraud", 1), ("hot", 90_000, None, "anomaly", 1), ("u1", 50, None, "fraud", 1)])
    assert find_hot(ev.withColumn("_t", F.unix_micros("ts")), ["entity_id"], "_t", DAY, limits) is not None
    same_rows(feat.build_features(ev, lb), feat.build_features(ev, lb, limits=limits))


def test_plans_agree_on_amounts_of_any_size(spark):
    rng = random.Random(12)
    kinds = [lambda: 1e-9 * rng.random(), lambda: 1e13 * (0.5 + rng.random()), lambda: rng.choice([1e-9, 1e13, 3.5, -2e5]), lambda: 0.1, lambda: float("nan"), lambda: None]
    rows, t = [], 0.0
    for i in range(260):
        t += rng.choice([0, 1, 200, 4000])
        kind = kinds[min(i // 50, 3)] if rng.random() < 0.95 else kinds[rng.randrange(2, 6)]
        rows.append((f"e{i:03d}", "hot" if rng.random() < 0.8 else "u", t, kind()))
    one, other = (feat.build_features(events(spark, rows), limits=z).cache() for z in (SkewLimits(), SkewLimits(2, 8)))
    same_rows(one, other, tolerance=1e-12)
    cols = ["event_id", "metric_mean_24h", "metric_std_24h", "pct_change_24h"]
    same_rows(one.select(*cols), other.select(*cols), tolerance=1e-12, least=1e-30)


def test_deviation_does_not_depend_on_what_left_the_window(spark):
    """A huge amount a day ago leaves no trace, and equal amounts deviate by exactly nothing."""
    rows = [("big", "u", 0, 1e15)] + [(f"e{i}", "u", DAY + 10 + i, 0.1) for i in range(30)]
    out = {r["event_id"]: r for r in feat.build_features(events(spark, rows), limits=SkewLimits(2, 8)).collect()}
    assert all(out[f"e{i}"]["metric_std_24h"] == 0.0 and out[f"e{i}"]["metric_mean_24h"] == 0.1 for i in range(1, 30))


def test_label_rows_count_as_rows_of_their_entity(spark):
    ev = events(spark, [("a", "u", 0, 1), ("b", "v", 90, 2)])
    lb = labels(spark, [("u", i, None, "fraud", 1) for i in range(-50, 20)])
    same_rows(feat.build_features(ev, lb), feat.build_features(ev, lb, limits=SkewLimits(2, 8)))


@pytest.mark.parametrize("limits", LIMITS[1:])
def test_dense_distinct_equals_sparse(spark, limits):
    ev = _skewed(spark)
    same_rows(feat.distinct_in_window(ev), feat.distinct_in_window(ev, limits=limits))


def test_input_order_does_not_matter(spark):
    ev = _skewed(spark, 80)
    same_rows(feat.build_features(ev), feat.build_features(ev.orderBy(F.desc("event_id")).repartition(3)))


def test_empty_input(spark):
    ev = events(spark, [])
    assert feat.build_features(ev, labels(spark, [])).count() == 0
    assert feat.distinct_in_window(ev).count() == 0


def test_underscore_columns_of_the_caller_survive(spark):
    ev = events(spark, [("a", "u", 0, 1)]).withColumn("_mine", F.lit(7))
    assert feat.build_features(ev).first()["_mine"] == 7


def test_asof_cuts_time_first_and_keeps_rank(spark):
    ev = events(spark, [("a", "u", 0, 1), ("b", "u", 10, 2), ("c", "u", 20, 3), ("d", "v", 30, 4)])
    out = feat.features_asof(ev, at(10), ["u", "v"]).collect()
    assert [(r["event_id"], r["rn"], r["event_count_1h"]) for r in out] == [("b", 1, 2)]


def test_fourier_matches_math(spark):
    row = feat.build_features(events(spark, [("a", "u", 1234.5, 1)])).first()
    epoch = at(1234.5).timestamp()
    assert row["sin_hourly"] == pytest.approx(math.sin(2 * math.pi * epoch / 3600), abs=1e-9)
    assert row["cos_daily"] == pytest.approx(math.cos(2 * math.pi * epoch / 86400), abs=1e-9)


def test_sparse_plan_has_one_exchange_and_one_sort(spark):
    ev = _skewed(spark, 60)
    plan = feat.build_features(ev, labels(spark, [("hot", 1, None, "fraud", 1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("+- Sort [") == 1


def test_label_times_under_two_key_columns(spark):
    settings = {**C.FEATURES, "entity": {**C.FEATURES.get("entity", {}), "partition_columns": ["source_dataset", "entity_id"]}}
    ev = events(spark, [(f"e{i}", "u", 100.0 * i, 1) for i in range(12)] + [("x", "v", 50, 1)])
    lb = labels(spark, [("u", 0, None, "fraud", 1), ("u", 500, None, "anomaly", 1)])
    plain = feat.build_features(ev, lb)
    for limits in (SkewLimits(1000, 100_000), SkewLimits(2, 8)):
        two = feat.build_features(ev, lb, settings, limits)
        assert two.columns == plain.columns
        got, want = (by_id(df, "time_since_last_fraud_seconds", "time_since_last_anomaly_seconds", "event_count_24h") for df in (two, plain))
        assert got == want and got["e5"][0] == 500.0 and got["x"][0] is None
