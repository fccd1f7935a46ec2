from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import alerts, asof, baseline, labels as lab, narrate, timeseries
from riskloom.operators.entity_windows import entity_windows
from riskloom.plans import ranks, sampling
from riskloom.plans.hotkeys import SkewLimits, find_hot
from riskloom.plans.ranks import exact_quantiles, running_totals
from riskloom.plans.small import broadcast_if_small, local_if_small
from tests.helpers import by_id, events, labels, same_rows
from tests.test_features import _skewed

SMALL = SkewLimits(2, 8)


def test_segment_length_follows_density(spark):
    rows = [("calm", i * 86_400 * 10**6) for i in range(5)]
    rows += [("day", i * 3_600 * 10**6) for i in range(48)]
    rows += [("burst", i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, t long")
    hot = find_hot(df, ["k"], "t", 86_400, SkewLimits(10, 30))
    seg = {r["k"]: r["_seg_us"] for r in hot.table.collect()}
    assert seg == {"day": 86_400 * 10**6, "burst": 10**6}
    assert find_hot(df, ["k"], "t", 86_400) is None


def test_joins_share_the_broadcast_of_many_dense_keys(spark):
    df = spark.createDataFrame([(f"k{i % 3}", i) for i in range(60)], "k string, t long")
    hot = find_hot(df, ["k"], "t", 86_400, SkewLimits(2, 8, local_table_rows=0))
    assert not hot.small
    out = hot.tag(df, "t").unionByName(hot.tag(df.withColumn("t", F.col("t") + 1), "t"))
    assert out.count() == 120 and out.filter("_hot").count() == 120
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("BroadcastHashJoin") == 2
    assert len([line for line in plan.splitlines() if " BroadcastExchange" in line and "ReusedExchange" not in line]) == 1
    assert "InMemoryTableScan" not in plan


@pytest.mark.parametrize("range_rows", [250_000, 7])
def test_running_totals_and_quantiles_are_exact(spark, monkeypatch, range_rows):
    monkeypatch.setattr(ranks, "RANGE_ROWS", range_rows)
    rng = random.Random(3)
    # A third of all values equal; groups of very different size.
    values = [("a", 1.5 if rng.random() < 0.33 else rng.gauss(0, 10)) for _ in range(900)] + [("b", 2.0)] + [(None, 4.0), (None, 6.0)]
    df = spark.createDataFrame(values, "g string, v double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = {(r["g"], r["q"]): r["quantile"] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    for g in ("a", "b", None):
        data = [v for k, v in values if k == g]
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.quantile(data, p), abs=1e-12)
    whole = {r["q"]: r["quantile"] for r in exact_quantiles(df, [], "v", probs).collect()}
    assert whole[0.5] == pytest.approx(np.quantile([v for _, v in values], 0.5))
    for row in ranks.summary(ranks.counted(df.filter("g is not null"), ["g"], "v"), ["g"]).collect():
        data = [v for k, v in values if k == row["g"]]
        assert row["n"] == len(data) and (row["min"], row["max"]) == (min(data), max(data))
        assert row["mean"] == pytest.approx(np.mean(data), rel=1e-12)
        assert row["std"] == (pytest.approx(np.std(data, ddof=1), rel=1e-12) if len(data) > 1 else None)
    monkeypatch.setattr(ranks, "RANGE_ROWS", min(range_rows, 100))
    numbers = spark.range(1000).select(F.col("id"), F.lit(1).alias("n"))
    cum = running_totals(numbers, [], ["id"], ["n"], descending=True).collect()
    assert all(r["cum_n"] == 1000 - r["id"] for r in cum)


def _kept_writes(monkeypatch):
    """Tables that `ranks` writes from now on, by name."""
    written, cut = {}, ranks.cut_lineage

    def keep(df, name="step"):
        written.setdefault(name, []).append(cut(df, name))
        return written[name][-1]

    monkeypatch.setattr(ranks, "cut_lineage", keep)
    return written


@pytest.mark.parametrize("bracket", [2, 0])
def test_statistics_are_exact_and_count_few_values(spark, monkeypatch, bracket):
    monkeypatch.setattr(ranks, "BRACKET", bracket)  # without any width, ranks fall into gaps and a second pass counts those
    written = _kept_writes(monkeypatch)
    rng = random.Random(5)
    rows = [("a", rng.gauss(0, 10), 1.5 if rng.random() < 0.4 else float(rng.randrange(9))) for _ in range(6000)]
    rows += [("b", 2.0, None), ("b", 3.0, None), ("c", 0.1, -0.0), ("c", 0.1, 0.0), ("c", 0.1, None), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double").repartition(5)
    probs = {"p1": 0.01, "p50": 0.5, "p77": 0.77, "p100": 1.0}
    got = {(r["g"], r["feature"]): r for r in ranks.statistics(df, ["g"], ["v", "w"], probs).collect()}
    assert set(got) == {("a", "v"), ("a", "w"), ("b", "v"), ("c", "v"), ("c", "w")}
    for (g, c), row in got.items():
        data = [r[1 if c == "v" else 2] for r in rows if r[0] == g and r[1 if c == "v" else 2] is not None]
        assert row["n"] == len(data) and (row["min"], row["max"]) == (min(data), max(data))
        assert row["mean"] == pytest.approx(np.mean(data), rel=1e-9, abs=1e-9)
        assert row["std"] == pytest.approx(np.std(data, ddof=1), rel=1e-9, abs=1e-12)
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(data, p), abs=1e-12)
    assert got[("c", "v")]["std"] == 0.0
    assert len(written["counts"]) == (1 if bracket else 2)
    assert written["counts"][0].count() < 600  # of more than 6,000 distinct values
    assert ranks.statistics(df.filter("false"), [], ["v", "w"], probs).count() == 0


def test_profile_keeps_no_row_a_value(spark, monkeypatch):
    written = _kept_writes(monkeypatch)
    df = spark.range(30_000).select(F.lit("s").alias("source_dataset"), F.lit("user").alias("entity_type"), F.sqrt(F.col("id")).alias("amount"))
    row = baseline.learn_profile(df).first()
    assert row["p50"] == pytest.approx((np.sqrt(14_999) + np.sqrt(15_000)) / 2, rel=1e-12)
    assert written["counts"][0].count() < 2_000  # one for each of the 30,000 distinct values before


def test_sampling_paths_agree(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").cast("string").alias("event_id"), (F.col("id") % 3 == 0).cast("int").alias("g"))
    want = {r[0] for r in df.orderBy(F.md5("event_id"), "event_id").limit(400).collect()}
    grouped = {r[0] for r in sampling.sample_per_group(df, ["g"], 200).select("event_id").collect()}
    monkeypatch.setattr(sampling, "DIRECT_LIMIT", 10)
    assert {r[0] for r in sampling.sample_rows(df, 400).select("event_id").collect()} == want
    assert {r[0] for r in sampling.sample_per_group(df, ["g"], 200).select("event_id").collect()} == grouped
    assert sampling.sample_rows(df, 5000).count() == 3000
    assert sampling.sample_per_group(df, ["g"], 5000).count() == 3000


def test_sample_widens_when_copies_crowd_the_cut(spark, monkeypatch):
    """A third of the rows share one id, so the expected cut may hold too few or too many rows."""
    monkeypatch.setattr(sampling, "DIRECT_LIMIT", 10)
    df = spark.range(900).select(F.when(F.col("id") < 300, "copy").otherwise(F.col("id").cast("string")).alias("event_id"), F.lit(1).alias("g"), "id")
    assert sampling.sample_rows(df, 100).count() == 100
    assert sampling.sample_per_group(df, ["g"], 100).count() == 100


def test_large_samples_are_filtered_not_sorted(spark, monkeypatch):
    monkeypatch.setattr(sampling, "DIRECT_LIMIT", 20)
    df = spark.range(40_000).select(F.col("id").cast("string").alias("event_id"), "id")
    want = {r[0] for r in df.orderBy(F.md5("event_id"), "event_id").limit(25_000).collect()}
    out = sampling.sample_rows(df, 25_000)
    assert {r[0] for r in out.select("event_id").collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange rangepartitioning" not in plan and "TakeOrderedAndProject(limit=" in plan
    assert int(plan.split("TakeOrderedAndProject(limit=")[1].split(",")[0]) <= 20


def test_top_per_group_beyond_the_group_limit(spark):
    df = spark.range(6000).select("id", (F.col("id") % 2).alias("g"))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "50")
    try:
        out = sampling.top_per_group(df, ["g"], [F.desc("id")], 120)
        assert sorted(r["id"] for r in out.collect()) == list(range(5760, 6000))
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_broadcast_only_when_counted_small(spark):
    df = spark.range(10)
    assert local_if_small(df, 5) is None and local_if_small(df, 10).count() == 10
    assert "ResolvedHint (strategy=broadcast)" in broadcast_if_small(df, 10)._jdf.queryExecution().analyzed().toString()


def test_label_joins_dense_equals_sparse(spark):
    ev = _skewed(spark).withColumn(
        "ingest_batch_id", F.when(F.col("event_type") == "a", "adversarial_x").otherwise("b1")
    )
    lb = labels(
        spark,
        [
            ("hot", 100, 5000, "fraud", 1), ("hot", 4000, None, "anomaly", 1), ("hot", 0, 200_000, "fraud", 0),
            ("hot", 10**7, 10**7 + 5, "fraud", 1, "adversarial_x"), ("u1", 50, 60_000, "fraud", 1),
            ("u2", 10**7, 10**7, "anomaly", 1, "adversarial_x"), ("nobody", 0, None, "fraud", 1),
        ],
    )
    key = ["event_id", "label_type", "label_value"]
    same_rows(lab.label_interval_join(ev, lb), lab.label_interval_join(ev, lb, SMALL), key)
    same_rows(lab.label_between_join(ev, lb), lab.label_between_join(ev, lb, SMALL), ["event_id", "label_type", "label"])
    same_rows(lab.label_any(ev, lb), lab.label_any(ev, lb, SMALL))
    most = lab.label_interval_join(ev, lb).groupBy("event_id").agg(F.max("is_anomaly").alias("is_anomaly"))
    assert by_id(most, "is_anomaly") == by_id(lab.label_any(ev, lb), "is_anomaly")


def test_other_operators_dense_equals_sparse(spark):
    ev = _skewed(spark).withColumn("user_id", F.col("entity_id"))
    lb = labels(spark, [("hot", 100, None, "fraud", 1), ("hot", 90_000, None, "anomaly", 1)])
    same_rows(asof.asof_label(ev, lb), asof.asof_label(ev, lb, limits=SMALL))
    same_rows(entity_windows(ev, "user"), entity_windows(ev, "user", limits=SMALL))
    same_rows(timeseries.rolling_z(ev), timeseries.rolling_z(ev, limits=SMALL))
    same_rows(timeseries.ewma_dev(ev), timeseries.ewma_dev(ev, limits=SMALL))
    same_rows(narrate.timeline(ev), narrate.timeline(ev, limits=SMALL))


def test_dyadic_nodes_cover_every_leaf_once(spark):
    rng = random.Random(9)
    spans = [(a, a + rng.randrange(0, 200)) for a in (rng.randrange(-50, 300) for _ in range(60))] + [(0, 4095), (5, 5)]
    df = spark.createDataFrame(spans, "a long, b long")
    for r in df.select("a", "b", lab._cover(F.col("a"), F.col("b"), 13).alias("n")).collect():
        leaves = [x for n in r["n"] for x in range((n >> 6) << (n & 63), ((n >> 6) + 1) << (n & 63))]
        assert sorted(leaves) == list(range(r["a"], r["b"] + 1))
        assert len(r["n"]) <= 2 * max(1, (r["b"] - r["a"] + 1).bit_length())


def test_open_labels_are_few_rows_before_they_match(spark):
    """A label over three years of an entity is a handful of rows, not one for each day."""
    ev = events(spark, [(f"e{i}", "u", 86_400 * 3 * i, 1) for i in range(365)])
    lb = labels(spark, [("u", -5, None, "fraud", 1), ("u", 86_400 * 700, 86_400 * 701, "anomaly", 1)])
    out = lab.label_between_join(ev, lb, SMALL)
    assert out.count() == 365 and out.filter("label_type = 'fraud'").count() == 365
    nodes = spark.range(1).select(lab._cover(F.lit(7), F.lit(7 + 365 * 3 * 144), 18).alias("n")).first()["n"]
    assert len(nodes) <= 34


@pytest.mark.parametrize("alpha,segment_rows", [(0.3, 200_000), (0.3, 7), (0.9, 200_000), (0.01, 5), (0.999, 50)])
def test_ewma_over_the_whole_history(spark, alpha, segment_rows):
    rng = random.Random(2)
    rows = [(f"e{i:04d}", rng.choice(["u", "u", "u", "v"]), 60 * i, rng.choice([None, 1e-9, 1e6, rng.random(), -3.0])) for i in range(900)]
    got = by_id(timeseries.ewma_dev(events(spark, rows), alpha=alpha, limits=SkewLimits(2, segment_rows)), "ewma", "ewma_dev")
    mean = {}
    for event_id, entity, _, x in rows:
        if x is None:
            assert event_id not in got
            continue
        before = mean.get(entity)
        if before is None:
            assert got[event_id] == (None, None)
        else:
            assert got[event_id] == pytest.approx((before, abs(x - before)), rel=1e-11, abs=1e-9)
        mean[entity] = x if before is None else before * (1 - alpha) + x * alpha


def test_ewma_never_forgets(spark):
    """One huge point long ago still shows where later points are zero, beyond any cut of recent points."""
    rows = [("first", "u", 0, 1e100)] + [(f"e{i:04d}", "u", 60 * i, 0.0) for i in range(1, 1500)]
    got = by_id(timeseries.ewma_dev(events(spark, rows)), "ewma")
    for k in (1, 60, 700, 1300, 1499):
        assert got[f"e{k:04d}"] == pytest.approx(1e100 * 0.7 ** (k - 1), rel=1e-9)


def _sequential(rows, width):
    kept, last = [], {}
    for t, entity, event_id in sorted((t, e, i) for i, e, t, _ in rows):
        if entity not in last or t - last[entity] >= width:
            kept.append(event_id)
            last[entity] = t
    return sorted(kept)


@pytest.mark.parametrize("fold_rows", [2000, 5, 1])
def test_dedup_equals_sequential_rule(spark, fold_rows):
    rng = random.Random(11)
    rows = [(f"e{i:04d}", rng.choice(["hot", "hot", "u1", "u2"]), rng.randrange(0, 40 * 86_400, 600), 1) for i in range(160)]
    al = events(spark, rows).withColumn("score", F.lit(0.8))
    out = alerts.dedup_alerts(al, fold_rows=fold_rows)
    assert sorted(r["event_id"] for r in out.collect()) == _sequential(rows, 86_400)
