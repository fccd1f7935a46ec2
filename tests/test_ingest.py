from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from riskloom.functions.expressions import iso_utc, normalize_status, stable_event_id, uniform
from riskloom.operators import ingest
from riskloom.operators.asof import cache_lookup, cache_rows, cache_upsert
from riskloom.schema import EVENT_COLUMNS
from riskloom.sources import tables
from tests.helpers import T0, at, by_id, events, labels


def test_stable_event_id_keeps_positions_of_nulls(spark):
    df = spark.createDataFrame([("x", None), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(stable_event_id("a", "b", F.lit(3))).collect()]
    assert got == [hashlib.sha1(t.encode()).hexdigest() for t in ("x|None|3", "None|x|3")]


def test_iso_text(spark):
    df = events(spark, [("a", "u", 0, 1), ("b", "u", 0.25, 1)])
    assert [r[0] for r in df.orderBy("event_id").select(iso_utc("ts")).collect()] == [T0.isoformat(), at(0.25).isoformat()]


def test_status_words(spark):
    words = [" TRUE ", "1", "t", "Successful", "0", "F", "failed", "logon", None, ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(normalize_status("w")).collect()]
    assert got == ["success"] * 4 + ["fail"] * 3 + ["unknown"] * 3


def test_uniform_is_reproducible_and_inside(spark):
    rows = spark.range(2000).select(uniform("s", "id").alias("u"))
    low, high, mean = rows.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 < low < 0.01 and 0.99 < high < 1 and abs(mean - 0.5) < 0.03
    assert rows.collect() == rows.collect()


def test_coerce_events(spark):
    rows = [("e1", "2024-01-01 00:00:00", "u", "1.5"), ("e2", "bad", "u", "1"), ("e3", "2024-01-01T01:00:00Z", None, "1"), ("e4", "2024-01-02", "u", "n/a")]
    df = spark.createDataFrame(rows, "event_id string, ts string, entity_id string, amount string")
    fixed = {"entity_type": "user", "event_type": "x", "status": "success", "source_dataset": "S", "ingest_batch_id": "b"}
    df = df.withColumns({k: F.lit(v) for k, v in fixed.items()})
    with pytest.raises(ValueError, match="currency"):
        ingest.coerce_events(df)
    df = df.withColumns({c: F.lit(None) for c in EVENT_COLUMNS if c not in df.columns})
    df = df.withColumn("metadata", F.struct(F.lit(1).alias("a"), F.lit(None).cast("int").alias("b")))
    out = {r["event_id"]: r for r in ingest.coerce_events(df).collect()}
    assert set(out) == {"e1", "e4"}
    assert out["e1"]["amount"] == 1.5 and out["e4"]["amount"] is None
    assert out["e1"]["metadata"] == '{"a":1,"b":null}'


def test_coerce_labels_keeps_open_ends(spark):
    lb = labels(spark, [("u", 0, None, "fraud", 1), (None, 0, 5, "fraud", 1)])
    out = ingest.coerce_labels(lb).collect()
    assert len(out) == 1 and out[0]["ts_end"] is None


def test_upsert_is_idempotent_and_first_wins(spark):
    stored = events(spark, [("a", "u", 0, 1)])
    batch = events(spark, [("a", "u", 5, 9), ("b", "u", 7, 2), ("b", "u", 6, 3), ("b", "u", 8, 4)])
    once = ingest.upsert_events(stored, batch)
    assert by_id(once, "amount") == {"a": 1.0, "b": 3.0}
    twice = ingest.upsert_events(once, batch)
    assert twice.count() == 2
    other = batch.withColumn("source_dataset", F.lit("OTHER"))
    assert ingest.upsert_events(once, other).count() == 4


def test_batches_labels_and_enums(spark):
    have = spark.createDataFrame([("b1", "S", "")], "ingest_batch_id string, source_dataset string, notes string")
    more = spark.createDataFrame([("b1", "T", "x"), ("b2", "T", "y"), ("b2", "T", "z")], have.schema)
    assert sorted(tuple(r) for r in ingest.ensure_batches(have, more).collect()) == [("b1", "S", ""), ("b2", "T", "y")]
    lb = labels(spark, [("u", 0, None, "fraud", 1)])
    assert ingest.append_labels(lb, lb).count() == 2
    ev = events(spark, [("a", "u", 0, 1), ("b", "u", 0, 1, {"status": "odd"}), ("c", "u", 0, 1, {"entity_type": None})])
    good, bad = ingest.split_invalid(ev)
    assert good.count() == 1 and sorted(r["event_id"] for r in bad.collect()) == ["b", "c"]


def test_cache_round_trip(spark):
    rows = events(spark, [("a", "u", 0, 1), ("b", "u", 10, 2), ("c", "v", 5, 3)]).select("entity_id", "ts", "amount")
    cache = cache_rows(rows, "2024-04-01 00:00:00")
    newer = cache_rows(rows.filter("entity_id = 'u'").withColumn("amount", F.col("amount") * 10), "2024-04-02 00:00:00")
    merged = cache_upsert(cache, newer)
    assert merged.count() == 3
    found = {r["entity_id"]: r["features"] for r in cache_lookup(merged, at(9)).collect()}
    assert '"amount":10.0' in found["u"] and '"amount":3.0' in found["v"]
    assert cache_lookup(merged, at(-1)).count() == 0


def test_table_round_trip_prunes_by_source(spark, tmp_path):
    ev = events(spark, [("a", "u", 0, 1), ("b", "u", 0, 1, {"source_dataset": "NAB"})])
    path = str(tmp_path / "raw")
    tables.write_table(ev, path)
    tables.write_table(ev, path, mode="append")
    back = tables.read_table(spark, path, ev.schema)
    assert back.count() == 4 and back.columns == EVENT_COLUMNS
    plan = back.filter("source_dataset = 'NAB'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_dataset" in plan
    tables.write_csv(ev, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
