"""The event store: upserts against the plain operator, what is read, replays, compaction, the stream sink."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from riskloom.operators import ingest
from riskloom.sources.event_store import EventStore, run_upsert_stream
from tests.helpers import events, same_rows

KEY = ("source_dataset", "event_id")


def _rows(n, source="CERT", start=0, seconds=0):
    return [(f"id{i:05d}", f"u{i % 7}", seconds + i, i, {"source_dataset": source}) for i in range(start, start + n)]


def _all(df):
    return df.select(*sorted(df.columns))


def test_upserts_equal_the_plain_operator(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    rng = random.Random(4)
    stored = events(spark, [])
    for step in range(3):
        rows = _rows(60, rng.choice(["CERT", "NAB"]), rng.randrange(60), step) + _rows(20, "IEEE_CIS", 10 * step, 500 - step)
        batch = events(spark, rows + rng.sample(rows, 15))
        stored = ingest.upsert_events(stored, batch)
        store.upsert(batch, f"b{step}")
        same_rows(_all(store.read()), _all(stored), key=KEY)
    store.upsert(batch, "b2")  # done again
    same_rows(_all(store.read()), _all(stored), key=KEY)
    store.upsert(batch, "b3")  # everything is there
    assert store.folders().filter("delta = 'b3'").count() == 0


def test_only_touched_folders_are_read(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    store.upsert(events(spark, _rows(4000) + _rows(4000, "NAB")), "first")
    store.upsert(events(spark, _rows(4000, start=4000)), "second")
    assert {(r["source_dataset"], r["delta"], r["pages"]) for r in store.folders().collect()} == {("CERT", "first", 2), ("NAB", "first", 2), ("CERT", "second", 2)}
    touched = lambda rows: {(r["source_dataset"], r["delta"]) for r in store.suspects(events(spark, rows)).collect()}
    assert touched(_rows(5, start=100)) == {("CERT", "first")}
    assert touched(_rows(5, "NAB", start=7000)) == set() and touched(_rows(5, "IEEE_CIS")) == set()
    plan = store.new_rows(events(spark, _rows(3, start=5000)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [event_id") <= 1
    # inside the range of both folders: every stored id is suspected, hardly any other is
    ids = events(spark, [(f"id{i:05d}x", "u", 0, 1) for i in range(3000)] + _rows(300, start=1000))
    found = store.suspects(ids).select("event_id", "delta").distinct().collect()
    assert {r["event_id"] for r in found if not r["event_id"].endswith("x")} == {f"id{i:05d}" for i in range(1000, 1300)}
    assert sum(r["event_id"].endswith("x") for r in found) < 150


def test_compaction_keeps_rows_and_vacuum_deletes_what_it_replaced(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    for k in range(4):
        store.upsert(events(spark, _rows(10, start=10 * k) + (_rows(10, "NAB") if k == 0 else [])), f"d{k}")
    before = _all(store.read())
    assert store.compact("joined", 3) == ["CERT"] and store.compact("again", 3) == []
    assert {(r["source_dataset"], r["delta"]) for r in store.folders().collect()} == {("CERT", "joined"), ("NAB", "d0")}
    assert store.vacuum() == 4
    same_rows(_all(store.read()), _all(events(spark, _rows(40) + _rows(10, "NAB"))), key=KEY)
    store.upsert(events(spark, _rows(45)), "more")
    assert store.read(["CERT"]).count() == 45 and len(before.columns) == 20


def test_empty_and_invalid_batches(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0
    store.upsert(events(spark, []), "none")
    store.upsert(events(spark, [("a", None, 0, 1)]), "short")
    assert store.read().count() == 0 and store.folders().count() == 0


def test_stream_sink(spark, tmp_path):
    store, src = EventStore(spark, str(tmp_path / "store")), str(tmp_path / "src")
    for part in (_rows(30), _rows(40, start=20, seconds=9)):
        events(spark, part).coalesce(1).write.mode("append").parquet(src)
        run_upsert_stream(spark, src, store, str(tmp_path / "ck"))
    want = ingest.upsert_events(events(spark, _rows(30)), events(spark, _rows(40, start=20, seconds=9)))
    same_rows(_all(store.read()), _all(want))
    assert store.read().filter(F.col("event_id") == "id00025").count() == 1
