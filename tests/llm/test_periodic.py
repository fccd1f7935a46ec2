"""Periodic runs: against every stretch of every period, over long documents, edges."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from riskloom.llm import periodic
from riskloom.llm.common import table
from riskloom.llm.queries import op12_periodic_runs

SCHEMA = "doc_id long, text string"


def plain_runs(words: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) by comparing all words q apart, for every q, smallest period first."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - at >= max(6, 4 * q):
                found.setdefault((at, end - at), q)
            at = end - q + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_words(doc_id, text):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r " else c for c in text or "").split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def plain_report(doc_id, text):
    words = plain_words(doc_id, text)
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def messy(rng: random.Random, size: int) -> list[str]:
    """Words of few kinds, with stretches repeated and now and then broken."""
    words: list[str] = []
    while len(words) < size:
        kind = rng.random()
        if kind < 0.5:
            words += [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
        else:
            unit = [rng.choice("abcd") for _ in range(rng.randrange(1, 14))]
            words += (unit * rng.randrange(2, 9))[: -rng.randrange(1, 4)]
    return words[:size]


def in_driver(words: list[str]) -> list[tuple[int, int, int]]:
    """The operator's tiles and solver without Spark: fragments joined here."""
    ids = periodic.numbered(words)
    parts: dict[int, list[tuple[int, int]]] = {}
    for step, low, anchor, high, periods in periodic.tiles(ids):
        for q, a, b in periodic.solve(ids[low:high].tolist(), step, anchor - low, periods.tolist(), low > 0, high < len(ids)):
            parts.setdefault(q, []).append((low + a, low + b))
    runs = []
    for q, spans in parts.items():
        whole = []
        for a, b in sorted(spans):
            if whole and a <= whole[-1][1] - q:
                whole[-1][1] = max(whole[-1][1], b)
            else:
                whole.append([a, b])
        runs += [(a, b - a, q) for a, b in whole if b - a >= max(6, 4 * q)]
    return sorted(runs)


def test_tiles_give_all_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        words = messy(rng, rng.randrange(0, 130))
        assert in_driver(words) == plain_runs(words), words


@pytest.mark.parametrize("unit,times,before,after", [(1, 500, 3, 5), (7, 90, 11, 0), (64, 9, 0, 31), (63, 8, 200, 17), (129, 5, 70, 1), (250, 4, 0, 0)])
def test_long_runs_are_joined_over_many_tiles(unit, times, before, after):
    rng = random.Random(unit)
    part = [f"u{i}" for i in range(unit)]
    words = [f"b{i}" for i in range(before)] + part * times + [f"a{rng.random()}" for i in range(after)]
    assert in_driver(words) == plain_runs(words)
    assert (before, unit * times, unit) in in_driver(words)


def test_z_values():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(0, 25))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert periodic.z_values(s) == want


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, folder):
    d = f"/root/testdata/{folder}"
    docs = table(spark, d, "documents").select("doc_id", "text").collect()
    got = {tuple(r) for r in op12_periodic_runs(spark, d).collect()}
    assert got == {plain_report(r["doc_id"], r["text"]) for r in docs}
    assert sum(1 for r in got if r[1]) > len(docs) // 20


def test_edges_and_other_columns(spark):
    long = " ".join(["x y z"] * 4000 + ["end"])
    rows = [(1, None), (2, ""), (2, ""), (3, " \t\r\n"), (None, "a a a a a a a"), (4, "a b " * 9), (4, "a b " * 9), (6, long)]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], SCHEMA + ", words string, runs int")
    got = sorted((tuple(r) for r in periodic.report(docs).collect()), key=str)
    nothing = hashlib.sha256(b"").hexdigest()
    blank = [(i, 0, None, None, None, None, nothing, nothing) for i in (1, 2, 2, 3)]
    assert sorted(r for r in got if r[0] in (1, 2, 3)) == blank
    assert [r[:6] for r in got if r[0] is None] == [(None, 1, 0, 7, 1, 7000)]
    assert [r[:6] for r in got if r[0] == 4] == [(4, 1, 0, 9, 1, 9000)] * 2
    assert [r[:6] for r in got if r[0] == 6] == [(6, 1, 0, 12000, 3, 4_000_000)]
    texts = {r["doc_id"]: r["text"] for r in periodic.collapse(docs).collect()}
    assert texts[6] == "x y z end" and texts[None] == "a" and texts[1] == texts[3] == ""
    assert {tuple(r) for r in periodic.find_runs(docs).collect()} == {(None, 0, 7, 1), (4, 0, 9, 1), (6, 0, 12000, 3)}
    empty = docs.limit(0)
    assert periodic.report(empty).count() == periodic.find_runs(empty).count() == periodic.collapse(empty).count() == 0


def test_periods_of_one_anchor_that_a_divisor_explains_go():
    words = ["a", "b"] * 50
    ids = periodic.numbered(words)
    kept = [q for s, low, c, high, qs in periodic.tiles(ids) for q, _, _ in periodic.solve(ids[low:high].tolist(), s, c - low, qs.tolist(), low > 0, high < 100)]
    assert set(kept) == {2}
    assert not list(periodic.tiles(np.arange(1000, dtype=np.int32)))
