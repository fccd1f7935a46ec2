"""Nearest neighbours: recall against brute force, exact scores, ties, copies, vectors that take no part."""

from __future__ import annotations

import numpy as np
import pytest

from riskloom.llm import neighbours
from riskloom.llm.common import table


def brute(rows, every=20, top=20):
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], float)
    out = {}
    for i, q in rows:
        if i % every == 0:
            score = (x * np.array(q, float)).sum(1)
            best = sorted((-s, j) for s, j in zip(score.tolist(), ids, strict=True) if j != i)[:top]
            out[i] = [(j, -s) for s, j in best]
    return out


def asked(df, **k):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for v in out.values():
        v.sort()
        assert [r for r, _, _ in v] == list(range(1, len(v) + 1))
    return {q: [(i, s) for _, i, s in v] for q, v in out.items()}


def test_given_vectors(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    got, want = asked(neighbours.nearest(df)), brute([(r.vec_id, r.embedding) for r in df.collect()])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_parts_and_blocks(spark, monkeypatch):
    for name, value in {"PART_SHARE": 0.4, "BLOCK": 60, "QUERY_BLOCK": 7, "SAMPLE": 700}.items():
        monkeypatch.setattr(neighbours, name, value)
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16))
    x = centres[r.integers(0, 12, 1500)] + 0.3 * r.normal(size=(1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = asked(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))), brute(rows)
    hits = 0
    for q, best in got.items():
        assert best == sorted(best, key=lambda b: (-b[1], b[0])) and q not in {i for i, _ in best}
        for i, s in best:
            assert s == pytest.approx(float(x[q] @ x[i]), abs=1e-12)
        hits += len({i for i, _ in best} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_parts_are_used_on_small_tables_and_recall_holds_for_unseen_queries():
    r = np.random.default_rng(5)
    x = r.normal(size=(1000, 24))
    router = neighbours.fit(x, 1000)
    parts = router.w2.shape[1]
    assert parts >= 7 and 1 <= router.probes <= parts
    q = r.normal(size=(200, 24))
    filed, asked = router.parts(x, 1)[:, 0], router.parts(q, router.probes)
    true = neighbours.top_ids(q @ x.T, 20)
    assert np.mean([(filed[t][:, None] == a).any(1).mean() for t, a in zip(true, asked, strict=True)]) >= 0.9


def test_copies_and_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(200 + i, [0.0, 1.0]) for i in range(3)] + [(300, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert asked(neighbours.nearest(df)) == brute(rows)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [0.0, 0.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]),
            (None, [1.0, 1.0]), (120, []), (140, [1.0]), (1, [2.0, 1.0]), (2, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, k1 string, rank int")
    assert asked(neighbours.nearest(df)) == {0: [(1, 4.0), (2, -1.0)]}
    assert neighbours.nearest(df.limit(0)).collect() == []
    assert neighbours.nearest(df.filter("vec_id = 0")).collect() == []
    assert neighbours.nearest(df.filter("vec_id = 1")).collect() == []
