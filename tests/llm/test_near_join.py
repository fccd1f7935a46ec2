"""N-gram Jaccard join against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import near_join
from riskloom.llm.common import arrow_map, components


def sets_of(text, words):
    parts = (text or "").encode().lower().split()
    if not parts:
        return set()
    width = min(words, len(parts))
    return {tuple(parts[i : i + width]) for i in range(len(parts) - width + 1)}


def brute(rows, words, percent):
    sets = [(i, sets_of(t, words)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i: (len(s), find(i)) for i, s in sets}


def planted(seed=5, n=160):
    """Copies, near copies of many degrees, chains, and one passage shared by many unlike texts."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda k: [r.choice(vocab) for _ in range(k)]
    passage, rows, base = prose(40), [], []
    for i in range(n):
        kind = r.random()
        if kind < 0.3 or not base:
            words = prose(r.choice([1, 3, 4, 5, 9, 30, 80, 300]))
            base.append(words)
        elif kind < 0.4:
            words = list(r.choice(base))
        elif kind < 0.75:
            words = list(r.choice(base))
            for _ in range(r.randint(1, max(1, len(words) // 25))):
                words[r.randrange(len(words))] = r.choice(vocab)
            base.append(words)
        else:
            words = passage + prose(r.randint(2, 25))
        rows.append((i, r.choice([" ", "\n", "\t "]).join(words)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("words,percent,bucket", [(4, 85, 2), (4, 85, 16), (1, 60, 2)])
def test_equals_brute_force(spark, monkeypatch, words, percent, bucket):
    monkeypatch.setattr(near_join, "SMALL_BUCKET", bucket)
    rows = planted()
    df = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, key string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_join.near_components(df, words, percent).collect()}
    assert got == brute(rows, words, percent)


def clump(seed: int, n: int = 90):
    """Copies of one text, most with one or two words changed: too far apart to link, but for some of them."""
    r = random.Random(seed)
    text = [f"t{i}" for i in range(64)]
    rows = []
    for i in range(n):
        words = list(text)
        for _ in range(r.choice([0, 1, 1, 1, 2, 2, 3]) if i else 1):
            words[r.randrange(0, 64, 3)] = r.choice(["x", "y", f"new{i}"])
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_group_of_near_copies(spark, monkeypatch, percent):
    monkeypatch.setattr(near_join, "SMALL_BUCKET", 2)
    rows = clump(percent)
    got = near_join.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, percent).collect()
    want = brute(rows, 4, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 1 < len({c for _, c in want.values()}) < len(rows)


def test_consensus_loses_no_link_and_lists_few_pairs(spark):
    rows = clump(7, 300)
    sets = {i: near_join.feature_set(t, 4).view("int64") for i, t in rows}
    sets = {near_join.set_key(f.view("uint64")): f.tolist() for f in sets.values()}
    df = spark.createDataFrame(list(sets.items()), "key long, features array<long>")
    groups = df.select(F.lit(1).cast("long").alias("group"), "key", F.col("key").alias("root"))
    links, pairs = ([tuple(r) for r in x.collect()] for x in near_join.consensus_pairs(groups, df, 85))
    known = {k: set(f) for k, f in sets.items()}
    near = lambda a, b: 100 * len(known[a] & known[b]) >= 85 * len(known[a] | known[b])
    assert all(near(*p) for p in links)
    star = {x for p in links for x in p}
    listed = {tuple(sorted(p)) for p in pairs}
    want = {(a, b) for a in known for b in known if a < b and near(a, b)}
    assert all(p in listed or set(p) <= star for p in want) and len(want) > 100
    assert len(listed) < len(known) ** 2 // 4


def test_signatures_never_miss_a_linked_pair():
    plan, r = near_join.Plan(85), random.Random(1)
    import numpy as np

    for size in [1, 2, 3, 5, 7, 12, 40, 200, 1500]:
        for _ in range(30):
            a = {r.getrandbits(64) for _ in range(size)}
            b = set(a)
            while True:
                c = set(b)
                if c and r.random() < 0.5:
                    c.discard(r.choice(sorted(c)))
                if r.random() < 0.5:
                    c.add(r.getrandbits(64))
                if 100 * len(a & c) < 85 * len(a | c):
                    break
                b = c
                if r.random() < 0.005:
                    break
            sa, sb = (near_join.signatures(np.array(sorted(s), np.uint64), plan) for s in (a, b))
            both = set(sa[0].tolist()) & set(sb[0].tolist())
            assert any(len([s for s in both if s % 2 == i]) > max(sa[1][i], sb[1][i]) for i in (0, 1))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a  B"), (5, "a b"), (None, "a b"), (6, "one"), (7, "x " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in near_join.near_components(df, 4, 85).collect()))
    assert got == [(-1, 1, 4), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7)]
    kept = sorted((r.doc_id or -1, r.text) for r in near_join.keep_one(df, 4, 85).collect() if r.text != "x " * 30_000)
    assert kept == [(-1, "a b"), (2, ""), (3, " \n"), (4, "A b"), (6, "one")] or (1, None) in kept


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_join.near_components(df).collect() == [] and near_join.keep_one(df).collect() == []


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(50)] + [(200, 100), (300, 200), (77, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 200: 77, 100: 77, 300: 77, 77: 77}


def test_long_unlike_texts_are_ruled_out_before_their_sets_travel(spark):
    """Histograms of 128 bins let any two texts of some thousand words pass; whole sets were then shuffled for the pair."""
    r = random.Random(3)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    one, two, short = prose(6_000), prose(6_000), prose(300)
    near = one + prose(400)  # on the other side of 2^n bins
    longer = two + prose(2_500)  # under the threshold
    worn = [w if i % 100 else f"x{w}" for i, w in enumerate(short)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((one, two, near, longer, short, worn))], "doc_id long, text string")
    signed = {x.doc_id: x for x in near_join.signed_sets(df, 5, 80).collect()}
    classes = spark.createDataFrame(
        [(x.key, x.n_shingles, x.bins, x.fine) for x in signed.values()], "key long, n long, bins binary, fine binary"
    ).persist()
    ids = {x.key: i for i, x in signed.items()}
    pairs = spark.createDataFrame([(signed[a].key, signed[b].key) for a, b in ((0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (1, 3), (4, 5))], "a long, b long")
    got = sorted((ids[x.a], ids[x.b]) for x in near_join.plausible(pairs, classes, 80).collect())
    assert got == [(0, 2), (2, 0), (4, 5)]
    assert [signed[i].fine is None for i in range(6)] == [False] * 4 + [True] * 2
    assert {len(signed[i].fine) for i in (0, 3)} == {1024, 2048}


def test_histograms_never_differ_by_more_than_the_sets():
    r = np.random.default_rng(2)
    for n, more, less in ((1_025, 30, 0), (2_040, 60, 10), (8_100, 200, 300), (9_000, 9_000, 4_000)):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.concatenate([a[less:], np.unique(r.integers(0, 2**63, more, dtype=np.uint64))])
        assert near_join.bins_apart(near_join.fine_histogram(a), near_join.fine_histogram(b)) <= less + more
    full = np.zeros(700, np.uint64)  # more than a bin can count
    assert near_join.bins_apart(near_join.histogram(full, 256), near_join.histogram(full[:600], 128)) == 0


def test_histograms_are_compared_by_one_python_worker_a_task(spark):
    """The first and the finer comparison do not fall into one stage, however small the sides are."""
    classes = spark.createDataFrame([(1, 2, bytes(near_join.BINS), None)], "key long, n long, bins binary, fine binary")
    pairs = spark.createDataFrame([(1, 1)], "a long, b long")
    found = near_join.plausible(pairs, classes, 80)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert found.collect() == [(1, 1)]


def test_batches_for_python_are_bounded_in_bytes(spark):
    """Whole texts reach a worker by about 4 MB at a time, however many rows of them there are."""

    def told(batch):
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    texts = spark.range(0, 1000, 1, 1).select(F.repeat(F.lit("0123456789"), 4000).alias("text"))
    rows = arrow_map(texts, told, "n long, size long").collect()
    assert sum(r["n"] for r in rows) == 1000
    assert max(r["size"] for r in rows) < 5_000_000
