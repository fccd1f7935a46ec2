"""Pigeonhole edit matching against dynamic programming over every place."""

from __future__ import annotations

import random

import pytest

from riskloom.llm import decontaminate as dc
from riskloom.llm.common import table


def fewest_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_myers_equals_dynamic_programming():
    r = random.Random(2)
    for _ in range(200):
        item = "".join(r.choice("abc") for _ in range(r.randint(1, 90)))
        text = "".join(r.choice("abc") for _ in range(r.randint(0, 60)))
        assert dc.best_end(item, text)[0] == fewest_edits(item, text)


def edited(text, n, r):
    chars = list(text)
    for _ in range(n):
        at = r.randrange(len(chars))
        r.choice([lambda: chars.__setitem__(at, "q"), lambda: chars.insert(at, "z"), lambda: chars.pop(at)])()
    return "".join(chars)


@pytest.mark.parametrize("block_chars", [400, 4_000_000])
def test_against_brute_force(spark, block_chars):
    r = random.Random(4)
    prose = lambda k: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(k))
    items = [(i, prose(r.choice([4, 15, 30]))) for i in range(12)] + [(99, None), (98, " ."), (97, "")]
    docs = []
    for i in range(60):
        item = r.choice(items[:12])[1]
        held = [prose(20)] + [edited(item, r.choice([0, 1, 3, 6, 12]), r) for _ in range(r.choice([0, 1, 1, 2]))] + [prose(5)]
        docs.append((i, r.choice([" ", ".\n", "! "]).join(held).upper() if i % 3 else held[0]))
    docs += [(100, None), (101, ""), (None, items[0][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in dc.leaks(df, bench, 0.1, block_chars).collect()}
    want = {}
    for d, text in docs:
        for i, item in items:
            if text and item and (norm := dc.normalise(item)):
                edits = fewest_edits(norm, dc.normalise(text))
                if edits <= dc.pieces(norm, 0.1)[0]:
                    want[d, i] = edits
    assert {k: x.edits for k, x in got.items()} == want and len(want) > 10
    texts, wanted = dict(docs), dict(items)
    for (d, i), x in got.items():  # the reported place is the occurrence
        assert fewest_edits(dc.normalise(wanted[i]), dc.normalise(texts[d][x.start : x.end])) == x.edits
    kept = {x.doc_id for x in dc.without_leaks(df, bench, 0.1).collect()}
    assert kept == {d for d, _ in docs if d is not None} - {d for d, _ in want}


def test_place_in_odd_text():
    text = "  İİ -- Çok, güzel!  the end  "
    norm, place = dc.normalise(text), dc.positions(text)
    assert len(norm) == len(place) and [text[p] for p in place][norm.index("the") :][:3] == ["t", "h", "e"]


def test_planted_passages(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()}
    items = {r.item_id: r.text for r in bench.collect()}
    exact = {(d.doc_id, i) for d in docs.collect() for i, t in items.items() if t in d.text}
    assert exact <= got and len(got) <= len(exact) + 2


def test_empty_tables(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    assert dc.leaks(docs.limit(0), bench).collect() == [] and dc.leaks(docs, bench.limit(0)).collect() == []
    assert dc.without_leaks(docs, bench.limit(0)).count() == docs.count()
