"""Language ID: held-out accuracy, Viterbi against all labellings, spans of mixed text, edges."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from riskloom.llm import language
from riskloom.llm.common import table


def test_features_are_those_of_each_word():
    words = ["a", "straße", "日本", "xyz", "a"]
    buckets, first, scripts = language.features(words)
    ends = [*first[1:], len(buckets)]
    assert [e - f for f, e in zip(first, ends, strict=True)] == [len(w) + 1 for w in words]
    assert [language.NAMES[s] for s in scripts] == ["latin", "latin", "han", "latin", "latin"]
    for w, f, e in zip(words, first, ends, strict=True):
        assert language.features([w])[0].tolist() == buckets[f:e].tolist()


def test_viterbi_equals_the_best_of_all_labellings():
    r = np.random.default_rng(1)
    model = language.Model(["a", "b", "c"], np.zeros((language.BUCKETS, 3)), np.ones((language.OTHER + 1, 3)), np.ones(3))
    scores = r.normal(0, 9, (30, 3)).astype(np.float32)
    sequences = [r.integers(0, 30, n) for n in (5, 0, 1, 7, 3, 7)]
    for seq, got in zip(sequences, model.label(sequences, scores), strict=True):
        value = lambda path: sum(scores[w, p] for w, p in zip(seq, path, strict=True)) - language.SWITCH * sum(a != b for a, b in itertools.pairwise(path))  # noqa: E731, B023
        assert len(got) == len(seq)
        if len(seq):
            assert value(got) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=len(seq))), abs=1e-3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, "/root/testdata/sf0.01", "documents")


@pytest.fixture(scope="module")
def model(docs):
    return language.train(docs)


def test_held_out_accuracy(docs, model):
    want = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.identify(docs, model).collect()
    held = [r for r in rows if r.held_out]
    import zlib

    assert len(rows) == len(want) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(want[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held) > 100


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark, docs, model):
    from pyspark.sql import functions as F

    wrong = docs.withColumn("lang", F.when(language.held_out("doc_id"), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    again = language.train(wrong)
    assert again.languages == model.languages and np.array_equal(again.table, model.table)


def test_spans_of_mixed_text(spark, docs, model):
    by = {}
    for r in docs.orderBy("doc_id").collect():
        by.setdefault(r.lang, []).append(r.text)
    r = random.Random(1)
    parts = [(x, " ".join(r.choice(by[x]).split()[:60])) for x in ("en", "de", "fr", "en")]
    df = spark.createDataFrame([(1, ". ".join(t for _, t in parts))], "doc_id long, text string")
    row = language.identify(df, model, with_spans=True).first()
    assert [s.lang for s in row.spans] == ["en", "de", "fr", "en"] and row.lang_pred == "en" and 0.3 < row.score < 0.7


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "12 ½ ²!"), (4, "日本語"), (None, "the and of that with"), (5, "the and that " * 30_000), (5, "und die der mit ist einer")]
    df = spark.createDataFrame([(*r, "xx", 1) for r in rows], "doc_id long, text string, lang string, score int")
    got = sorted((r.doc_id or 0, r.lang_pred, round(r.score, 2)) for r in language.identify(df, model).collect())
    assert got[:4] == [(0, "en", 1.0), (1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert got[4] == (4, "en", 0.0) and got[5:] == [(5, "de", 1.0), (5, "en", 1.0)]
    assert language.identify(df.limit(0), model).collect() == []
    nothing = language.train(df.limit(0))
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}
