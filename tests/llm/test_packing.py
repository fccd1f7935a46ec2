"""Packing: ids against the tokenizers library, whole documents, gapless sequences, few of them."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskloom.llm import packing
from riskloom.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　'stmdvel.,9aZ"), st.characters(codec="utf-8")), max_size=60))
def test_ids_equal_the_library(text):
    assert packing.encoder(RANKS, packing.SPECIAL).ids(text) == library_ids(text)


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|>  <|endoftext|>\n y", "<|endoftext|", "a <|endoftext|><|endoftext|>b "])
def test_special_tokens_in_a_text_are_those_of_the_library(text):
    assert packing.encoder(RANKS, packing.SPECIAL).ids(text) == library_ids(text)
    assert 50256 not in packing.encoder(RANKS, {}).ids(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "ab", "<|", "endoftext|>", "\u3000"]), max_size=8))
def test_texts_around_special_tokens(parts):
    assert packing.encoder(RANKS, packing.SPECIAL).ids("".join(parts)) == library_ids("".join(parts))


def held(rows, texts, size):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in texts.items():
        ids = np.array(library_ids(text) + [0], "<u4")
        at = 0
        pieces = sorted(by_doc.pop(doc), key=lambda r: r.piece)
        for n, r in enumerate(pieces):
            own = ids[r.start : r.start + r.length]
            assert (r.piece, r.start, r.ids_crc32) == (n, at, zlib.crc32(own.tobytes())) and len(own) == r.length
            assert r.length == size or n == 0
            at += r.length
        assert at == len(ids) and (len(pieces) == 1) == (len(ids) <= size)
    assert not by_doc
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(by_sequence)


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = packing.pack_documents(docs, RANKS).collect()
    n = held(rows, {r.doc_id: r.text for r in docs.collect()}, packing.SEQUENCE)
    assert n <= 1.01 * sum(r.length for r in rows) / packing.SEQUENCE + 1


def test_edges(spark):
    texts = {1: None, 2: "", 3: "x", 4: "word " * 30_000, 5: "<|endoftext|>"}
    df = spark.createDataFrame([(i, t, "s", 7) for i, t in texts.items()], "doc_id long, text string, sequence_id string, length int")
    assert held(packing.pack_documents(df, RANKS, 64).collect(), texts, 64) > 0
    twice = df.filter("doc_id = 3").union(df.filter("doc_id = 3"))
    assert [r.piece for r in packing.pack_documents(twice, RANKS).collect()] == [0, 0]
    assert packing.pack_documents(df.limit(0), RANKS).collect() == []
    row = packing.pack_documents(df.filter("doc_id = 3"), RANKS, with_ids=True).first()
    assert np.frombuffer(row.ids, "<u4").tolist() == library_ids("x") + [0]


@pytest.mark.parametrize("per_task,limit", [(50, 8), (10_000, 4), (10_000, 4096)])
def test_levels_and_limits(spark, per_task, limit):
    r = random.Random(3)
    lengths = [r.randint(1, 100) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    rows = packing.pack_pieces(df, 100, limit, per_task).collect()
    by = {}
    for x in rows:
        by.setdefault(x.sequence_id, []).append(x)
    assert sorted(x.doc_id for x in rows) == list(range(600))
    for xs in by.values():
        xs.sort(key=lambda x: x.offset)
        assert [x.offset for x in xs] == [sum(y.length for y in xs[:i]) for i in range(len(xs))] and sum(x.length for x in xs) <= 100
    assert len(by) <= 1.2 * sum(lengths) / 100


def test_bins_are_best_fit_and_the_fullest_closes():
    bins = packing.Bins(10, 2)
    assert [bins.place(n) for n in (7, 4, 3, 6)] == [(0, 10), (1, 10), (0, 3), (1, 6)] and bins.open == 0
    bins = packing.Bins(10, 2)
    assert [bins.place(n) for n in (7, 4, 8)] == [(0, 10), (1, 10), (2, 10)]  # bin 0 was fullest and closed
    assert bins.place(2) == (2, 2) and bins.place(5) == (1, 6)
