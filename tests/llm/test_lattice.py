"""Lattice scores: against all segmentations, expected uses against listing them, whole query against a plain version, edges."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import lattice
from riskloom.llm.common import table
from riskloom.llm.queries import PIECES, op11_lattice_score


def some_pieces(rng: random.Random, letters: str = "ab▁é", most: int = 3) -> lattice.Pieces:
    texts = [f"<0x{b:02X}>" for b in range(256)]
    for n in range(1, most + 1):
        texts += ["".join(p) for p in itertools.product(letters, repeat=n) if rng.random() < 0.5]
    return lattice.Pieces(texts, [rng.random() for _ in texts], list(range(256)))


def spellings(word: str, pieces: lattice.Pieces):
    """All lists of pieces that spell a word, a character also by its bytes."""
    number = {t: i for i, t in enumerate(pieces.texts) if i >= 256}
    if not word:
        yield []
        return
    for n in range(1, len(word) + 1):
        firsts = [[number[word[:n]]]] if word[:n] in number else []
        if n == 1:
            firsts.append(list(word[0].encode()))
        for first, rest in itertools.product(firsts, list(spellings(word[n:], pieces))):
            yield first + rest


def test_scores_and_uses_equal_all_segmentations():
    rng = random.Random(4)
    pieces = some_pieces(rng)
    logs = np.log(np.array(pieces.weights) / sum(pieces.weights))
    words = ["".join(rng.choice("abé▁x") for _ in range(rng.randrange(0, 7))) for _ in range(60)]
    counts = np.array([rng.randrange(1, 9) for _ in words], float)
    made = lattice.Lattice(pieces, logs)
    uses = np.zeros(len(logs))
    for word, got, count in zip(words, made.scores(words), counts, strict=True):
        ways = [(math.exp(sum(logs[p] for p in s)), s) for s in spellings("▁" + word, pieces)]
        whole = sum(w for w, _ in ways)
        assert got == pytest.approx(math.log(whole), rel=1e-12)
        for w, s in ways:
            for p in s:
                uses[p] += count * w / whole
    assert made.expected(words, counts) == pytest.approx(uses, rel=1e-9, abs=1e-12)


def test_long_words_and_chunks_change_nothing(monkeypatch):
    rng = random.Random(6)
    pieces = some_pieces(rng)
    logs = np.log(np.array(pieces.weights) / sum(pieces.weights))
    words = ["ab" * 3000, "a", "日本語", "b" * 41, "", *("ab" * k for k in range(40))]
    made = lattice.Lattice(pieces, logs)
    together = made.scores(words)
    assert np.isfinite(together).all()
    assert together == pytest.approx([made.scores([w])[0] for w in words], rel=1e-12)
    monkeypatch.setattr(lattice, "CELLS", 64)
    assert made.scores(words) == pytest.approx(together, rel=1e-12)


def test_pieces_of_the_file():
    pieces = lattice.load_pieces(PIECES)
    assert len(pieces.bytes) == 256 and pieces.texts[pieces.bytes[65]] == "<0x41>"
    assert not {"<unk>", "<s>", "</s>"} & set(pieces.texts) and min(pieces.weights) > 0


def plain_base(docs):
    rows = []
    for doc_id, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        held = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2
        rows.append((doc_id, held, [w for w in re.split("[ \t\n\v\f\r]+", low) if w] + [None]))
    counts = Counter(t for _, held, tokens in rows if not held for t in tokens)
    n, v = sum(counts.values()), len(counts)
    return counts, [
        (d, held, len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)) for d, held, tokens in rows
    ], rows


def compare(got, want):
    order = lambda r: (str(r[0]), r[2], r[5])
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize("frequent", [lattice.FREQUENT, 50])
def test_documents_equal_a_plain_version(spark, frequent):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    pieces = lattice.load_pieces(PIECES)
    got = [tuple(r) for r in lattice.score_documents(docs, pieces, frequent=frequent).collect()]
    counts, base, rows = plain_base([tuple(r) for r in docs.select("doc_id", "text").collect()])
    # the model again, in one process: the same rounds over the same counts
    words = [w for w in counts if w is not None]
    n, share = np.array([counts[w] for w in words], float), np.array(pieces.weights)
    share /= share.sum()
    for _ in range(lattice.ROUNDS):
        uses = lattice.Lattice(pieces, np.log(share)).expected(words, n)
        share = (uses + lattice.SMOOTHING) / (uses + lattice.SMOOTHING).sum()
    end = (counts[None] + lattice.SMOOTHING) / (uses.sum() + counts[None] + 2 * lattice.SMOOTHING)
    made = lattice.Lattice(pieces, np.log(share) + math.log1p(-end))
    every = sorted({t for _, _, tokens in rows for t in tokens if t is not None})
    score = dict(zip(every, made.scores(every), strict=True)) | {None: math.log(end)}
    want = [(*b, sum(score[t] for t in tokens) / math.log(10)) for b, (_, _, tokens) in zip(base, rows, strict=True)]
    compare(got, want)


def test_query_and_its_model(spark):
    d = "/root/testdata/sf0.01"
    got = [tuple(r) for r in op11_lattice_score(spark, d).collect()]
    _, want, _ = plain_base([tuple(r) for r in table(spark, d, "documents").select("doc_id", "text").collect()])
    compare([r[:6] for r in got], want)
    assert all(r[6] < 0 for r in got)
    # unseen documents are about as likely a token as seen ones, and far likelier than under the vocabulary's own weights
    share = lambda held: sum(r[6] for r in got if r[1] is held) / sum(r[2] for r in got if r[1] is held)
    assert share(True) > 1.1 * share(False)
    pieces = lattice.load_pieces(PIECES)
    raw = lattice.score_documents(table(spark, d, "documents"), pieces, rounds=0).collect()
    assert share(True) > 0.8 * sum(r["score"] for r in raw if r["held_out"]) / sum(r["n_tokens"] for r in raw if r["held_out"])


def test_edges_and_other_columns(spark):
    pieces = lattice.load_pieces(PIECES)
    rows = [(None, "a B"), (1, None), (1, None), (2, ""), (3, "a b\x85c"), (9, "日本 " * 3), (9, "日本 " * 3), (4, "z" * 5000)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, word string, score double")
    got = [tuple(r) for r in lattice.score_documents(docs, pieces).collect()]
    _, want, _ = plain_base(rows)
    compare([r[:6] for r in got], want)
    ends = {r[6] for r in got if r[0] in (1, 2)}
    assert len(ends) == 1 and all(math.isfinite(r[6]) for r in got)
    assert lattice.score_documents(docs.limit(0), pieces).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    alone = lattice.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), pieces).collect()
    assert tuple(alone[0])[:6] == (held, True, 3, 0, 0, 0.0) and alone[0]["score"] < 0
