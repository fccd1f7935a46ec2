"""Spelling variants: the index against all pairs, whole results against a plain version, splits, edges."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import spelling
from riskloom.llm.common import table
from riskloom.llm.queries import op13_spelling_variants


def one_edit(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) and k < len(a) else len(a) + 1 == len(b) and a[k:] == b[k + 1 :]


def edits(word: str, alphabet: str) -> set[str]:
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    made = {a + b[1:] for a, b in cut if b} | {a + c + b for a, b in cut for c in alphabet} | {a + c + b[1:] for a, b in cut if b for c in alphabet}
    return made - {word}


def plain(docs, every: int | None, letters=6, least=5, ratio=5):
    counts: Counter[str] = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= letters and n >= least}
    alphabet = "".join(sorted(set("".join(words))))
    rows, forms = {}, {}
    for w, n in words.items():
        near = [v for v in edits(w, alphabet) if v in words]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= ratio * n:
            forms[w] = best
        rows[w] = (n, len(near))
    out = set()
    for w, (n, near) in rows.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, near, words[forms[w]] if w in forms else None))
    return out


def vocabulary_of(rng: random.Random, size: int, letters: str) -> list[str]:
    words: set[str] = set()
    while len(words) < size:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 10)))
        words |= {w, *rng.sample(sorted(edits(w, letters)), 2)}
    return sorted(w for w in words if len(w) >= 6)


@pytest.mark.parametrize("letters", ["ab", "abcdé"])
def test_index_finds_all_words_that_share_the_half(letters):
    words = vocabulary_of(random.Random(3), 150, letters)
    index = spelling.Index(words)
    exact = np.array([spelling.halves(w)[0] for w in words])
    whom, what = index.near(np.arange(len(words)), exact)
    got = set(zip(whom.tolist(), what.tolist(), strict=True))
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b) and b[: exact[i]] == a[: exact[i]]}
    assert len(got) == len(whom) and got == want and len(want) > 50


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(50):
        s = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        assert spelling.suffix_order(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("shard_words", [10_000, 40, 3])
def test_shards_and_parts_change_nothing(spark, shard_words):
    words = vocabulary_of(random.Random(8), 250, "abc")
    words += [f"hothot{a}{b}" for a in "abcdefg" for b in "uvwxyz"]
    rows = [(w, 1 + i % 7) for i, w in enumerate(words)]
    got = spelling.near_words(spark.createDataFrame(rows, "word string, n long"), shard_words).collect()
    n = dict(rows)
    want = {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        if near:
            best = min(near, key=lambda v: (-n[v], v))
            want[w] = (len(near), n[best], best)
    assert {r["word"]: tuple(r)[1:] for r in got} == want


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, folder):
    d = f"/root/testdata/{folder}"
    docs = [tuple(r) for r in table(spark, d, "documents").select("doc_id", "text").collect()]
    got = [tuple(r) for r in op13_spelling_variants(spark, d).collect()]
    assert set(got) == plain(docs, 199) and len(got) == len(set(got))
    assert any(r[1] for r in got) and any(r[4] == 0 for r in got)


def test_forms_lead_on_and_edges(spark):
    texts = ["abcdef " * 1000, "abcdeg " * 150, "abcdxg " * 25, "abcyxg " * 5, "zzzzzz " * 4, "abcdefgh " * 9 + "abcdefgi " * 9, "short " * 50, None, "", "× ÷÷÷÷÷÷ " * 6]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, word string, n string")
    got = {r["word"]: tuple(r)[1:] for r in spelling.group_variants(docs).collect()}
    assert got == {
        "abcdef": (None, "abcdef", 1000, 1, None),
        "abcdeg": ("abcdef", "abcdef", 150, 2, 1000),
        "abcdxg": ("abcdeg", "abcdef", 25, 2, 150),
        "abcyxg": ("abcdxg", "abcdef", 5, 1, 25),
        "abcdefgh": (None, "abcdefgh", 9, 1, None),
        "abcdefgi": (None, "abcdefgi", 9, 1, None),
        "÷÷÷÷÷÷": (None, "÷÷÷÷÷÷", 6, 0, None),
    }
    twice = docs.union(docs)
    assert {r["word"]: r["n"] for r in spelling.group_variants(twice).collect()}["abcyxg"] == 10
    assert spelling.group_variants(docs.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "Ängstlich " * 5), (None, "x" * 30_000 + " ")] * 5, "doc_id long, text string")
    got = {r["word"]: r["n"] for r in spelling.group_variants(nameless, spelling.drop_letters(199)).collect()}
    assert got == {w: n for w, _, _, n, _, _ in plain([(None, "Ängstlich " * 5), (None, "x" * 30_000)] * 5, 199)}
