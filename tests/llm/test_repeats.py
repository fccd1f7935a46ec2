"""Line and passage dedup: lines against brute force, passages in the middle of lines, offsets."""

from __future__ import annotations

import random
import re

import numpy as np

from riskloom.llm import repeats
from riskloom.llm.common import table


def prose(r, n):
    return ["".join(r.choice("abcdefghiéß") for _ in range(r.randint(1, 7))) for _ in range(n)]


def line_spans(rows):
    """Lines of enough words that repeat an earlier line, by plain means."""
    seen, out = set(), {}
    for doc, text in sorted((i, t) for i, t in rows if t and i is not None):
        for m in re.finditer(r"[^\n]+", text):
            words = m[0].lower().split()
            if len(words) >= repeats.LINE_WORDS:
                key = tuple(words)
                if key in seen:
                    at = m.start() + len(m[0]) - len(m[0].lstrip())
                    out.setdefault(doc, []).append((at, m.start() + len(m[0].rstrip())))
                seen.add(key)
    return out


def test_lines_equal_brute_force(spark):
    r = random.Random(3)
    pool = [" ".join(prose(r, r.randint(1, 12))) for _ in range(60)]
    rows = [(i, "\n".join(r.choice(["", " "]) + r.choice([str, str.upper, lambda s: s.replace(" ", "  ")])(r.choice(pool)) for _ in range(r.randint(0, 5)))) for i in range(80)]
    rows = [(i, t.replace("SS", "ß")) for i, t in rows] + [(100, None), (101, ""), (None, pool[0])]
    # no passages here: windows of lines are switched off so that only lines count
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, spans string, digest int").repartition(3)
    old, repeats.PASSAGE_WORDS = repeats.PASSAGE_WORDS, 10**6
    try:
        got = {x.doc_id: [tuple(s) for s in x.spans] for x in repeats.repeated_spans(df).collect()}
    finally:
        repeats.PASSAGE_WORDS = old
    assert got == line_spans(rows) and len(got) > 40


def test_passages_inside_lines_are_caught_and_clean_texts_left_alone(spark):
    r = random.Random(9)
    passages = [prose(r, r.randint(52, 120)) for _ in range(12)]
    rows, places = [], {}
    for i in range(90):
        before, after = prose(r, r.randint(0, 80)), prose(r, r.randint(5, 80))
        held = passages[i % 12] if i < 48 else []
        rows.append((i, " ".join(before + held + after)))
        if held:
            start = len(" ".join(before)) + bool(before)
            places[i] = (start, start + len(" ".join(held)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: [tuple(s) for s in x.spans] for x in repeats.repeated_spans(df).collect()}
    assert set(got) <= set(range(12, 48)) and len(got) >= 34
    covered = [sum(e - s for s, e in got[i]) / (places[i][1] - places[i][0]) for i in got]
    assert all(places[i][0] <= s and e <= places[i][1] for i in got for s, e in got[i]) and np.mean(covered) > 0.6
    texts, after = dict(rows), {x.doc_id: x.text for x in repeats.without_repeats(df).collect()}
    for i, t in texts.items():
        at, want = 0, ""
        for s, e in got.get(i, []):
            want, at = want + t[at:s], e
        assert after[i] == want + t[at:]


def test_copies_edges_and_report(spark, sf_dir):
    text = " ".join(prose(random.Random(1), 400))
    rows = [(5, text), (3, text), (3, text), (9, "x " * 50_000), (4, "İ " + "a b c d e f"), (6, "a B c\td e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in repeats.report(df).collect()}
    assert got[5].spans == f"0:{len(text)}" and 3 not in got and 4 not in got
    assert repeats.report(df.limit(0)).collect() == [] and repeats.without_repeats(df.limit(0)).collect() == []
    assert repeats.report(table(spark, sf_dir, "documents")).count() > 0


def test_every_passage_of_over_50_words_goes_whole(spark):
    r = random.Random(5)
    rows, want = [], {}
    for i in range(300):
        held = prose(r, r.choice([51, 51, 52, 55, 60, 90]))
        for doc in (i, 1000 + i):
            # no word beside the passage is the same in both
            before, after = [*prose(r, r.randint(0, 40)), f"{doc}x"], [f"{doc}y", *prose(r, r.randint(0, 40))]
            rows.append((doc, " ".join(before + held + after)))
            want[doc] = before + after
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.text.split() for x in repeats.without_repeats(df).collect()}
    assert all(got[i] == dict(rows)[i].split() for i in range(300))
    assert [i for i in range(1000, 1300) if got[i] != want[i]] == []


def test_scripts_without_spaces_and_few_long_words(spark):
    r = random.Random(4)
    letters = {"han": (0x4E00, 0x5E00), "kana": (0x3041, 0x3090), "thai": (0x0E01, 0x0E2E)}
    rows, want = [], {}
    for n, (low, high) in enumerate(letters.values()):
        pick = lambda k, low=low, high=high: "".join(chr(r.randrange(low, high)) for _ in range(k))
        line, passage, text = pick(12), pick(60), pick(200)
        for k in (0, 100):
            doc = k + 10 * n
            ends = [(f"{pick(20)}{i}x", f"{i}y{pick(20)}") for i in (doc, doc + 1)]
            rows += [(doc, f"{ends[0][0]}\n{line}\n{ends[0][1]}"), (doc + 1, passage.join(ends[1])), (doc + 2, text)]
            want |= {doc: "".join(ends[0]), doc + 1: "".join(ends[1]), doc + 2: ""} if k else {}
    long = "Donaudampfschifffahrtsgesellschaft Elektrizitätswerkehauptbetrieb"
    rows += [(200, f"one\n{long}\nshort line"), (201, f"two\n{long}\nshort line"), (202, "   "), (203, "日 本"), (204, "\U0010ffff")]
    want[201] = "twoshortline"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: "".join(x.text.split()) for x in repeats.without_repeats(df).collect()}
    assert {i: got[i] for i in want} == want
    assert all(got[i] == "".join(t.split()) for i, t in rows if i not in want)
