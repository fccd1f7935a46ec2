"""Substring dedup by line and passage hashing.

Units are the lines of a text with LINE_WORDS words or LINE_CHARS characters, and passages: stretches of at least PASSAGE_WORDS words between places that
the words themselves mark (the smallest hash among WINNOW neighbours), so that a passage copied into the
middle of another line is cut in the same places. Units are normalised (lower case, white space), hashed,
and counted over all documents; of a unit that occurs more than once the earliest stays, by doc_id and
place, and the others go. Spans are code points of the original text.

Words end at white space; in scripts written without spaces every character is a word.

A passage repeated over SURE words or more always holds a unit: a mark among its first WINNOW pairs of words,
and another among WINNOW pairs from PASSAGE_WORDS on. Outside its outermost units fewer than REACH words of it
are left on either side; these are compared word by word with those around the unit's earliest occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_map, written
from riskloom.llm.near_join import M1, M2, mix

LINE_WORDS = 5
#: Characters, white space not counted, at which fewer words make a line too.
LINE_CHARS = 30
PASSAGE_WORDS = 16
WINNOW = 17
SURE = 2 * WINNOW + PASSAGE_WORDS
REACH = 2 * WINNOW
#: Rows that ask for the same earliest occurrence are dealt to so many keys.
SALTS = 32

#: Thai and Lao, Tibetan, Myanmar, Khmer, kana and Han: written without spaces between words.
UNSPACED = np.array(
    [(0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3001, 0x30FF), (0x31F0, 0x31FF),
     (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF01, 0xFF0F), (0xFF61, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF)],
    np.uint32,
)

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def same_length_lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each word [start, end): characters times powers of their place in the word."""
    inside = np.concatenate([[0], np.cumsum(ends - starts)])
    at = np.arange(inside[-1]) - np.repeat(inside[:-1], ends - starts)
    letters = codes[at + np.repeat(starts, ends - starts)].astype(np.uint64)
    terms = mix(letters * M1 + M2) * powers(BASE, int((ends - starts).max()))[at]
    return mix(np.add.reduceat(terms, inside[:-1]))


def stretch_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One hash for each stretch of words [first, last), the same wherever it stands."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(BASE, len(words)), dtype=np.uint64)])
    return mix((sums[last] - sums[first]) * powers(INVERSE, len(words) + 1)[first] + (last - first).astype(np.uint64) * M2)


def marks(words: np.ndarray) -> np.ndarray:
    """Places between words that hold the smallest hash of some WINNOW neighbours."""
    pairs = mix(words[:-1] * M2 + words[1:])
    if len(pairs) < WINNOW:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(pairs, WINNOW)
    return np.unique(windows.argmin(1) + np.arange(len(windows)))


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, line) of every word of a text."""
    codes = np.frombuffer(same_length_lower(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0xA0) | (codes == 0x3000)
    edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(codes) and codes.max() >= UNSPACED[0, 0]:
        alone = (np.searchsorted(UNSPACED[:, 0], codes, "right") > np.searchsorted(UNSPACED[:, 1], codes)) & ~space
        between = np.flatnonzero((alone[1:] | alone[:-1]) & ~space[1:] & ~space[:-1]) + 1
        starts, ends = np.union1d(starts, between), np.union1d(ends, between)
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends, starts
    return word_hashes(codes, starts, ends), starts, ends, np.searchsorted(np.flatnonzero(codes == 10), starts)


def units_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest, start, end, words) of every line and passage of a text; words is 0 for a line."""
    words, starts, ends, line = words_of(text)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    last = np.append(first[1:], len(words))
    chars = np.concatenate([[0], np.cumsum(ends - starts)])
    long = (last - first >= LINE_WORDS) | (chars[last] - chars[first] >= LINE_CHARS)
    first, last = first[long], last[long]
    cut = marks(words)
    to = np.searchsorted(cut, cut + PASSAGE_WORDS)
    begin, finish = cut[to < len(cut)] + 1, cut[to[to < len(cut)]] + 1
    sizes = np.concatenate([np.zeros(len(first), np.int64), finish - begin])
    first, last = np.concatenate([first, begin]), np.concatenate([last, finish])
    return stretch_hashes(words, first, last), starts[first], ends[last - 1], sizes


def source_of(docs: DataFrame) -> DataFrame:
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())


def units(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, start, end, words) of every unit of every document that has an id."""

    def cut(batch: pa.RecordBatch):
        out = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            digest, start, end, words = units_of(text)
            out.append((digest.view(np.int64), np.full(len(digest), doc, np.int64), *(x.astype(np.int32) for x in (start, end, words))))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["digest", "doc_id", "start", "end", "words"])

    return arrow_map(source_of(docs), cut, "digest long, doc_id long, start int, end int, words int")


def shared_words(a: np.ndarray, b: np.ndarray) -> int:
    """How many words both begin with."""
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    return int(differs[0]) if len(differs) else n


def asked(batch: pa.RecordBatch):
    """What stands around the passages near the borders of what a document loses, and where they stand first."""
    out: list[tuple] = []
    for doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
        words, starts, ends, _ = words_of(text)
        start, end = (np.array([s[k] for s in spans], np.int64) for k in ("start", "end"))
        first, last = np.searchsorted(starts, start), np.searchsorted(ends, end) + 1
        order = np.argsort(first, kind="stable")
        reach = np.maximum.accumulate(last[order])
        new = np.append(True, first[order][1:] > reach[:-1])
        group = np.cumsum(new) - 1
        left, right = np.empty(len(spans), np.int64), np.empty(len(spans), np.int64)
        left[order] = first[order][new][group]
        right[order] = reach[np.append(new[1:], True)][group]
        near_left = (left > 0) & (first - left < REACH)
        near_right = (right < len(words)) & (right - last < REACH)
        for k in np.flatnonzero(near_left | near_right):
            s, a, b = spans[k], first[k], last[k]
            if not s["words"] or b - a != s["words"]:  # lines end where they end; another text under the same id
                continue
            low = max(0, a - REACH) if near_left[k] else a
            high = b + REACH if near_right[k] else b
            out.append(
                (s["digest"], s["first"]["doc_id"], s["first"]["start"], s["words"], doc % SALTS, doc, s["start"], s["end"])
                + (words[low:a][::-1].tobytes(), words[b:high].tobytes(), starts[low:a][::-1].tolist(), ends[b:high].tolist())
            )
    yield pa.RecordBatch.from_pylist([dict(zip(ASKED.names, x, strict=True)) for x in out], ASKED)


KEY = ["digest", "first_doc", "first_start", "words", "salt"]
ASKED = pa.schema(
    [("digest", pa.int64()), ("first_doc", pa.int64()), ("first_start", pa.int32()), ("words", pa.int32()), ("salt", pa.int32())]
    + [("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("before", pa.binary()), ("after", pa.binary())]
    + [("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]
)
ASKED_KINDS = (
    "digest long, first_doc long, first_start int, words int, salt int, doc_id long, start int, end int, before binary, after binary, "
    "starts array<int>, ends array<int>"
)


def answered(batch: pa.RecordBatch):
    """The words around each asked place of a document."""
    rows = {k: [] for k in (*KEY, "first_before", "first_after")}
    for doc, text, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
        words, starts, _, _ = words_of(text)
        at = np.searchsorted(starts, [p["first_start"] for p in places])
        to = at + np.array([p["words"] for p in places])
        fits = to <= len(words)
        digest = stretch_hashes(words, at[fits], to[fits]).view(np.int64) if fits.any() else []
        for k, d in zip(np.flatnonzero(fits), digest, strict=True):
            p, a, b = places[k], at[k], to[k]
            if p["digest"] != d:
                continue
            values = (d, doc, p["first_start"], p["words"], p["salt"], words[max(0, a - REACH) : a][::-1].tobytes(), words[b : b + REACH].tobytes())
            for name, value in zip(rows, values, strict=True):
                rows[name].append(value)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))


def extended(batch: pa.RecordBatch):
    """(doc_id, start, end) with the words that both places share on either side."""
    docs, start, end = [], [], []
    for doc, s, e, before, after, starts, ends, b, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        left = shared_words(np.frombuffer(before, np.uint64), np.frombuffer(b, np.uint64))
        right = shared_words(np.frombuffer(after, np.uint64), np.frombuffer(a, np.uint64))
        if left or right:
            docs.append(doc)
            start.append(starts[left - 1] if left else s)
            end.append(ends[right - 1] if right else e)
    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["doc_id", "start", "end"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): what repeats an earlier unit, as disjoint [(start, end)] in order.

    Documents without such a span, with a null or empty text, or without doc_id are absent. Rows that repeat
    a doc_id and text are one document. Extra columns are ignored; an empty table gives no rows.
    """
    every = written(units(docs), "repeat-units")
    counted = every.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    shared = written(every.join(written(counted, "repeat-digests"), "digest", "left_semi"), "repeat-shared")
    earliest = shared.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    later = shared.join(written(earliest, "repeat-first"), "digest").filter(F.struct("doc_id", "start") != F.col("first"))
    listed = written(later.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "words", "digest", "first")).alias("found")), "repeat-found")

    source = source_of(docs)
    requests = written(arrow_map(source.join(listed, "doc_id"), asked, ASKED_KINDS), "repeat-asked")
    places = requests.select(*KEY).distinct().groupBy("first_doc").agg(F.collect_list(F.struct("digest", "first_start", "words", "salt")).alias("places"))
    at_first = source.withColumnRenamed("doc_id", "first_doc").join(places, "first_doc")
    kinds = "digest long, first_doc long, first_start int, words int, salt int, first_before binary, first_after binary"
    answers = written(arrow_map(at_first, answered, kinds).dropDuplicates(KEY), "repeat-answers")
    sides = requests.join(answers, KEY).select("doc_id", "start", "end", "before", "after", "starts", "ends", "first_before", "first_after")
    more = arrow_map(sides, extended, "doc_id long, start int, end int")

    known = listed.select("doc_id", F.explode(F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))).alias("span"))
    both = known.union(more.select("doc_id", F.struct("start", "end").alias("span")))
    spans = both.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))
    return arrow_map(spans, joined, "doc_id long, spans array<struct<start: int, end: int>>")


def joined(batch: pa.RecordBatch):
    """Overlapping and touching spans of a document as one, in order."""
    column = batch.column(1)
    flat = column.flatten()
    start, end = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    order = np.lexsort((end, start, row))
    start, end, row = start[order].astype(np.int64), end[order].astype(np.int64), row[order]
    base = row * (int(end.max(initial=0)) + 2)  # documents apart on one line
    reach = np.maximum.accumulate(end + base)
    first = np.ones(len(start), bool)
    first[1:] = start[1:] + base[1:] > reach[:-1]
    last = np.append(first[1:], True)[: len(first)]
    counts = np.bincount(row[first], minlength=len(column))
    values = pa.StructArray.from_arrays([pa.array(start[first].astype(np.int32)), pa.array((reach - base)[last].astype(np.int32))], names=["start", "end"])
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "spans"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns of documents, repeated spans cut out of the text."""
    spans = repeated_spans(docs).select(F.col("doc_id").alias("span_id"), "spans")
    held = docs.join(spans, F.col("doc_id").cast("long") == F.col("span_id"), "left")
    text = F.col("text").cast("string")
    cut = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["start"] - acc["at"])).alias("out"), x["end"].alias("at")),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)),
    )
    return held.withColumn("text", F.when(F.col("spans").isNotNull(), cut).otherwise(text)).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_spans, n_chars, spans ("start:end,...") of every document that loses something."""
    chars = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    shown = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return repeated_spans(docs).select("doc_id", F.size("spans").cast("long").alias("n_spans"), chars.alias("n_chars"), shown.alias("spans"))
