"""Periodic runs of words: scale-tiled search, one octave of periods after the other.

A run is a stretch with smallest period q (words q apart are the same), at least max(LEAST_WORDS,
LEAST_POWER * q) words long, that neither neighbouring word extends. Periods are taken by octaves
B <= q < 2B. For an octave the document is laid out in overlapping tiles of 4S words, S = 2B, around the
anchors 0, S, 2S, ...: S words before the anchor and 3S from it on. A run of the octave has an anchor c with
B equal words at c and c + q, so a tile is only sent on with the periods for which a block hash says so
(blocks double from octave to octave; a false hit is harmless, there are no false misses).

Tiles are solved on their own, whatever task they land in: Z-functions to both sides of the anchor give, for
every period at once, how far the words q apart stay equal. What reaches a tile's edge is a fragment; all
fragments of a run share at least q words with the next one's, so sorting them by (document, period) joins
them exactly. A period that a smaller divisor explains is dropped inside the tile: the fragment holds two
whole periods, which decides for the run.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_map, row_numbers, written

LEAST_WORDS = 6
LEAST_POWER = 4
WORDS_PER_BATCH = 1_000_000

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIX, JOIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

Words = Callable[[int | None, str], list[str]]


def words_of(doc_id: int | None, text: str) -> list[str]:
    """The words of a text: what stands between blanks."""
    return WORD.findall(text)


def numbered(words: list[str]) -> np.ndarray:
    """Each word as the number of its first occurrence among the distinct ones: equal numbers, equal words."""
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def tiles(ids: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(S, low, anchor, high, periods) of every tile in which a period may repeat."""
    n, block = len(ids), 1
    if n < LEAST_WORDS:
        return
    h = (ids.astype(np.uint64) + np.uint64(1)) * MIX
    h ^= h >> np.uint64(31)
    while LEAST_POWER * block <= n:
        step = 2 * block
        grid = np.zeros(-(-len(h) // step) * step, np.uint64)
        grid[: len(h)] = h
        grid = grid.reshape(-1, step)
        rows, columns = np.nonzero(grid[:, block:] == grid[:, :1])
        other = rows * step + block + columns
        sure = other < len(h)
        if block == 1:  # six words of period 1 hold an anchor followed by three more of the same
            after = np.concatenate([ids, np.full(3, -1, np.int32)])
            sure &= (after[other] == after[other + 1]) & (after[other] == after[other + 2])
        rows, columns = rows[sure], columns[sure]
        if len(rows):
            firsts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            for at, periods in zip(rows[firsts], np.split(columns + block, firsts[1:]), strict=True):
                anchor = int(at) * step
                yield step, max(0, anchor - step), anchor, min(n, anchor + 3 * step), periods
        h = (h[:-block] * JOIN + h[block:]) if len(h) > block else h[:0]
        h ^= h >> np.uint64(29)
        block = step


def z_values(s: list[int]) -> list[int]:
    """For every position the length of the longest common prefix with the whole."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def prime_parts(q: int) -> Iterator[int]:
    """q divided by each of its prime factors."""
    rest, p = q, 2
    while p * p <= rest:
        if rest % p == 0:
            yield q // p
            while rest % p == 0:
                rest //= p
        p += 1
    if rest > 1:
        yield q // rest


def solve(tile: list[int], step: int, anchor: int, periods: list[int], opened: bool, goes_on: bool) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) inside the tile of every stretch around the anchor that is a run or part of one.

    `opened` says that the document has words before the tile, `goes_on` that it has some after it.
    """
    ahead = z_values(tile[anchor:])
    reach = min(anchor + step, len(tile))
    back = z_values([*tile[:anchor][::-1], -1, *tile[:reach][::-1]])

    def stretch(q: int) -> tuple[int, int]:
        return anchor - back[1 + reach - q], anchor + q + ahead[q]

    for q in periods:
        if anchor + q >= len(tile) or ahead[q] < step // 2:
            continue  # the hash was wrong
        start, end = stretch(q)
        cut = (start == 0 and opened) or (end == len(tile) and goes_on)
        if end - start < (2 * q if cut else max(LEAST_WORDS, LEAST_POWER * q)):
            continue
        if any(low <= start and end <= high for low, high in map(stretch, prime_parts(q))):
            continue
        yield q, start, end


def _cut(docs: DataFrame, words: Words, whole: bool) -> DataFrame:
    """One row per document (kind 0) and one per tile (kind 1), in a written table; rows of a document share `row`."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for row, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = words(doc_id, text or "")
            ids = numbered(found)
            some = False
            for step, low, anchor, high, periods in tiles(ids):
                some = True
                out.append({"kind": 1, "row": row, "step": step, "low": low, "anchor": anchor - low, "goes_on": high < len(ids), "periods": periods, "tile": ids[low:high]})
                held += high - low
                if held > WORDS_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(out, CUT_ARROW)
                    out, held = [], 0
            joined = " ".join(found)
            some |= whole
            out.append({"kind": 0, "row": row, "doc_id": doc_id, "words": joined if some else None, "plain": None if some else sha(joined)})
        yield pa.RecordBatch.from_pylist(out, CUT_ARROW)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(arrow_map(row_numbers(source), run, CUT_SCHEMA), "period-tiles")


CUT_ARROW = pa.schema(
    [
        ("kind", pa.int32()),
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("words", pa.string()),
        ("plain", pa.string()),
        ("step", pa.int64()),
        ("low", pa.int64()),
        ("anchor", pa.int64()),
        ("goes_on", pa.bool_()),
        ("periods", pa.list_(pa.int32())),
        ("tile", pa.list_(pa.int32())),
    ]
)
CUT_SCHEMA = (
    "kind int, row long, doc_id long, words string, plain string, step long, low long, anchor long, goes_on boolean, "
    "periods array<int>, tile array<int>"
)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _runs(cut: DataFrame) -> DataFrame:
    """row, start, length, period of every run: tiles dealt out, solved, and their fragments joined."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for row, step, low, anchor, goes_on, periods, tile in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out += [(row, q, low + a, low + b) for q, a, b in solve(tile, step, anchor, periods, low > 0, goes_on)]
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "period", "start", "end"])

    alone = cut.filter("kind = 1").select("row", "step", "low", "anchor", "goes_on", "periods", "tile")
    # the tiles of one long document go to many tasks
    pieces = arrow_map(alone.repartition("row", "step", "low"), run, "row long, period long, start long, end long")
    in_order = Window.partitionBy("row", "period").orderBy("start", "end")
    so_far = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") > so_far - F.col("period"), F.lit(True))
    joined = (
        pieces.withColumn("_fresh", fresh.cast("int"))
        .withColumn("_run", F.sum("_fresh").over(in_order))
        .groupBy("row", "period", "_run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    length = F.col("end") - F.col("start")
    long_enough = length >= F.greatest(F.lit(LEAST_WORDS), LEAST_POWER * F.col("period"))
    return joined.filter(long_enough).select("row", "start", length.alias("length"), "period")


def _solved(docs: DataFrame, words: Words, whole: bool) -> DataFrame:
    """row, doc_id, words, plain, runs (by start, then period; null if none) of every document."""
    cut = _cut(docs, words, whole)
    each = F.sort_array(F.collect_list(F.struct("start", "period", "length")))
    runs = _runs(cut).groupBy("row").agg(each.alias("runs"))
    return cut.filter("kind = 0").select("row", "doc_id", "words", "plain").join(runs, "row", "left")


def kept_words(words: list[str], runs: list[dict]) -> list[str]:
    """Without what any run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        depth[r["start"] + r["period"]] += 1
        depth[r["start"] + r["length"]] -= 1
    return [w for w, d in zip(words, np.cumsum(depth), strict=False) if d == 0]


def _collapsed(solved: DataFrame, digest: bool) -> DataFrame:
    """doc_id, runs and the kept words joined by blanks, or their SHA-256."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, words, plain, runs = (batch.column(i).to_pylist() for i in range(4))
        text = []
        for w, p, r in zip(words, plain, runs, strict=True):
            if w is None:
                text.append(p)
                continue
            joined = " ".join(kept_words(w.split(" ") if w else [], r or []))
            text.append(sha(joined) if digest else joined)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(text, pa.string())], names=["doc_id", "runs", "text"])

    return arrow_map(
        solved.select("doc_id", "words", "plain", "runs"),
        run,
        "doc_id long, runs array<struct<start: long, period: long, length: long>>, text string",
    )


def find_runs(docs: DataFrame, words: Words = words_of) -> DataFrame:
    """doc_id, start, length, period: one row for every run of every document, starts counted in words from 0.

    Null and empty texts have no runs; rows without doc_id are searched like others; repeated rows give their
    runs once for each row; an empty table gives no rows. Other columns are not looked at.
    """
    found = _solved(docs, words, whole=False).filter("runs is not null").select("doc_id", F.explode("runs").alias("r"))
    return found.select("doc_id", "r.start", "r.length", "r.period")


def collapse(docs: DataFrame, words: Words = words_of) -> DataFrame:
    """doc_id, runs, text: every document with the repetitions of its runs taken out, words joined by one blank.

    A null or empty text gives an empty one; repeated rows and rows without doc_id stay rows of their own.
    """
    return _collapsed(_solved(docs, words, whole=True), digest=False)


def report(docs: DataFrame, words: Words = words_of) -> DataFrame:
    """Per document its number of runs, the longest one, and digests of all runs and of the collapsed text.

    Columns: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256. The longest
    run is the one with the greatest length, then the smallest start, then the smallest period; without runs
    its four columns are null. Digests are never null: those of null and empty texts are of the empty string.
    Rows without doc_id and repeated rows each give a row; an empty table gives none.
    """
    out = _collapsed(_solved(docs, words, whole=False), digest=True)
    runs = F.coalesce("runs", F.array().cast("array<struct<start: long, period: long, length: long>>"))
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.concat_ws("", F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))))
    return out.withColumn("_best", best).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        (-F.col("_best.s")).alias("start"),
        F.col("_best.l").alias("length"),
        (-F.col("_best.p")).alias("period"),
        F.expr("(1000 * _best.l) div (-_best.p)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.col("text").alias("collapsed_sha256"),
    )
