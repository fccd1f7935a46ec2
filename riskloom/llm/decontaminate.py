"""Benchmark decontamination by pigeonhole edit matching.

Both sides are normalised: lower case, punctuation and white space to single spaces. An item may occur
with up to e = error_rate * length edits. Cut into e + 1 pieces, an occurrence with at most e edits
holds one piece unchanged. All pieces of a block of items go into one automaton that runs once over each
text; around a hit the item is verified by Myers' bit-parallel edit distance.

The benchmark is a stated query set. It is sent to the tasks in blocks of bounded size, each of which
scans the documents; a benchmark of any size works, with one scan for every BLOCK_CHARS characters.
"""

from __future__ import annotations

import string

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_map, written

ERROR_RATE = 0.05
MIN_PIECE = 12
BLOCK_CHARS = 4_000_000

APART = bytes.maketrans((string.punctuation + string.whitespace).encode(), b" " * len(string.punctuation + string.whitespace))


def normalise(text: str) -> str:
    return b" ".join(text.lower().encode().translate(APART).split()).decode()


def positions(text: str) -> list[int]:
    """For each character of normalise(text), its place in the text."""
    out: list[int] = []
    gap = True
    for at, char in enumerate(text):
        for low in char.lower():
            apart = low in string.punctuation or low in string.whitespace
            if not apart:
                out.append(at)
            elif not gap:
                out.append(at)
            gap = apart
    return out[:-1] if gap and out else out


def pieces(item: str, rate: float) -> tuple[int, list[tuple[int, str]]]:
    """Error budget and the (start, piece) list: budget + 1 pieces of nearly equal length."""
    budget = max(0, min(int(len(item) * rate), len(item) // MIN_PIECE - 1))
    edges = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return budget, [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def best_end(item: str, text: str) -> tuple[int, int]:
    """(fewest edits, end) of the item anywhere in the text, by Myers' bit vectors; the first best end."""
    where: dict[str, int] = {}
    for i, char in enumerate(item):
        where[char] = where.get(char, 0) | 1 << i
    full, last = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score = full, 0, len(item)
    best, end = score, 0
    for at, char in enumerate(text, 1):
        eq = where.get(char, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (full & ~(across | up)), up & across
        score += bool(right & last) - bool(left & last)
        right, left = right << 1 & full, left << 1 & full
        up, down = left | (full & ~((eq | down) | right)), right & (eq | down)
        if score < best:
            best, end = score, at
    return best, end


def best_match(item: str, text: str, low: int, high: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best occurrence inside text[low:high]; of equal ones the first and shortest."""
    window = text[low:high]
    edits, end = best_end(item, window)
    back_edits, back = best_end(item[::-1], window[:end][::-1])
    return edits, low + end - back, low + end


class Matcher:
    """Pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, owners = [], {}
        for item_id, item in items:
            budget, cut = pieces(item, rate)
            self.items.append((item_id, item, budget))
            for start, piece in cut:
                owners.setdefault(piece, []).append((len(self.items) - 1, start))
        self.automaton = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, start, end) of the best occurrence of each item that keeps within its budget."""
        starts: dict[int, set[int]] = {}
        for end, (length, own) in self.automaton.iter(text):
            for n, offset in own:
                starts.setdefault(n, set()).add(end + 1 - length - offset)
        out = []
        for n, places in starts.items():
            item_id, item, budget = self.items[n]
            best, done = None, -1
            for at in sorted(places):
                if at <= done:  # a neighbouring hit has looked there
                    continue
                # one window takes in hits whose places differ by no more than the budget
                done = at + budget
                low, high = max(0, at - budget), min(len(text), done + len(item) + budget)
                found = best_match(item, text, low, high)
                if found[0] <= budget and (best is None or found < best):
                    best = found
            if best:
                out.append((item_id, *best))
        return out


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, start, end) of every document that holds a benchmark item, best place each.

    start and end are code points of the document's text. Null or empty texts hold nothing; items that are
    null or normalise to nothing match nothing; items of one text are each reported. Repeated rows repeat
    their matches. Rows without doc_id report a null doc_id. Extra columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter(F.length("text") > 0)
    items = items.distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-int(total * 1.2) // block_chars)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits int, start long, end long"
    found = source.sparkSession.createDataFrame([], schema)
    if blocks > 1:
        items = written(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "bench-items")
    for block in range(blocks):
        own = items.filter(F.col("block") == block) if blocks > 1 else items
        part = [(r.item_id, n) for r in own.select("item_id", "text").toLocalIterator() if (n := normalise(r.text))]
        found = found.union(scan(source, sorted(part, key=str), rate, schema))
    return found


def scan(source: DataFrame, items: list[tuple[int, str]], rate: float, schema: str) -> DataFrame:
    """One pass over the documents for one block of items."""
    sent = source.sparkSession.sparkContext.broadcast(items)
    made: list[Matcher] = []

    def match(batch: pa.RecordBatch):
        if not made:
            made.append(Matcher(sent.value, rate))
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text:
                continue
            found = made[0].find(normalise(text))
            if found:
                place = positions(text)
                rows += [(doc, i, edits, place[start], place[end - 1] + 1) for i, edits, start, end in found if end > start]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "edits", "start", "end"]
        )

    return arrow_map(source, match, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of documents that hold no benchmark item; rows without doc_id are judged by their text alone."""
    marked = leaks(docs, benchmark, rate).select(F.col("doc_id").alias("leaked")).distinct()
    marked = written(marked, "bench-leaks")
    named = docs.join(marked, F.col("doc_id").cast("long") == F.col("leaked"), "left_anti").filter(F.col("doc_id").isNotNull())
    nameless = docs.filter(F.col("doc_id").isNull()).withColumn("text_key", F.xxhash64("text"))
    bad = leaks(nameless.drop("doc_id").withColumnRenamed("text_key", "doc_id"), benchmark, rate).select("doc_id").distinct()
    clean = nameless.join(bad.withColumnRenamed("doc_id", "text_key"), "text_key", "left_anti")
    return named.select(*docs.columns).union(clean.select(*docs.columns))
