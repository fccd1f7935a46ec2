"""Language-model scores from a subword lattice: the probability of a text over all its segmentations.

The vocabulary of pieces exists (a sentencepiece file) and is never trained. Its own scores give the first
weights; expectation rounds over the words of the training texts then fit a probability to each piece. The
probability of a word is the sum over all ways to spell it in pieces, by a forward recursion in log space over
the lattice; a character may also be spelt by its byte pieces, so every word has one. No piece crosses a
blank, so a text's forward recursion is the product of those of its words (each with the vocabulary's mark
of a word start in front) and of the probability of the end.

Words are counted over all documents in a map-side combined count; a word's lattice is solved once, wherever
it stands. Documents then need each of their words' scores: words that hold at least 1/FREQUENT of all
tokens, at most FREQUENT of them, travel to every task; the others, each with few rows, are joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_map, row_numbers, written

WORD_START = "▁"
FREQUENT = 200_000
FREQUENT_LETTERS = 64
COUNTS_HELD = 300_000
ROUNDS = 2
SMOOTHING = 0.1
CELLS = 1 << 16
LN10 = math.log(10)



@dataclass(frozen=True)
class Pieces:
    """Pieces that spell text, their weights to start from, and the numbers of the 256 byte pieces."""

    texts: list[str]
    weights: list[float]
    bytes: list[int]


def load_pieces(model_path: str) -> Pieces:
    """The pieces of a sentencepiece file without its control pieces.

    Scores that are log probabilities are taken as such. Where they only rank the pieces (0, -1, -2, ...: a
    vocabulary of merges), a piece's first weight is the inverse of its rank. Byte pieces have no score of
    their own there and start with the least weight.
    """
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=model_path)
    used = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    scores = [p.get_score(i) for i in used]
    ranked = all(s == round(s) for s in scores)
    weights = [1 / (2 - s) for s in scores] if ranked else [math.exp(s) for s in scores]
    names = [p.id_to_piece(i) for i in used]
    spelt = {f"<0x{b:02X}>": b for b in range(256)}
    number = {spelt[n]: k for k, (i, n) in enumerate(zip(used, names, strict=True)) if p.is_byte(i)}
    for k in number.values():
        weights[k] = min(weights)
    for b in range(256):  # a vocabulary without byte pieces gets them, at the least weight
        if b not in number:
            number[b] = len(names)
            names.append(f"<0x{b:02X}>")
            weights.append(min(weights))
    return Pieces(names, weights, [number[b] for b in range(256)])


class Lattice:
    """Lattices of many words at once. `logs` are natural logs of the pieces' probabilities."""

    def __init__(self, pieces: Pieces, logs: np.ndarray):
        self.logs, self.bytes = np.append(logs, -np.inf), np.array(pieces.bytes)
        self.last = len(logs)  # stands for "no piece"
        byte_pieces = set(pieces.bytes)
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        self.longest = 1
        for number, text in enumerate(pieces.texts):
            if number in byte_pieces:
                continue
            node = 0
            for c in text:
                node = nodes.setdefault((node, ord(c)), len(nodes) + 1)
            ends[node] = number
            self.longest = max(self.longest, len(text))
        keys = np.array([(a << 21) | c for a, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], np.fromiter(nodes.values(), np.int64, len(nodes))[order]
        self.piece = np.full(len(nodes) + 1, self.last, np.int64)
        self.piece[list(ends)] = list(ends.values())

    def chunks(self, words: list[str]) -> Iterator[np.ndarray]:
        """Numbers of words of similar length, a bounded number of letters each."""
        order = np.argsort([len(w) for w in words], kind="stable")
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * (len(words[order[end]]) + 1) <= CELLS:
                end += 1
            yield order[at:end]
            at = end

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """lengths, pieces[l - 1, word, start] (`last`: none), logs of byte spellings, letters of the words."""
        marked = [WORD_START + w for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        width = int(lengths.max())
        letters = np.full((len(marked), width), -1, np.int64)
        letters[np.arange(width) < lengths[:, None]] = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        found = np.full((min(self.longest, width), len(marked), width), self.last, np.int64)
        row, start = np.nonzero(letters >= 0)
        node = np.zeros(len(row), np.int64)
        for n in range(found.shape[0]):
            inside = start + n < lengths[row]
            row, start, node = row[inside], start[inside], node[inside]
            key = (node << 21) | letters[row, start + n]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            row, start, node = row[there], start[there], self.targets[at[there]]
            if not len(row):
                break
            found[n, row, start] = self.piece[node]
        return lengths, found, self.spelt(letters), letters

    def spelt(self, letters: np.ndarray) -> np.ndarray:
        """Log probability of every letter by its bytes; -inf beyond a word's end."""
        kinds, which = np.unique(letters, return_inverse=True)
        logs = [-np.inf if c < 0 else self.logs[self.bytes[list(chr(c).encode())]].sum() for c in kinds]
        return np.array(logs)[which.reshape(letters.shape)]

    def forward(self, arc_logs: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        """Log probability of the first j letters of every word, over all their segmentations."""
        count, width = spelt.shape
        alpha = np.full((count, width + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, width + 1):
            most = min(j, len(arc_logs))
            terms = [alpha[:, j - n] + arc_logs[n - 1, :, j - n] for n in range(1, most + 1)]
            alpha[:, j] = log_sum([*terms, alpha[:, j - 1] + spelt[:, j - 1]])
        return alpha

    def scores(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability: the sum over all its segmentations."""
        out = np.zeros(len(words))
        for some in self.chunks(words):
            lengths, found, spelt, _ = self.arcs([words[i] for i in some])
            alpha = self.forward(self.logs[found], spelt)
            out[some] = alpha[np.arange(len(some)), lengths]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """How often each piece is used in all spellings of the words, each word weighing its count."""
        total = np.zeros(self.last + 1)
        for some in self.chunks(words):
            lengths, found, spelt, letters = self.arcs([words[i] for i in some])
            arc_logs = self.logs[found]
            alpha = self.forward(arc_logs, spelt)
            count, width = spelt.shape
            beta = np.full((count, width + 1), -np.inf)
            beta[np.arange(count), lengths] = 0
            for i in range(width - 1, -1, -1):
                most = min(width - i, len(arc_logs))
                terms = [arc_logs[n - 1, :, i] + beta[:, i + n] for n in range(1, most + 1)]
                here = log_sum([*terms, spelt[:, i] + beta[:, i + 1]])
                beta[:, i] = np.where(lengths == i, 0, here)
            whole = alpha[np.arange(count), lengths]
            weight = np.log(counts[some]) - whole
            for n in range(1, len(arc_logs) + 1):
                upto = width + 1 - n
                use = np.exp(alpha[:, :upto] + arc_logs[n - 1, :, :upto] + beta[:, n:] + weight[:, None])
                total += np.bincount(found[n - 1, :, :upto].ravel(), use.ravel(), self.last + 1)
            use = np.exp(alpha[:, :width] + spelt + beta[:, 1:] + weight[:, None])
            kinds, which = np.unique(letters, return_inverse=True)
            for c, times in zip(kinds.tolist(), np.bincount(which.ravel(), use.ravel(), len(kinds)), strict=True):
                if c >= 0:
                    np.add.at(total, self.bytes[list(chr(c).encode())], times)
        return total[: self.last]


def log_sum(terms: list[np.ndarray]) -> np.ndarray:
    """Log of the sum of the exponentials of arrays of logs."""
    stacked = np.stack(terms)
    top = stacked.max(axis=0)
    with np.errstate(divide="ignore"):
        return np.where(np.isneginf(top), top, top + np.log(np.exp(stacked - np.where(np.isneginf(top), 0, top)).sum(axis=0)))


def tokens_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z as a-z. Bytes are lowered and split by ASCII letters and blanks alone."""
    return (text or "").encode().lower().split()


def held_out(column: str, parts: int = 7, part: int = 2) -> Column:
    """Whether a row is kept from training, by the checksum of its id; rows without one are not."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == part, F.lit(False))


def _sources(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out("doc_id"))


def count_words(source: DataFrame) -> DataFrame:
    """word, train, held: occurrences in training and in held-out rows of (doc_id, text, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter[bytes] = Counter()
        held: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for counts, kept in ((train, True), (held, False)):
                n, none = pa.array(list(counts.values()), pa.int64()), pa.array(np.zeros(len(counts), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), n if kept else none, none if kept else n], names=["word", "train", "held"])
                counts.clear()

        for batch in batches:
            for text, kept_out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (held if kept_out else train).update(tokens_of(text))
                if len(train) + len(held) > COUNTS_HELD:
                    yield from out()
        yield from out()

    counted = source.select("text", "held_out").mapInArrow(run, "word string, train long, held long")
    return counted.groupBy("word").agg(F.sum("train").alias("train"), F.sum("held").alias("held"))


def fit(words: DataFrame, pieces: Pieces, ends: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Natural logs of the probabilities of the pieces and of the end, from all training words.

    Each round sends the expected uses of the pieces to the driver, one number for each piece. Without
    training words the vocabulary's own weights stay.
    """
    spark = words.sparkSession
    weights = np.array(pieces.weights)
    share = weights / weights.sum()
    train = words.filter("train > 0").select("word", "train")
    uses = np.zeros(len(weights))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((tuple(vars(pieces).values()), np.log(share)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            parts, logs = sent.value
            lattice, total = Lattice(Pieces(*parts), logs), np.zeros(len(logs))
            for batch in batches:
                total += lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "uses"])

        told = train.mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.zeros(len(weights))
        for r in told:
            uses[r["piece"]] = r["uses"]
        if not told:
            break
        share = (uses + SMOOTHING) / (uses + SMOOTHING).sum()
    total = uses.sum() + ends
    end = (ends + SMOOTHING) / (total + 2 * SMOOTHING)
    return np.log(share) + math.log1p(-end), math.log(end)


def score_words(words: DataFrame, pieces: Pieces, logs: np.ndarray) -> DataFrame:
    """words with `score`, the natural log of each word's probability."""
    sent = words.sparkSession.sparkContext.broadcast((tuple(vars(pieces).values()), logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, known = sent.value
        lattice = Lattice(Pieces(*parts), known)
        for batch in batches:
            scores = pa.array(lattice.scores(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=["word", "train", "held", "score"])

    return words.select("word", "train", "held").mapInArrow(run, "word string, train long, held long, score double")


def score_documents(docs: DataFrame, pieces: Pieces, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of documents.

    Tokens are the lower-case words and one end. base_score is the log10 probability by add-one counts of
    whole tokens in the training rows, score the one by the lattice. A null or empty text has the end alone.
    Rows without doc_id are training rows. Repeated rows stay, and count as often. An empty table gives no
    rows; without training rows N = V = 0 and the vocabulary's own weights score. Other columns play no part.
    """
    spark = docs.sparkSession
    source = _sources(docs)
    rows = source.agg(F.count("*").alias("all"), F.count_if(~F.col("held_out")).alias("train")).first()
    words = written(count_words(source), "lm-words")
    sums = words.agg(F.sum("train").alias("n"), F.sum("held").alias("h"), F.count_if(F.col("train") > 0).alias("v")).first()
    n_train = (sums["n"] or 0) + rows["train"]
    n_all = n_train + (sums["h"] or 0) + rows["all"] - rows["train"]
    floor = n_train + sums["v"] + (rows["train"] > 0) + 1
    logs, end = fit(words, pieces, rows["train"], rounds)
    scored = written(score_words(words, pieces, logs), "lm-scores")
    base = F.log10((F.col("train") + 1) / F.lit(float(floor)))
    told = scored.select("word", F.col("train").cast("boolean").alias("known"), base.alias("base"), (F.col("score") / LN10).alias("score"), (F.col("train") + F.col("held")).alias("n"))

    # at most `frequent` words hold 1 / frequent of all tokens each, whatever the size of the corpus
    common = told.filter((F.col("n") * frequent >= n_all) & (F.length("word") <= FREQUENT_LETTERS)).collect()
    number = {r["word"].encode(): i for i, r in enumerate(common)}
    told_of = np.array([(r["known"], r["base"], r["score"]) for r in common], float).reshape(-1, 3)
    sent = spark.sparkContext.broadcast((number, told_of))
    end_base, end_score = math.log10((rows["train"] + 1) / floor), end / LN10

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        (number, told_of), out = sent.value, []
        for row, doc_id, text, kept_out in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts = Counter(tokens_of(text))
            times = np.fromiter(counts.values(), np.int64, len(counts))
            place = np.fromiter(map(number.get, counts, repeat(-1)), np.int64, len(counts))
            near = place >= 0
            known, base, score = times[near] @ told_of[place[near]]
            rest = [word for word, there in zip(counts, near.tolist(), strict=True) if not there]
            out.append((row, doc_id, kept_out, 1 + int(times.sum()), int(known) + rows_trained, base + end_base, score + end_score, rest, times[~near]))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PARTIAL, strict=True)]
        columns[7] = columns[7].cast(pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays(columns, names=PARTIAL.names)

    rows_trained = int(rows["train"] > 0)
    partial = written(arrow_map(row_numbers(source), run, PARTIAL_SCHEMA), "lm-rows")
    pairs = partial.select("row", F.explode(F.arrays_zip("rest", "times")).alias("p")).select("row", F.col("p.rest").alias("word"), F.col("p.times").alias("k"))
    k = F.col("k")
    joined = pairs.join(told.drop("n"), "word").groupBy("row").agg(
        F.sum(F.when(F.col("known"), k).otherwise(0)).alias("_known"), F.sum(k * F.col("base")).alias("_base"), F.sum(k * F.col("score")).alias("_score")
    )
    more = lambda c, zero: (F.col(c) + F.coalesce(f"_{c}", F.lit(zero))).alias({"base": "base_score", "known": "n_known"}.get(c, c))
    return partial.drop("rest", "times").join(joined, "row", "left").select(
        "doc_id", "held_out", "n_tokens", more("known", 0), F.lit(n_train).cast("long").alias("train_tokens"), more("base", 0.0), more("score", 0.0)
    )


PARTIAL = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("known", pa.int64()),
        ("base", pa.float64()),
        ("score", pa.float64()),
        ("rest", pa.list_(pa.binary())),
        ("times", pa.list_(pa.int64())),
    ]
)
PARTIAL_SCHEMA = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rest array<string>, times array<long>"
