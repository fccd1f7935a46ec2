"""Language identification of mixed text: script ranges, word scores, Viterbi with a switching penalty.

Every word gets a score for each learned language: the sum of log probabilities of its letter trigrams
and of the word itself, all hashed into a table of fixed size. The script of a word narrows the candidates
to the languages whose training text uses that script. Viterbi then labels the words of a text, paying
SWITCH for each change of language, so that a single odd word does not break a span.

The table is counted by Spark on a bounded sample of labelled documents: about TRAIN_DOCS of each language,
drawn by hash. Only the table (BUCKETS x languages) reaches the driver.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_map

TRAIN_DOCS = 2000
MAX_LANGUAGES = 200
BUCKETS = 1 << 16
SMOOTHING = 0.1
SWITCH = 12.0
UNKNOWN = "und"

# First code points of script ranges; everything else that is a letter counts as "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
NAMES = list(SCRIPTS)
EDGES = sorted((low, high, n) for n, name in enumerate(NAMES) for low, high in SCRIPTS[name])
LOWS, HIGHS, WHICH = (np.array(x) for x in zip(*EDGES, strict=True))
OTHER = len(NAMES)

WORD = re.compile(r"[^\W\d_]+")
C1, C2, C3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def words_of(text: str) -> list[str]:
    """Lower-case words of letters; numerals that count as word characters are taken out."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    kept = ("".join(filter(str.isalpha, w)) for w in found)
    return [w for w in kept if w]


def scripts_of(codes: np.ndarray) -> np.ndarray:
    at = np.searchsorted(LOWS, codes, "right") - 1
    return np.where((at >= 0) & (codes <= HIGHS[at]), WHICH[at], OTHER)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words in a row, the first of each word, and each word's script (of its first letter).

    A word of n letters has n trigrams (its edges count as letters) and one bucket of its own.
    """
    codes = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), np.uint32)
    edge = np.flatnonzero(codes == 10)
    starts, lengths = edge[:-1] + 1, np.diff(edge) - 1
    around = (codes[:-2] * C1) ^ (codes[1:-1] * C2 + (codes[2:] * C3 << np.uint32(7)))
    trigrams = np.delete(around, edge[1:-1] - 1)  # those with an edge in the middle are none
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)  # place of each letter in its word
    letters = np.delete(codes, edge)
    placed = (letters * C2 + np.uint32(1)) * (at.astype(np.uint32) * C3 | np.uint32(1))
    whole = np.add.reduceat(placed, ends - lengths).astype(np.uint32) * C1
    buckets = np.insert(trigrams, ends, whole)
    buckets = (buckets ^ buckets >> np.uint32(15)) * C2
    buckets = (buckets >> np.uint32(16)) % np.uint32(BUCKETS)
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    return buckets, first, scripts_of(codes[starts])


class Model:
    """Log probabilities (BUCKETS x languages), and which languages use which script."""

    def __init__(self, languages: list[str], counts: np.ndarray, letters: np.ndarray, docs: np.ndarray):
        self.languages = languages
        self.table = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS)).astype(np.float32)
        if languages:
            self.table -= self.table.mean(1, keepdims=True)
        share = letters / np.maximum(1, letters.sum(0))
        self.uses = share >= 0.01  # scripts x languages
        self.common = int(docs.argmax()) if len(docs) else 0

    def score(self, words: list[str]) -> np.ndarray:
        """Words x languages; languages that do not use the word's script are far behind, unless none does."""
        buckets, first, scripts = features(words)
        scores = np.add.reduceat(self.table[buckets], first)
        uses = self.uses[scripts]
        known = uses.any(1, keepdims=True)
        return np.where(known, np.where(uses, scores, scores - 50.0), 0.0).astype(np.float32)

    def label(self, sequences: list[np.ndarray], scores: np.ndarray) -> list[np.ndarray]:
        """The best language of every word of every sequence (indices into scores), all sequences in step."""
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        lengths = np.array([len(sequences[i]) for i in order])
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(sequences)
        live = int((lengths > 0).sum())
        if not live:
            return out
        steps = int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(steps), "left")  # sequences longer than t
        flat = np.concatenate([sequences[i] for i in order[:live]])
        base = np.concatenate([[0], np.cumsum(lengths[:live])[:-1]])
        value = scores[flat[base]].copy()
        stay = np.zeros((len(flat), len(self.languages)), bool)
        came = np.zeros(len(flat), np.int64)
        for t in range(1, steps):
            n = active[t]
            at = base[:n] + t
            before = value[:n]
            best = before.argmax(1)
            switched = before[np.arange(n), best][:, None] - np.float32(SWITCH)
            stay[at] = before >= switched
            came[at] = best
            value[:n] = np.maximum(before, switched) + scores[flat[at]]
        labels = np.empty(len(flat), np.int64)
        state = value.argmax(1)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            at = base[:n] + t
            now = state[:n]
            labels[at] = now
            if t:
                state[:n] = np.where(stay[at, now], now, came[at])
        for k, i in enumerate(order[:live]):
            out[i] = labels[base[k] : base[k] + lengths[k]]
        return out


def labelled(docs: DataFrame) -> DataFrame:
    """Rows that may be learnt from: a language, a text, and a doc_id whose remainder is not held out."""
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return source.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out("doc_id"), F.lit(False)))


def held_out(column: str) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from about `train_docs` documents of each of the MAX_LANGUAGES most frequent labels."""
    known = labelled(docs)
    rows = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    languages = sorted(r.lang for r in rows)
    number = {name: i for i, name in enumerate(languages)}
    counts, letters = np.zeros((BUCKETS, len(languages))), np.zeros((OTHER + 1, len(languages)))
    size = {r.lang: r.n for r in rows}
    if not languages:
        return Model([], counts, letters, np.empty(0))
    rates = known.sparkSession.createDataFrame([(k, min(1.0, train_docs / n)) for k, n in size.items()], "lang string, rate double")
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003
    sample = known.join(F.broadcast(rates), "lang").filter(draw < F.col("rate")).select("lang", "text")

    def count(batch: pa.RecordBatch):
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).extend(words_of(text))
        for lang, words in by.items():
            if words:
                buckets, _, scripts = features(words)
                held = [*np.unique(buckets, return_counts=True)]
                seen = [*np.unique(scripts, return_counts=True)]
                ids = np.concatenate([held[0].astype(np.int64), seen[0] + BUCKETS])
                n = np.concatenate([held[1], seen[1]])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids)), pa.array(ids), pa.array(n)], names=["lang", "id", "n"])

    summed = arrow_map(sample, count, "lang string, id long, n long").groupBy("lang", "id").agg(F.sum("n").alias("n")).toArrow()
    column = np.array([number[x] for x in summed["lang"].to_pylist()], np.int64)
    ids, n = summed["id"].to_numpy(), summed["n"].to_numpy()
    own = ids < BUCKETS
    counts[ids[own], column[own]] = n[own]
    letters[ids[~own] - BUCKETS, column[~own]] = n[~own]
    return Model(languages, counts, letters, np.array([size[x] for x in languages]))


def spans_of(text: str, labels: np.ndarray, languages: list[str]) -> list[dict]:
    """Stretches of one language as code points [start, end) of the text."""
    out: list[dict] = []
    places = [m.span() for m in WORD.finditer(text) if any(map(str.isalpha, m[0].lower()))]
    for (start, end), label in zip(places, labels, strict=False):
        if out and out[-1]["lang"] == languages[label]:
            out[-1]["end"] = end
        else:
            out.append({"start": start, "end": end, "lang": languages[label]})
    return out


class Predictor:
    """Languages of a list of texts. A model travels to tasks as the plain values in it."""

    def __init__(self, values: dict):
        self.model = Model.__new__(Model)
        self.model.__dict__.update(values)

    def __call__(self, texts: list[str | None], with_spans: bool = False) -> tuple[list[str], list[float], list[list[dict]]]:
        model, number = self.model, {}
        sequences = [np.array([number.setdefault(w, len(number)) for w in words_of(t or "")], np.int64) for t in texts]
        lang, score, spans = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        if number and model.languages:
            words = list(number)
            scores = model.score(words)
            blank = ~scores.any(1)
            lengths = np.array([len(w) for w in words])
            for i, labels in enumerate(model.label(sequences, scores)):
                if len(labels):
                    own = lengths[sequences[i]]
                    told = np.bincount(labels, np.where(blank[sequences[i]], 0, own), len(model.languages))
                    best = int(told.argmax()) if told.any() else model.common
                    lang[i], score[i] = model.languages[best], float(told[best] / own.sum())
                    if with_spans:
                        spans[i] = spans_of(texts[i], labels, model.languages)
        return lang, score, spans


def identify(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score[, spans] of every row of documents.

    lang_pred is the language with most letters in the labelled spans, score its share of all letters. A
    null text, or one without letters, is `und` with score 0; so is everything if no language was learnt.
    Text in a script that no language uses takes the most frequent language, score 0. Rows without doc_id
    are predicted like others, held_out false. Repeated rows stay; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(dict(vars(model)))

    def predict(batch: pa.RecordBatch):
        lang, score, spans = Predictor(sent.value)(batch.column(2).to_pylist(), with_spans)
        arrays = [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
        names = ["doc_id", "held_out", "lang_pred", "score"]
        if with_spans:
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
            arrays, names = [*arrays, pa.array(spans, kind)], [*names, "spans"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return arrow_map(source, predict, schema + ", spans array<struct<start: long, end: long, lang: string>>" * with_spans)


def kept(docs: DataFrame, model: Model, share: float) -> DataFrame:
    """The rows of documents whose text has letters, at least `share` of them in its language. All columns stay.

    If no language was learnt, every text with letters is kept.
    """
    sent = docs.sparkSession.sparkContext.broadcast(dict(vars(model)))
    place = docs.columns.index("text")

    def choose(batch: pa.RecordBatch):
        texts = batch.column(place).to_pylist()
        if sent.value["languages"]:
            lang, score, _ = Predictor(sent.value)(texts)
            good = [x != UNKNOWN and s >= share for x, s in zip(lang, score, strict=True)]
        else:
            good = [bool(words_of(t or "")) for t in texts]
        yield batch.filter(pa.array(good, pa.bool_()))

    return arrow_map(docs, choose, docs.schema)
