"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is one of characters, of ORDER letters. Tasks count the n-grams of their texts first, so what is
shuffled is each task's distinct n-grams. All orders are tables sharded by n-gram: counts of trusted text
for the highest order, numbers of distinct left neighbours for the lower ones, with discounts from counts
of counts. The probability of every n-gram of the corpus follows from joins of these tables, order by
order. Documents then add up the log probabilities of their n-grams: from a broadcast table when the
corpus has at most LOCAL_GRAMS of them, else by a join on the n-gram. A document is kept when its
perplexity lies between two quantiles of the trusted documents of its language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_map, written
from riskloom.llm.near_join import M1, M2, mix
from riskloom.plans.small import broadcast_if_small

ORDER = 5
LOCAL_GRAMS = 4_000_000
LOCAL_IDS = 500_000
QUANTILES = (0.001, 0.99)
SLACK = 1.1
MIN_TRUSTED = 30


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each after ORDER - 1 spaces; start of each text's n-grams; their keys.

    The key at place i names the n-gram of codes [i, i + ORDER). Keys across two texts are left in; starts
    and lengths tell which count: text k owns keys [starts[k], starts[k] + len(text k)).
    """
    pad = " " * (ORDER - 1)
    joined = pad + pad.join(texts) + pad
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + ORDER - 1)[:-1]])
    wide = codes.astype(np.uint64)
    keys = np.zeros(len(codes) - ORDER + 1, np.uint64)
    for i in range(ORDER):
        keys = keys * M1 + wide[i : i + len(keys)]
    return codes, starts, mix(keys + M2)


def cleaned(texts: list[str | None]) -> list[str]:
    return [" ".join(t.lower().split()) if t else "" for t in texts]


def corpus_grams(docs: DataFrame) -> DataFrame:
    """(key, gram, n): every n-gram of rows (trusted, text); n = how often trusted text has it, perhaps 0."""

    def count(batch: pa.RecordBatch):
        texts = cleaned(batch.column(1).to_pylist())
        trusted = np.array(batch.column(0).to_pylist(), bool)
        codes, starts, keys = stream(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        own = np.arange(sizes.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        found, first, back = np.unique(keys[own], return_index=True, return_inverse=True)
        n = np.bincount(back, np.repeat(trusted, sizes).astype(float), len(found)).astype(np.int64)
        shown = codes[(own[first][:, None] + np.arange(ORDER)).ravel()].tobytes().decode("utf-32-le", "surrogatepass")
        grams = [shown[i : i + ORDER] for i in range(0, len(shown), ORDER)]
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(grams, pa.string()), pa.array(n)], names=["key", "gram", "n"])

    each = arrow_map(docs.select("trusted", "text"), count, "key long, gram string, n long")
    return each.groupBy("key", "gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts of (gram, c)."""
    n = {r.c: r.n for r in counts.filter("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (float(n.get(i, 0)) for i in (1, 2, 3, 4))
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))


def taken(c: Column, d: tuple[float, float, float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def gram_probabilities(grams: DataFrame) -> DataFrame:
    """(key, logp) of every n-gram of corpus_grams, by interpolation from the lowest order up."""
    counts = {ORDER: grams.filter("n > 0").select("gram", F.col("n").alias("c"))}
    for order in range(ORDER - 1, 0, -1):
        longer = counts[order + 1]
        counts[order] = written(longer.groupBy(F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("c")), f"quality-{order}")
    known = counts[1].count()
    last = F.substring("gram", -1, 1)
    lower = grams.select(last.alias("gram")).distinct().withColumn("p", F.lit(1.0 / (known + 1)))
    for order in range(1, ORDER + 1):
        d = discounts(counts[order])
        c = F.col("c")
        contexts = counts[order].groupBy(F.substring("gram", 1, order - 1).alias("context")).agg(
            F.sum("c").alias("total"), F.sum(taken(c, d)).alias("freed")
        )
        wanted = grams.select(F.substring("gram", -order, order).alias("gram")).distinct() if order < ORDER else grams.select("gram", "key")
        step = (
            wanted.withColumn("context", F.substring("gram", 1, order - 1))
            .withColumn("shorter", F.substring("gram", 2, order - 1) if order > 1 else F.col("gram"))
            .join(counts[order], "gram", "left")
            .join(contexts, "context", "left")
            .join(lower.withColumnsRenamed({"gram": "shorter", "p": "below"}), "shorter")
        )
        seen = F.greatest(c - taken(c, d), F.lit(0.0)) / F.col("total")
        p = F.when(F.col("total").isNull(), F.col("below")).otherwise(
            F.coalesce(seen, F.lit(0.0)) + F.col("freed") / F.col("total") * F.col("below")
        )
        lower = written(step.select(*wanted.columns, p.alias("p")), f"quality-p{order}")
    return lower.select("key", F.log("p").alias("logp"))


class Lookup:
    """Log probabilities by key: a table of slots, and a sorted search for keys that share a slot."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.logp = keys[order], logp[order].astype(np.float32)
        self.bits = np.uint64(64 - max(10, int(np.ceil(np.log2(len(keys) + 1))) + 2))
        self.slots = np.zeros(1 << (64 - int(self.bits)), np.int32)
        self.slots[(self.keys >> self.bits).astype(np.int64)] = np.arange(len(keys), dtype=np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[(keys >> self.bits).astype(np.int64)]
        wrong = np.flatnonzero(self.keys[at] != keys)
        at[wrong] = np.searchsorted(self.keys, keys[wrong])
        return self.logp[at]


def scored(docs: DataFrame, logp: DataFrame, local_grams: int = LOCAL_GRAMS) -> DataFrame:
    """(doc_id, lang, trusted, n_tokens, log_prob) of every row of (doc_id, lang, trusted, text)."""
    columns = ["doc_id", "lang", "trusted"]
    if logp.count() <= local_grams:
        table = logp.toArrow()
        sent = docs.sparkSession.sparkContext.broadcast((table["key"].to_numpy().view(np.uint64), table["logp"].to_numpy()))
        made: list[Lookup] = []

        def add_up(batch: pa.RecordBatch):
            if not made:
                made.append(Lookup(*sent.value))
            texts = cleaned(batch.column(3).to_pylist())
            _, starts, keys = stream(texts)
            sizes = np.array([len(t) for t in texts], np.int64)
            inside = np.concatenate([[0], np.cumsum(sizes)])
            own = np.arange(inside[-1]) + np.repeat(starts - inside[:-1], sizes)
            sums = np.concatenate([[0.0], np.cumsum(made[0](keys[own]), dtype=np.float64)]) if len(own) else np.zeros(1)
            total = sums[inside[1:]] - sums[inside[:-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes), pa.array(total)], names=[*columns, "n_tokens", "log_prob"])

        return arrow_map(docs.select(*columns, "text"), add_up, "doc_id long, lang string, trusted boolean, n_tokens long, log_prob double")

    def count(batch: pa.RecordBatch):
        texts = cleaned(batch.column(2).to_pylist())
        _, starts, keys = stream(texts)
        out = []
        for k, text in enumerate(texts):
            found, n = np.unique(keys[starts[k] : starts[k] + len(text)], return_counts=True)
            out.append((np.full(len(found), k), found.view(np.int64), n))
        row, key, n = (np.concatenate(c) for c in zip(*out, strict=True))
        row = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(key), pa.array(n)], names=["k1", "k2", "key", "n"])

    marked = docs.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    each = arrow_map(marked.select("k1", "k2", "text"), count, "k1 long, k2 long, key long, n long")
    # rows of equal texts add to both sums alike; what is asked for is their ratio
    sums = each.join(logp, "key").groupBy("k1", "k2").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("logp")).alias("sum"))
    size = F.length(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")))
    joined = marked.join(sums, ["k1", "k2"], "left").withColumn("n_tokens", F.coalesce(size, F.lit(0)).cast("long"))
    return joined.select(*columns, "n_tokens", F.coalesce(F.col("sum") / F.col("all") * F.col("n_tokens"), F.lit(0.0)).alias("log_prob"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents that every label calls good and none toxic."""
    bad = (F.coalesce(F.col("quality"), F.lit(0)) != 1) | (F.coalesce(F.col("toxic"), F.lit(0)) != 0)
    ids = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.agg(F.max(bad).alias("bad")).filter(~F.col("bad")).select("doc_id")


def classify(docs: DataFrame, labels: DataFrame, quantiles: tuple[float, float] = QUANTILES, local_grams: int = LOCAL_GRAMS) -> DataFrame:
    """doc_id, lang, n_tokens, log_prob, perplexity, low, high, keep of every row of documents.

    Trusted text is what labels call good (quality 1, not toxic). low and high are the quantiles of the
    trusted documents' perplexity in the row's language, SLACK apart; a language with fewer than MIN_TRUSTED
    of them, or a null one, takes those of all trusted documents. Null, empty and blank texts have no
    perplexity and are not kept. Without trusted text nothing can be judged: low and high are null and every
    text is kept. Repeated rows and rows without doc_id stay, the latter never trusted. An empty table gives
    no rows; extra columns are ignored.
    """
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    ids = broadcast_if_small(written(trusted_ids(labels), "quality-ids"), LOCAL_IDS)
    source = source.join(ids.select(F.col("doc_id").alias("good_id")), F.col("doc_id") == F.col("good_id"), "left")
    source = source.select("doc_id", "lang", F.col("good_id").isNotNull().alias("trusted"), "text")
    grams = written(corpus_grams(source), "quality-grams")
    rows = written(scored(source, gram_probabilities(grams), local_grams), "quality-scored")
    rows = rows.withColumn("perplexity", F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_prob") / F.col("n_tokens"))))
    good = rows.filter(F.col("trusted") & F.col("perplexity").isNotNull())
    limits = [F.percentile_approx("perplexity", q, 10_000).alias(n) for n, q in zip(("low", "high"), quantiles, strict=True)]
    overall = good.agg(*limits).first()
    by_lang = good.groupBy("lang").agg(F.count("*").alias("n"), *limits).filter(F.col("n") >= MIN_TRUSTED).filter(F.col("lang").isNotNull())
    by_lang = written(by_lang.drop("n"), "quality-limits")
    placed = rows.join(by_lang, "lang", "left")
    low = F.coalesce("low", F.lit(overall.low).cast("double")) / SLACK
    high = F.coalesce("high", F.lit(overall.high).cast("double")) * SLACK
    placed = placed.withColumns({"low": low, "high": high})
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return placed.select("doc_id", "lang", "n_tokens", "log_prob", "perplexity", "low", "high", keep.alias("keep"))
