"""Approximate nearest neighbours by learned partitions.

On a bounded sample (SAMPLE vectors, drawn by hash) the neighbour graph is built and cut into balanced
parts that keep neighbours together. A small network learns to which parts a vector's neighbours belong.
Every vector of the table is then filed under its most probable part; a query is sent to its several most
probable parts and compared there with every vector, in double precision. How many parts that takes is
measured on the sample: the fewest that find RECALL of the sample's true neighbours.

Equal vectors are filed once with their smallest ids, so a vector that fills a third of the table is one
row. Parts are compared in blocks of bounded size on both sides, which give out one row for each query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_map, written

TOP = 20
EVERY = 20
SAMPLE = 8192
PART_SHARE = 0.25  # parts for each row under the square root
MAX_PARTS = 256
HELD = 5  # every so many sample vectors are kept out of the training
RECALL = 0.95
NEAR = 10
GRAPH_ROWS = 128
BLOCK = 16_384
QUERY_BLOCK = 4_096


def top_ids(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row."""
    k = min(k, scores.shape[1])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def graph_of(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest (inner product) of each row but itself."""
    out = []
    for at in range(0, len(x), GRAPH_ROWS):
        s = x[at : at + GRAPH_ROWS] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out.append(top_ids(s, k))
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 1.1) -> np.ndarray:
    """A part for each node: seeded by centres, then nodes move to the part of most neighbours that has room."""
    room = int(np.ceil(len(x) / parts * slack))
    centres = x[rng.choice(len(x), parts, replace=False)]
    for _ in range(8):
        own = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        for p in range(parts):
            if (own == p).any():
                centres[p] = x[own == p].mean(0)
            else:
                centres[p] = x[rng.integers(len(x))]
    fit = x @ centres.T - 0.5 * (centres**2).sum(1)
    part, load = np.full(len(x), -1), np.zeros(parts, int)
    for node in np.argsort(-fit.max(1), kind="stable"):
        for p in np.argsort(-fit[node], kind="stable"):
            if load[p] < room:
                part[node] = p
                load[p] += 1
                break
    links = [[] for _ in x]
    for a, row in enumerate(near.tolist()):
        for b in row:
            links[a].append(b)
            links[b].append(a)
    for _ in range(10):
        moved = 0
        for node in rng.permutation(len(x)).tolist():
            votes = np.bincount(part[links[node]], minlength=parts)
            for p in np.argsort(-votes, kind="stable")[:4].tolist():
                if votes[p] <= votes[part[node]]:
                    break
                if load[p] < room:
                    load[part[node]] -= 1
                    load[p] += 1
                    part[node] = p
                    moved += 1
                    break
        if moved < len(x) // 200:
            break
    return part


@dataclass
class Router:
    """One hidden layer; `probes` parts are asked for each query."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        length = np.sqrt((x * x).sum(1, keepdims=True))
        return np.maximum(x / np.maximum(length, 1e-300) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def parts(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def trained(x: np.ndarray, targets: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 40) -> Router:
    """Softmax regression with one hidden layer on soft targets, by Adam."""
    shape = [(x.shape[1], hidden), (hidden,), (hidden, targets.shape[1]), (targets.shape[1],)]
    w = [rng.normal(0, np.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s) for s in shape]
    m, v, step = [np.zeros(s) for s in shape], [np.zeros(s) for s in shape], 0
    unit = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            a = np.maximum(unit[rows] @ w[0] + w[1], 0)
            z = a @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - targets[rows]) / len(rows)
            back = d @ w[2].T * (a > 0)
            step += 1
            for i, g in enumerate([unit[rows].T @ back, back.sum(0), a.T @ d, d.sum(0)]):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= 2e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*w, probes=1)


def fit(x: np.ndarray, rows: int, seed: int = 7) -> Router:
    """Parts and router from a sample; `rows` is the size of the whole table."""
    rng = np.random.default_rng(seed)
    parts = int(max(1, min(MAX_PARTS, math.isqrt(rows) * PART_SHARE, len(x) // 32)))
    if parts == 1:
        n = x.shape[1]
        return Router(np.zeros((n, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    held = np.arange(len(x)) % HELD == 0
    own = x[~held]
    near = graph_of(own, min(NEAR, len(own) - 1))
    part = balanced_parts(own, near, parts, rng)
    targets = np.zeros((len(own), parts))
    np.add.at(targets, (np.arange(len(own))[:, None], part[near]), 1 / near.shape[1])
    targets[np.arange(len(own)), part] += 0.5
    router = trained(own, targets / targets.sum(1, keepdims=True), rng)
    # probes: the rank, among an unseen query's parts, of the part that each true neighbour is filed under
    filed, asked = router.parts(x, 1)[:, 0], router.parts(x[held], parts)
    place = np.empty_like(asked)
    np.put_along_axis(place, asked, np.arange(parts)[None, :], 1)
    true = graph_of(x, min(TOP, len(x) - 1))[held]
    needed = np.sort(np.take_along_axis(place, filed[true], 1).ravel())
    router.probes = int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1
    return router


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, and a 128-bit key (k1, k2) of the vector; what takes no part is left out."""
    kind = "array<double>" if "double" in vectors.schema["embedding"].dataType.simpleString() else "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    some = F.exists("embedding", lambda v: v != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & some)
    return rows.withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(1), "embedding")})


def matrix(table: pa.Table, column: str = "embedding") -> np.ndarray:
    flat = table[column].combine_chunks()
    values = (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def sample_of(classes: DataFrame, rows: int) -> np.ndarray:
    draw = F.pmod(F.col("k1"), F.lit(1_000_003)) / 1_000_003
    got = classes.filter(draw < min(1.0, 1.2 * SAMPLE / max(1, rows))).select("k1", "k2", "embedding").orderBy("k1", "k2").limit(SAMPLE)
    return matrix(got.toArrow())


def nearest(vectors: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest found of each row whose vec_id is divisible by `every`.

    Nearest is the largest inner product, ties go to the smaller vec_id; the query's own row is no
    candidate, copies of it are. Vectors that are null, zero, or hold null or non-finite components take
    no part, nor do rows without vec_id or with another length than most. A vec_id that occurs in several
    rows stands for each of them, and one row of another's id and equal vector counts once. An empty table,
    or one without queries or candidates, gives no rows. Extra columns are ignored.
    """
    rows = clean(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("embedding") == sizes[0].d)
    first = Window.partitionBy("k1", "k2").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= top + 1)
    classes = few.groupBy("k1", "k2").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    classes = written(classes, "ann-classes")
    count = classes.count()
    router = fit(sample_of(classes, count), count)
    sent = vectors.sparkSession.sparkContext.broadcast((router.w1, router.b1, router.w2, router.b2, router.probes))

    def file(probes: int, columns: list[str]):
        def place(batch: pa.RecordBatch):
            parts = Router(*sent.value).parts(matrix(pa.Table.from_batches([batch])), probes)
            kept = [batch.column(c) for c in columns]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1, dtype=np.int32) * parts.shape[1]), pa.array(parts.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*kept, lists], names=[*columns, "parts"])

        return place

    kind = classes.schema["embedding"].dataType.simpleString()
    filed = arrow_map(classes, file(1, ["k1", "k2", "embedding", "ids"]), f"k1 long, k2 long, embedding {kind}, ids array<long>, parts array<int>")
    filed = written(filed.withColumn("part", F.col("parts")[0]).drop("parts"), "ann-filed")
    asks = rows.filter(F.col("vec_id") % every == 0)
    # one search for each distinct query vector; the row carries which rows ask
    distinct = asks.groupBy("k1", "k2").agg(F.first("embedding").alias("embedding"))
    routed = arrow_map(distinct, file(router.probes, ["k1", "k2", "embedding"]), f"k1 long, k2 long, embedding {kind}, parts array<int>")
    routed = written(routed.withColumn("part", F.explode("parts")).drop("parts"), "ann-routed")

    def shares(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("part").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    grid = F.broadcast(shares(filed, BLOCK, "blocks").join(shares(routed, QUERY_BLOCK, "asked"), "part"))  # at most MAX_PARTS rows
    left = (
        filed.join(grid, "part")
        .withColumn("block", F.pmod(F.col("k1"), F.col("blocks")).cast("int"))
        .withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asked") - 1)))
        .select("part", "block", "ask", "embedding", "ids")
    )
    right = (
        routed.join(grid, "part")
        .withColumn("ask", F.pmod(F.col("k2"), F.col("asked")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("part", "block", "ask", "embedding", "k1", "k2")
    )

    def compare(index: pa.Table, queries: pa.Table) -> pa.Table:
        keys, best = ([], []), []
        if index.num_rows and queries.num_rows:
            x, ids = matrix(index), index["ids"].to_pylist()
            for at in range(0, queries.num_rows, 256):
                own = queries.slice(at, 256)
                q = matrix(own)
                scores = q @ x.T
                k = min(top + 1, len(x))
                least = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k]
                for n in range(len(q)):
                    some = np.flatnonzero(scores[n] >= least[n] - 1e-9 * max(1.0, abs(least[n])))
                    exact = (x[some] * q[n]).sum(1).tolist()  # the same for a pair wherever it is compared
                    found = sorted((-s, i) for s, c in zip(exact, some, strict=True) for i in ids[c])[: top + 1]
                    best.append([{"minus": s, "vec_id": i} for s, i in found])
                for to, name in zip(keys, ("k1", "k2"), strict=True):
                    to.extend(own[name].to_pylist())
        kind = pa.list_(pa.struct([("minus", pa.float64()), ("vec_id", pa.int64())]))
        return pa.table({"k1": pa.array(keys[0], pa.int64()), "k2": pa.array(keys[1], pa.int64()), "best": pa.array(best, kind)})

    keys = ["part", "block", "ask"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "k1 long, k2 long, best array<struct<minus: double, vec_id: long>>")
    # a query has one row from each part it asked; sorted by score, then id
    found = found.groupBy("k1", "k2").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, top + 1).alias("best"))
    asked = asks.select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct()
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, top)
    answers = asked.join(written(found, "ann-found"), ["k1", "k2"]).select("query_id", F.posexplode(others).alias("at", "b"))
    return answers.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.minus")).alias("score"))
