"""N-gram Jaccard join by PartEnum signatures.

The feature domain (shingle hashes) is dealt into n parts. Two sets whose symmetric difference is at most
k differ in at most k parts, so with n = k + 1 + spare parts at least spare + 1 parts agree exactly. A
signature is the content of one part under one size band; sets that link share a signature. Sizes are
banded by the threshold: a linked pair lies in one band or in two neighbouring ones, so every set signs
for its own band and the next.

The spare parts pay for leaving out small parts, of fewer than `min_part` features, which many unlike sets
share: a set with at most `spare` such parts signs the others only, a set with more signs all. min_part is 2
where the threshold lets nearly every set leave such parts out, else 1. Of a linked pair
either one has at most `spare` small parts, and then some agreeing part is large in both, or both sign
everything. Nothing is lost. What is left of `spare` is the set's slack under that band (0 if it signs all):
it shares at least one signature more than that with every set it links with.

Equal sets form a class first, named by a 64-bit hash. Members of a signature are compared with its
smallest class, which links groups of near copies without listing their pairs; components follow. Pairs
that this leaves open (same signature, other components) are listed for signatures of at most SMALL_BUCKET
members. Larger open signatures are hot. A set with no more hot signatures than slack shares some other
signature with every set it links with, so only sets with more remain; they are joined on the rarest features
by which they differ from what most of their group has in common (prefix, length and positional filters),
which is exact too, and does not list all pairs of a group of near copies that are too far apart to link.

Candidates first compare histograms: how many features fall to each of BINS bins. The bins differ by no
more than the sets, so a larger difference rules a link out. The bins of unlike sets differ by about the root
of the features in each, so BINS bins part unlike sets of up to some 3,000 features only; sets of more than
LEAST_PER_BIN * BINS also have a finer histogram, whose bins grow with the set, and what passes the first is
compared by that. What passes both is checked on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import Scratch, arrow_map, components, written
from riskloom.plans.small import broadcast_if_small

SPARE_PERCENT = 20
SMALL_BUCKET = 16
BINS = 128
LEAST_PER_BIN = 8
LOCAL_IDS = 500_000

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that any bits of the result can deal them out."""
    x = (x ^ (x >> np.uint64(31))) * M2
    x = (x ^ (x >> np.uint64(29))) * M3
    return x ^ (x >> np.uint64(32))


def feature_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; one for the whole text if it is shorter."""
    if not text:
        return np.empty(0, np.uint64)
    parts = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not parts:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    rolled = np.zeros(len(parts) - width + 1, np.uint64)
    for i in range(width):
        rolled = mix(rolled * M1 + hashes[i : len(parts) - width + 1 + i])
    return np.unique(rolled + np.uint64(width))


def bands(percent: int, upto: int) -> list[tuple[int, int]]:
    """Size bands (smallest, largest): a linked pair lies in one band or two neighbouring ones."""
    out, low = [], 1
    while low <= upto:
        high = max(low, low * 100 // percent)
        out.append((low, high))
        low = high + 1
    return out


def least_part(percent: int) -> int:
    """Features a part needs to be signed: 2 if a set has fewer parts below that, by chance, than spare ones.

    A set has fewest features in a part when it is the smallest of a band and signs for the next.
    """
    parts_per_feature = 2 * (100 - percent) / (100 + percent) * (100 / percent) ** 2 * (1 + SPARE_PERCENT / 100)
    mean = 1 / max(parts_per_feature, 1e-9)
    return 2 if math.exp(-mean) * (1 + mean) < SPARE_PERCENT / (100 + SPARE_PERCENT) else 1


class Plan:
    """Bands, part counts and spare parts for one threshold; grows as larger sets come."""

    def __init__(self, percent: int):
        self.percent, self.bands, self.min_part = percent, bands(percent, 1), least_part(percent)

    def tags(self, size: int) -> list[tuple[int, int, int]]:
        """(band, parts, spare) under which a set of this size signs."""
        if self.bands[-1][1] < size:
            self.bands = bands(self.percent, size * 2)
        sizes = [b[1] for b in self.bands]
        own = int(np.searchsorted(sizes, size))
        if own + 1 == len(self.bands):
            self.bands = bands(self.percent, size * 4)
        out = []
        for band in (own, own + 1):
            low, high = self.bands[band]
            if band == own or 100 * size >= self.percent * low:
                k = (100 - self.percent) * 2 * high // (100 + self.percent)
                spare = -(-(k + 1) * SPARE_PERCENT // 100) if k else 0
                out.append((band, k + 1 + spare, spare))
        return out


def signatures(features: np.ndarray, plan: Plan) -> tuple[np.ndarray, list[int]]:
    """Signatures, whose last bit is that of their band, and the slack under even and odd bands."""
    out, slack = [], [0, 0]
    spread = mix(features * M1)
    for band, parts, spare in plan.tags(len(features)):
        part = ((spread >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
        counts = np.bincount(part, minlength=parts)
        ends = np.cumsum(counts)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread[np.argsort(part, kind="stable")], dtype=np.uint64)])
        total = sums[ends] - sums[ends - counts]
        keep = np.arange(parts)
        small = counts < plan.min_part
        if spare and small.sum() <= spare:
            keep = keep[~small]
            slack[band % 2] = spare - int(small.sum())
        tag = np.uint64(band * 1_000_003 * int(M2) & (1 << 64) - 1)
        sigs = mix(total[keep] * M1 + mix(keep.astype(np.uint64) + tag) + counts[keep].astype(np.uint64))
        out.append(sigs >> np.uint64(1) << np.uint64(1) | np.uint64(band % 2))
    return np.concatenate(out), slack


def histogram(features: np.ndarray, bins: int = BINS) -> bytes:
    counts = np.bincount((mix(features + M3) >> np.uint64(40)).astype(np.int64) % bins, minlength=bins)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def fine_histogram(features: np.ndarray) -> bytes | None:
    """A histogram of BINS * 2^i bins with at most LEAST_PER_BIN features each on average; None where BINS are enough."""
    if len(features) <= LEAST_PER_BIN * BINS:
        return None
    return histogram(features, 1 << (-(-len(features) // LEAST_PER_BIN) - 1).bit_length())


def bins_apart(a: bytes, b: bytes) -> int:
    """By how much two histograms differ in all; the longer one is folded to the bins of the other."""
    x, y = sorted((np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b)), key=len)
    return int(np.abs(x - np.minimum(y.reshape(-1, len(x)).sum(0), 255)).sum())


def lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def set_key(features: np.ndarray) -> int:
    """The name of a class of equal sets."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(features.tobytes())).view(np.int64))


def signed_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, key, sigs, slack, bins, fine): key names the set; sigs only at the first copy a slice meets."""
    plan = Plan(percent)

    def sign(batch: pa.RecordBatch):
        sizes, keys, sigs, slacks, bins, fine, seen = [], [], [], [], [], [], set()
        for text in batch.column(1).to_pylist():
            features = feature_set(text, words)
            key = set_key(features) if len(features) else None
            signed = signatures(features, plan) if key is not None and key not in seen else (np.empty(0, np.uint64), [0, 0])
            for to, value in zip((sizes, keys, sigs, slacks), (len(features), key, *signed), strict=True):
                to.append(value)
            bins.append(histogram(features) if len(signed[0]) else None)
            fine.append(fine_histogram(features) if len(signed[0]) else None)
            seen.add(key)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), lists(sigs), pa.array(slacks, pa.list_(pa.int32())),
                pa.array(bins, pa.binary()), pa.array(fine, pa.binary()),
            ],
            names=["doc_id", "n_shingles", "key", "sigs", "slack", "bins", "fine"],
        )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(source, sign, "doc_id long, n_shingles long, key long, sigs array<long>, slack array<int>, bins binary, fine binary")


def shared_signatures(members: DataFrame) -> DataFrame:
    """(sig, key) -> (sig, key, pivot) of the signatures with several classes; pivot is the smallest of them.

    One exchange, sorted; a task walks through its rows and holds no more than a batch of them.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = last = pivot = None  # the run the last batch ended in
        shown = True  # whether its pivot has been given out
        for batch in batches:
            sig, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(sig):
                continue
            before_sig = np.concatenate([[sig[0] if at is None else at], sig[:-1]])
            before_key = np.concatenate([[key[0] if last is None else last], key[:-1]])
            starts = sig != before_sig
            starts[0] |= at is None
            new = starts | (key != before_key)
            first = np.maximum.accumulate(np.where(starts, np.arange(len(sig)), -1))
            own = np.where(first >= 0, key[np.maximum(first, 0)], pivot if pivot is not None else 0)
            more = new & ~starts  # members beside the pivot
            held = np.zeros(len(sig), bool)
            held[first[more & (first >= 0)]] = True
            out = more | held
            out_sig, out_key, out_pivot = sig[out], key[out], own[out]
            if not shown and (more & (first < 0)).any():
                out_sig, out_key, out_pivot = (np.concatenate([[v], c]) for v, c in ((at, out_sig), (pivot, out_key), (pivot, out_pivot)))
                shown = True
            if first[-1] >= 0:
                pivot, shown = key[first[-1]], bool(held[first[-1]])
            at, last = sig[-1], key[-1]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (out_sig, out_key, out_pivot)], names=["sig", "key", "pivot"])

    return members.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(runs, "sig long, key long, pivot long")


def whole_sets(docs: DataFrame, words: int) -> DataFrame:
    """(key, features) of the rows of (key, text); a text whose set is another one (a repeated id) is left out."""

    def sets(batch: pa.RecordBatch):
        found = [(k, feature_set(t, words)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        found = [(k, s) for k, s in found if len(s) and set_key(s) == k]
        keys = pa.array([k for k, _ in found], pa.int64())
        yield pa.RecordBatch.from_arrays([keys, lists([s for _, s in found])], names=["key", "features"])

    return arrow_map(docs.select("key", "text"), sets, "key long, features array<long>")


def checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose whole sets reach the threshold."""
    left = sets.select(F.col("key").alias("a"), F.col("features").alias("fa"))
    right = sets.select(F.col("key").alias("b"), F.col("features").alias("fb"))
    both = F.size(F.array_intersect("fa", "fb"))
    return (
        pairs.join(right, "b")
        .join(left, "a")
        .filter(both * 100 >= (F.size("fa") + F.size("fb") - both) * percent)
        .select("a", "b")
    )


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those that sizes and histograms do not rule out.

    Few pass the first histograms, so few carry their finer ones. They are written in between: with small
    sides both comparisons would else fall into one stage, with two Python workers for each of its tasks.
    """

    def compare(batch: pa.RecordBatch):
        n = batch.column(2).to_numpy() + batch.column(4).to_numpy()
        bins = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for i in (3, 5)]
        apart = np.abs(bins[0] - bins[1]).sum(1)
        near = pa.array(apart * (100 + percent) <= n * (100 - percent))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near), pa.array(n).filter(near)], names=["a", "b", "n"])

    def compare_fine(batch: pa.RecordBatch):
        rows = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
        near = pa.array([None in (a, b) or bins_apart(a, b) * (100 + percent) <= n * (100 - percent) for n, a, b in rows], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    side = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("bins").alias(f"bins_{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").filter(fits("na", "nb", percent))
    rough = written(arrow_map(joined.select("a", "b", "na", "bins_a", "nb", "bins_b"), compare, "a long, b long, n long"), "near-rough")
    large = classes.filter(F.col("fine").isNotNull())
    fine = lambda x: large.select(F.col("key").alias(x), F.col("fine").alias(f"fine_{x}"))
    closer = rough.join(fine("b"), "b", "left").join(fine("a"), "a", "left")
    return arrow_map(closer.select("a", "b", "n", "fine_a", "fine_b"), compare_fine, "a long, b long")


def fits(a: str, b: str, percent: int) -> F.Column:
    """Sizes alone allow a link."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def ends_of(pairs: DataFrame) -> DataFrame:
    """(key): every class named in pairs (a, b)."""
    return pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()


def texts_of(docs: DataFrame, signed: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text): one document of each class named in `keys`."""
    ids = signed.join(keys, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    ids = broadcast_if_small(written(ids, "near-ids"), LOCAL_IDS)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.join(ids, "doc_id").select("key", "text")


def groups_of(hot: DataFrame) -> DataFrame:
    """(group, key, root): hot signatures (sig, key, root, pivot) that share members mostly become one group.

    Sets that share a signature share a group: a signature is grouped by the least pivot any of its members has.
    """
    least = hot.groupBy("key").agg(F.min("pivot").alias("least"))
    named = hot.join(least, "key").groupBy("sig").agg(F.min("least").alias("group"))
    return hot.join(named, "sig").select("group", "key", "root").distinct()


def consensus_pairs(groups: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, candidates) between sets of a group (group, key, root) in different components; both as (a, b).

    A group's centre holds the features that more than half of its members have. What counts is how a set
    differs from it: x and y differ by at most both differences together, and by as much unless those overlap.
    With k(x, y) = (1 - t) / (1 + t) * (|x| + |y|), the difference that a link allows, either the differences
    d(x) + d(y) are within k: then they link, and both link with the set for which d - (1 - t) / (1 + t) * n is
    least. Or they share a feature, one of the first floor(k) + 1 of each, rarest first, as d(x) - d(y) is at
    most k. So near copies of one text are not compared with each other for what they all have in common.
    """
    t = percent
    each = groups.join(sets.select("key", "features", F.size("features").alias("n")), "key")
    members = groups.groupBy("group").agg(F.count("*").alias("members"))
    held = each.select("group", F.explode("features").alias("f")).groupBy("group", "f").agg(F.count("*").alias("c"))
    held = held.join(members, "group").select("group", "f", F.least("c", F.col("members") - F.col("c")).alias("df"), (2 * F.col("c") > F.col("members")).alias("central"))
    held = written(held, "near-held")
    centre = held.filter("central").groupBy("group").agg(F.collect_list("f").alias("centre"))
    none = F.array().cast("array<long>")
    apart = each.join(centre, "group", "left").withColumn("centre", F.coalesce("centre", none))
    apart = written(
        apart.select("group", "key", "root", "n", F.concat(F.array_except("features", "centre"), F.array_except("centre", "features")).alias("d")), "near-differences"
    )
    lead = (F.size("d") * (100 + t) - F.col("n") * (100 - t)).alias("lead")
    led = apart.select("group", "key", lead)
    first = led.groupBy("group").agg(F.min(F.struct("lead", "key")).alias("first"))
    stars = led.join(first, "group").filter((F.col("lead") + F.col("first.lead") <= 0) & (F.col("key") != F.col("first.key")))
    links = stars.select(F.col("first.key").alias("a"), F.col("key").alias("b")).distinct()
    tokens = apart.select("group", "key", "root", "n", F.size("d").alias("m"), F.explode("d").alias("f")).join(held.select("group", "f", "df"), ["group", "f"])
    ordered = tokens.groupBy("group", "key", "root", "n", "m").agg(F.sort_array(F.collect_list(F.struct("df", "f"))).alias("fs"))
    allowed = F.floor(F.col("n") * (100 - t) / t).cast("int")  # (1 - t) / (1 + t) * (n + n / t): the most any partner allows
    rare = ordered.select("group", "key", "root", "n", "m", F.posexplode(F.slice("fs", F.lit(1), allowed + 1)).alias("at", "t"))
    rare = rare.select("group", "key", "root", "n", F.col("m").alias("m"), "at", F.col("t.f").alias("f"))
    open_ = rare.groupBy("group", "f").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("group", "f")
    rare = written(rare.join(open_, ["group", "f"], "left_semi"), "near-prefix")
    side = lambda x: rare.select("group", "f", *[F.col(c).alias(f"{c}_{x}") for c in ("key", "root", "n", "m", "at")])
    a, b = side("a"), side("b")
    # the differences share at least (m_a + m_b - k) / 2 features, and from the first shared one on there are few left
    most = F.least(F.col("m_a") - F.col("at_a"), F.col("m_b") - F.col("at_b"))
    enough = 2 * most * (100 + t) >= (F.col("m_a") + F.col("m_b")) * (100 + t) - (F.col("n_a") + F.col("n_b")) * (100 - t)
    keep = (F.col("root_a") < F.col("root_b")) & fits("n_a", "n_b", t) & enough
    pairs = a.join(b, ["group", "f"]).filter(keep).select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()
    return links, pairs


def near_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of documents (doc_id, text).

    Two documents link when the Jaccard similarity of their sets of `words`-word shingles is at least
    percent / 100; component_id is the smallest doc_id reachable by links. A text of fewer words is one
    shingle; a null text or one without words has an empty set, links with nothing and keeps its own id.
    Repeated rows stay, each with the same answer; a row without doc_id takes part only as a copy of a text
    that has one, and else has component_id null. Extra columns are ignored. An empty table gives no rows.
    """
    with Scratch() as mine:
        return mine.keep(written(_components_of(docs, words, percent, mine), "near-result"))


def _components_of(docs: DataFrame, words: int, percent: int, mine: Scratch) -> DataFrame:
    """near_components, reading tables that belong to `mine`."""
    signed = written(signed_sets(docs, words, percent), "near-sets")
    classes = signed.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("n_shingles").alias("n"), F.min("doc_id").alias("first_id"), F.max("slack").alias("slack"),
        F.max("bins").alias("bins"), F.max("fine").alias("fine"),
    )
    classes = written(classes, "near-classes")
    shared = written(shared_signatures(signed.select(F.explode("sigs").alias("sig"), "key")), "near-shared")
    whole, signed = signed, written(signed.select("doc_id", "n_shingles", "key"), "near-rows")
    mine.drop(whole)  # the signatures are most of what is on disk
    # a set is compared with the smallest of its pivots first, and with others only across components
    first = shared.filter(F.col("key") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    first = written(first, "near-first")
    nearest = first.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    tried = written(plausible(nearest, classes, percent), "near-pairs")
    sets = written(whole_sets(texts_of(docs, signed, ends_of(tried)), words), "near-whole")
    links = written(checked(tried, sets, percent), "near-links")
    roots = components(links)
    label = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    apart = first.join(label("a"), "a", "left").join(label("b"), "b", "left")
    apart = apart.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b").join(tried, ["a", "b"], "left_anti")
    tried = written(plausible(written(apart, "near-apart"), classes, percent), "near-pairs1")
    sets = sets_for(docs, signed, sets, ends_of(tried), words)
    more = written(checked(tried, sets, percent), "near-links1")
    if more.limit(1).count():
        links = written(links.union(more), "near-links")
        roots = components(links)

    known = shared.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    open_sigs = (
        known.groupBy("sig")
        .agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("held"))
        .filter((F.col("lo") != F.col("hi")) & (F.col("held") > 2))
        .select("sig", "held")
    )
    left = written(known.join(written(open_sigs, "near-open-sigs"), "sig").select("sig", "key", "pivot", "root", "held"), "near-open")
    few = left.filter((F.col("held") <= SMALL_BUCKET) & (F.col("key") != F.col("pivot")))
    listed = (
        few.select("sig", F.col("key").alias("a"), F.col("root").alias("ra"))
        .join(few.select("sig", F.col("key").alias("b"), F.col("root").alias("rb")), "sig")
        .filter(F.col("ra") < F.col("rb"))
        .select("a", "b")
        .distinct()
    )
    hot = left.filter(F.col("held") > SMALL_BUCKET).groupBy("key", "root", F.pmod("sig", F.lit(2)).alias("band")).agg(F.count("*").alias("hot"))
    slack = F.coalesce(F.get("slack", F.col("band").cast("int")), F.lit(0))
    many = hot.join(classes.select("key", "slack"), "key").filter(F.col("hot") > slack).select("key").distinct()
    crowded = left.filter(F.col("held") > SMALL_BUCKET).join(written(many, "near-many"), "key", "left_semi")
    groups = written(groups_of(written(crowded, "near-crowded")), "near-groups")
    sure, rare = consensus_pairs(groups, sets_for(docs, signed, sets, groups.select("key"), words), percent)
    pairs = written(plausible(written(listed.union(rare).distinct(), "near-listed"), classes, percent), "near-pairs2")
    more = checked(pairs, sets_for(docs, signed, sets, ends_of(pairs), words), percent)
    more = written(more.union(sure).distinct(), "near-links2")
    if more.limit(1).count():
        roots = components(links.union(more))

    placed = signed.select("doc_id", "n_shingles", "key").join(roots.withColumnRenamed("node", "key"), "key", "left")
    placed = placed.withColumn("root", F.coalesce("root", "key"))
    smallest = (
        classes.join(roots.withColumnRenamed("node", "key"), "key", "left")
        .groupBy(F.coalesce("root", "key").alias("root"))
        .agg(F.min("first_id").alias("component_id"))
    )
    return placed.join(smallest, "root", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def sets_for(docs: DataFrame, signed: DataFrame, sets: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """Whole sets of `keys`: those at hand, and the others from their texts."""
    keys = written(keys.select("key").distinct(), "near-keys")
    missing = keys.join(sets, "key", "left_anti")
    found = sets.join(keys, "key", "left_semi")
    return written(found.union(whole_sets(texts_of(docs, signed, missing), words)), "near-whole")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents whose component is named after them: the smallest doc_id of each group.

    Rows without doc_id stay; of repeated rows of one doc_id the one with the smallest text stays.
    """
    keep = near_components(docs, words, percent).filter(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    ids = keep.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.join(ids, F.col("doc_id").cast("long") == F.col("kept_id"), "left_semi")
    twice = rows.groupBy("doc_id").agg(F.count("*").alias("n_rows")).filter("n_rows > 1").drop("n_rows")
    copies = rows.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min_by(F.struct(*[c for c in docs.columns]), F.struct("text")).alias("kept_row")
    )
    return (
        rows.join(twice, "doc_id", "left_anti")
        .select(*docs.columns)
        .union(copies.select(*[F.col("kept_row").getField(c).alias(c) for c in docs.columns]))
        .union(docs.filter(F.col("doc_id").isNull()).select(*docs.columns))
    )
