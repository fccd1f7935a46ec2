"""Reproducible samples and top-k selections that never gather a whole group in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.expressions import hash_order, unit_from_hex
from riskloom.plans.small import broadcast_if_small, has_rows

# Below this many rows the built-in per-partition limit is already cheap.
DIRECT_LIMIT = 10_000
SPREAD = 256
PREFIX_DIGITS = 3


def sample_rows(df: DataFrame, n: int, id_col: str = "event_id", seed: str = "") -> DataFrame:
    """The n rows with the smallest hash of `id_col`; fewer if there are fewer.

    A large n is a filter, not a sort: a histogram of hash prefixes tells which prefix holds the n-th row, one
    of its longer prefixes in the next pass, and so on until few rows share it. Rows below it are all taken,
    and of those that share it the first ones. Copies of one id that the cut falls among are told apart by
    the rest of the row.
    """
    order = hash_order(id_col, seed)
    if n <= DIRECT_LIMIT:
        return df.orderBy(order, id_col).limit(n)
    columns = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    hashed = F.concat(F.coalesce(order, F.lit("")), F.md5(columns))
    rows, cut, left = df.withColumn("_h", hashed), "", n
    while True:
        size = len(cut) + PREFIX_DIGITS
        inside = rows.filter(F.col("_h").startswith(cut)) if cut else rows
        # at most 16 ** PREFIX_DIGITS rows
        bins = inside.groupBy(F.substring("_h", 1, size).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
        for b in bins:
            if b["n"] >= left:
                cut, share = b["p"], b["n"]
                break
            left -= b["n"]
        else:
            return df  # no more than n rows in all
        if share <= DIRECT_LIMIT or size >= 64:
            break
    below = rows.filter(F.substring("_h", 1, len(cut)) < cut)
    return below.union(rows.filter(F.col("_h").startswith(cut)).orderBy("_h").limit(left)).drop("_h")


def sample_per_group(
    df: DataFrame, group: Sequence[str], n: int, id_col: str = "event_id", seed: str = ""
) -> DataFrame:
    """At most n rows per group, smallest hash first; whole rows of small groups are kept."""
    group = list(group)
    order = hash_order(id_col, seed)
    if n <= DIRECT_LIMIT:
        return top_per_group(df, group, [order, F.col(id_col)], n)
    sizes = df.groupBy(*group).agg(F.count("*").alias("_size"))
    big = sizes.filter(F.col("_size") > n)
    if not has_rows(big):
        return df
    margin = F.lit(n + 8.0 * math.sqrt(n) + 16.0)
    widen = 1.0
    while True:
        cuts = big.select(*group, (margin * widen / F.col("_size")).alias("_cut"))
        near = (
            df.join(broadcast_if_small(cuts), group, "left")
            .filter(F.col("_cut").isNull() | (unit_from_hex(order) < F.col("_cut")))
            .drop("_cut")
        )
        short = (
            near.groupBy(*group).agg(F.count("*").alias("_kept")).join(big, group).filter(F.col("_kept") < n)
        )
        if not has_rows(short):
            break
        widen *= 2
    return _ranked(near, group, [order, F.col(id_col)], n)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of every group in `order`.

    Up to the engine's group-limit threshold the rank filter already prunes on the map side; above
    it, a first cut per (group, salt) bounds what reaches the group's task.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > threshold:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SPREAD)))
        df = _ranked(salted, [*group, "_salt"], order, k).drop("_salt")
    return _ranked(df, list(group), order, k)


def _ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
