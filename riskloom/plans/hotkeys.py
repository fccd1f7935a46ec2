"""Ordered per-key work when one key may hold a large share of all rows.

Keys are sorted into two classes by one narrow, map-side combined count:

* sparse keys take plain windows partitioned by the key;
* dense keys (too many rows inside one trailing window for a sliding frame, or too many rows for
  one task) are cut into time segments, and what a segment needs from earlier ones travels as a few
  extra rows: running totals (`running`) or the last k rows (`with_tail_rows`).

Nothing is dropped or sampled, and no segment depends on another task's output row by row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.expressions import MICROS
from riskloom.plans.lineage import cut_lineage
from riskloom.plans.small import has_rows, local_if_small

WHOLE_KEY = 4 * 10**18
CARRY_TIME = -(2**62)


@dataclass(frozen=True)
class SkewLimits:
    """Row limits that decide which plan a key takes."""

    window_rows: int = 2_000
    segment_rows: int = 200_000
    local_table_rows: int = 50_000


DEFAULT_LIMITS = SkewLimits()


@dataclass(frozen=True)
class HotKeys:
    """Dense keys with their segment length in microseconds."""

    key: tuple[str, ...]
    table: DataFrame
    small: bool

    def tag(self, df: DataFrame, t: str) -> DataFrame:
        """Add `_hot` and `_seg`; a sparse key is one segment."""
        side = F.broadcast(self.table) if self.small else self.table
        seg = F.floor(F.col(t) / F.col("_seg_us")).cast("long")
        return (
            df.join(side, list(self.key), "left")
            .withColumn("_hot", F.col("_seg_us").isNotNull())
            .withColumn("_seg", F.coalesce(seg, F.lit(0).cast("long")))
            .drop("_seg_us")
        )


def find_hot(
    df: DataFrame,
    key: Sequence[str],
    t: str,
    window_seconds: int,
    limits: SkewLimits = DEFAULT_LIMITS,
) -> HotKeys | None:
    """Dense keys of `df` (`t` is a long in microseconds), or None when every key is sparse.

    A key with at most `window_rows` rows in all cannot be dense, so the first pass is a plain count.
    """
    key = tuple(key)
    narrow = df.select(*key, t)
    for k in key:
        narrow = narrow.filter(F.col(k).isNotNull())
    crowded = narrow.groupBy(*key).count().filter(F.col("count") > limits.window_rows).drop("count")
    if not has_rows(crowded):
        return None

    day = 86_400 * MICROS
    span = max(window_seconds * MICROS, day)
    at = lambda width: F.floor(F.col("_m") * (60 * MICROS) / width)
    minutes = (
        narrow.join(crowded, list(key), "left_semi")
        .groupBy(*key, F.floor(F.col(t) / (60 * MICROS)).alias("_m"))
        .agg(F.count("*").alias("n"))
    )
    hours = minutes.groupBy(*key, at(span).alias("_s"), at(day).alias("_d"), at(3600 * MICROS).alias("_h")).agg(
        F.sum("n").alias("n"), F.max("n").alias("peak_minute")
    )
    days = hours.groupBy(*key, "_s", "_d").agg(
        F.sum("n").alias("n"), F.max("n").alias("peak_hour"), F.max("peak_minute").alias("peak_minute")
    )
    spans = days.groupBy(*key, "_s").agg(
        F.sum("n").alias("n"),
        F.max("n").alias("peak_day"),
        F.max("peak_hour").alias("peak_hour"),
        F.max("peak_minute").alias("peak_minute"),
    )
    totals = spans.groupBy(*key).agg(
        F.sum("n").alias("total"),
        F.max("n").alias("peak_window"),
        F.max("peak_day").alias("peak_day"),
        F.max("peak_hour").alias("peak_hour"),
        F.max("peak_minute").alias("peak_minute"),
    )
    cap = F.lit(limits.segment_rows)
    seg_us = (
        F.when(F.col("total") <= cap, F.lit(WHOLE_KEY))
        .when(F.col("peak_day") <= cap, F.lit(day))
        .when(F.col("peak_hour") <= cap, F.lit(3600 * MICROS))
        .when(F.col("peak_minute") <= cap, F.lit(60 * MICROS))
        .otherwise(F.lit(MICROS))
    )
    dense = (F.col("peak_window") > limits.window_rows) | (F.col("total") > cap)
    table = totals.filter(dense).select(*key, seg_us.cast("long").alias("_seg_us"))

    local = local_if_small(table, limits.local_table_rows)
    if local is None:
        # written, not persisted: the joins of one query then share what they broadcast of it, if it is broadcast at all
        return HotKeys(key, cut_lineage(table, "hot-keys"), False)
    return HotKeys(key, local, True) if has_rows(local) else None


def running(
    rows: DataFrame,
    hot: HotKeys | None,
    key: Sequence[str],
    sums: Sequence[str] = (),
    maxes: Sequence[str] = (),
    order: Sequence[str] = ("_t", "_kind"),
) -> DataFrame:
    """Per-key running sums and maxima in `order`, peers included, replacing the input columns.

    `_kind` must be >= 0 on input. With dense keys every segment is opened by one carry row that
    holds the totals of all earlier segments.
    """
    key = list(key)
    part = list(key)
    if hot is not None:
        rows = hot.tag(rows, "_t")
        part.append("_seg")
        summary = (
            rows.filter("_hot")
            .groupBy(*key, "_seg")
            .agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxes])
        )
        before = Window.partitionBy(*key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
        types = dict(rows.dtypes)
        carry = summary.select(
            *key,
            "_seg",
            F.lit(CARRY_TIME).cast("long").alias("_t"),
            F.lit(-1).cast(types["_kind"]).alias("_kind"),
            *[F.sum(c).over(before).cast(types[c]).alias(c) for c in sums],
            *[F.max(c).over(before).alias(c) for c in maxes],
        )
        rows = rows.unionByName(carry, allowMissingColumns=True)
    upto = (
        Window.partitionBy(*part)
        .orderBy(*order)
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    kept = [c for c in rows.columns if c not in {*sums, *maxes, "_seg", "_hot"}]
    return rows.select(
        *kept,
        *[F.sum(c).over(upto).alias(c) for c in sums],
        *[F.max(c).over(upto).alias(c) for c in maxes],
    ).filter(F.col("_kind") >= 0)


def with_tail_rows(
    rows: DataFrame,
    hot: HotKeys | None,
    key: Sequence[str],
    order: Sequence[str],
    carried: Sequence[str],
    k: int,
) -> tuple[DataFrame, list[str]]:
    """Rows plus, per segment of a dense key, copies of the k rows before it (`_ghost` is true).

    Returns the rows and the columns to partition by. `order` must start with the time column.
    """
    key = list(key)
    if hot is None:
        return rows.withColumn("_ghost", F.lit(False)), key
    tagged = hot.tag(rows, order[0]).withColumn("_ghost", F.lit(False))
    by_seg = Window.partitionBy(*key, "_seg")
    latest = by_seg.orderBy(*[F.desc(c) for c in order])
    cols = list(dict.fromkeys([*order, *carried]))
    tails = (
        tagged.filter("_hot")
        .select(*key, "_seg", *[c for c in cols if c not in key])
        .withColumn("_rn", F.row_number().over(latest))
        .filter(F.col("_rn") <= k)
        .drop("_rn")
    )
    back = Window.partitionBy(*key).orderBy(*order).rowsBetween(-k, -1)
    body = [c for c in cols if c not in key]
    ghosts = (
        tails.withColumn("_prev", F.collect_list(F.struct(*body)).over(back))
        .withColumn("_pos", F.row_number().over(by_seg.orderBy(*order)))
        .filter(F.col("_pos") == 1)
        .select(*key, "_seg", F.explode("_prev").alias("_g"))
        .select(*key, "_seg", "_g.*", F.lit(True).alias("_ghost"), F.lit(True).alias("_hot"))
    )
    return tagged.unionByName(ghosts, allowMissingColumns=True), [*key, "_seg"]
