"""Exact ranks, running totals and quantiles over a whole table or a few huge groups.

A window without a partition (or with a handful of partitions) would put everything in one task.
Here the values are first reduced to distinct (group, value) pairs, then range-partitioned; each
range adds the totals of the ranges before it, a table of at most one row per range and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.plans.lineage import cut_lineage
from riskloom.plans.small import broadcast_if_small, has_rows


# A group of at most so many rows is ranked in one task; larger ones are cut into ranges of about as many.
RANGE_ROWS = 250_000


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    totals: Sequence[str],
    descending: bool = False,
    stored: bool = False,
) -> DataFrame:
    """Add `cum_<c>` for every c in totals: the group's sum over rows up to this one in `order`.

    `order` must be unique inside a group, else ties are split arbitrarily. The rows are written first, unless
    they are `stored` already: their number decides how they are cut, and range bounds are sampled, so all
    passes must see the same ranges.
    """
    group = list(group)
    by = [F.desc(c) if descending else F.asc(c) for c in order]
    if not stored:
        df = cut_lineage(df, "totals")
    sizes = df.groupBy(*group).agg(F.count("*").alias("_n")).agg(F.max("_n").alias("largest"), F.sum("_n").alias("rows")).first()
    if (sizes["largest"] or 0) <= RANGE_ROWS:
        whole = Window.partitionBy(*group).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.sum(c).over(whole).alias(f"cum_{c}") for c in totals])
    ranged = df.repartitionByRange(-(-sizes["rows"] // RANGE_ROWS), *[F.asc(g) for g in group], *by)
    ranged = cut_lineage(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy(*group, "_range").agg(*[F.sum(c).alias(f"_sum_{c}") for c in totals])
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.col("_range").alias("_r"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in totals],
    )
    upto = (
        Window.partitionBy(*group, "_range")
        .orderBy(*by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.select("*", *[F.sum(c).over(upto).alias(f"_loc_{c}") for c in totals])
    on = F.col("_range") == F.col("_r")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return local.join(offsets, on).select(
        *df.columns, *[(F.col(f"_loc_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in totals]
    )


def counted(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Distinct values of every group with their counts (_v, _n), written down: statistics of any kind follow from it."""
    kept = df.filter(F.col(value).isNotNull())
    return cut_lineage(kept.groupBy(*group, (F.col(value).cast("double") + F.lit(0.0)).alias("_v")).agg(F.count("*").alias("_n")), "counts")


def summary(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """n, mean, std, min and max of every group, from `counted` values; squares are taken around the mean."""
    group = list(group)
    total = F.sum("_n")
    basics = counts.groupBy(*group).agg(
        total.alias("n"), (F.sum(F.col("_v") * F.col("_n")) / total).alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max")
    )
    around = broadcast_if_small(basics.select(*group, "mean", "min", "max"))
    # sums of equal values may be off by a digit
    off = F.when(F.col("min") < F.col("max"), F.col("_v") - F.col("mean")).otherwise(0.0)
    spread = counts.join(around, group).groupBy(*group).agg(F.sum(F.col("_n") * off * off).alias("_m2"))
    std = F.when(F.col("n") > 1, F.sqrt(F.col("_m2") / (F.col("n") - 1))).alias("std")
    return basics.join(spread, group).select(*group, "n", "mean", std, "min", "max")


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolation quantiles: the group columns, `q` (the probability) and `quantile`."""
    return counted_quantiles(counted(df, group, value), group, probs)


def counted_quantiles(counts: DataFrame, group: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """exact_quantiles of `counted` values."""
    group = list(group)
    return _interpolated(_hits(counts, group, probs), group)


def _hits(counts: DataFrame, group: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Rows of `counts` that hold a rank next to a probability `q`, with the size of their group."""
    ranked = running_totals(counts, group, ["_v"], ["_n"], stored=True)
    if group:
        sizes = ranked.groupBy(*[F.col(g).alias(f"_s_{g}") for g in group]).agg(F.max("cum__n").alias("_size"))
        on = F.lit(True)
        for g in group:
            on = on & F.col(g).eqNullSafe(F.col(f"_s_{g}"))
        ranked = ranked.join(sizes, on)
    else:
        ranked = ranked.withColumn("_size", F.lit(ranked.agg(F.max("cum__n")).first()[0]).cast("long"))
    at = F.array(*[F.lit(float(p)) for p in probs])
    near = F.filter(at, lambda q: _covers(F.floor(_place(q))) | _covers(F.ceil(_place(q))))
    return ranked.select(*counts.columns, "cum__n", "_size", F.explode(near).alias("q"))


def _place(q: Column) -> Column:
    return q * (F.col("_size") - 1)


def _covers(rank: Column) -> Column:
    return (rank >= F.col("cum__n") - F.col("_n")) & (rank < F.col("cum__n"))


def _interpolated(hits: DataFrame, group: Sequence[str]) -> DataFrame:
    at = _place(F.col("q"))
    picked = hits.groupBy(*group, "q").agg(
        F.max(F.when(_covers(F.floor(at)), F.col("_v"))).alias("_a"),
        F.max(F.when(_covers(F.ceil(at)), F.col("_v"))).alias("_b"),
        F.max(at - F.floor(at)).alias("_f"),
    )
    return picked.select(
        *group, "q", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("quantile")
    )


# A sketch names a value whose rank is off by at most this share of the rows, or so; what it names is only where to look.
SKETCH_ERROR = 1 / 2_000
# Errors that a bracket takes in on either side of its quantile.
BRACKET = 2


def statistics(
    df: DataFrame, group: Sequence[str], columns: Sequence[str], probs: dict[str, float], stored: bool = False
) -> DataFrame:
    """n, mean, std, min, max and exact quantiles (named by `probs`) of every column that has values in a group.

    Sketches give a narrow bracket around each quantile. The next pass counts each value inside a bracket by
    itself and the values of every gap between brackets together, so ranks stay exact and few values are
    shuffled. A rank that falls into a gap after all has that gap counted value by value as well. Rows are
    written first, unless they are `stored` already; groups with a null name are left out.
    """
    group, key = list(group), [*group, "feature"]
    known = df
    for g in group:
        known = known.filter(F.col(g).isNotNull())
    rows = known.select(*group, *[(F.col(c).cast("double") + F.lit(0.0)).alias(f"_v{i}") for i, c in enumerate(columns)])
    if not stored:
        rows = cut_lineage(rows, "values")
    around = [min(max(p + d, 0.0), 1.0) for p in probs.values() for d in (-BRACKET * SKETCH_ERROR, BRACKET * SKETCH_ERROR)]

    def of(i: int, c: str) -> Column:
        v = F.col(f"_v{i}")
        n, low, high = F.count(v), F.min(v), F.max(v)
        # sums of equal values may be off by a digit
        mean = F.when(low < high, F.avg(v)).otherwise(low).alias("mean")
        std = F.when(n > 1, F.when(low < high, F.stddev_samp(v)).otherwise(0.0)).alias("std")
        edges = F.percentile_approx(v, around, round(1 / SKETCH_ERROR)).alias("_e")
        return F.struct(F.lit(c).alias("feature"), n.alias("n"), mean, std, low.alias("min"), high.alias("max"), edges)

    wide = rows.groupBy(*group).agg(*[of(i, c).alias(f"_s{i}") for i, c in enumerate(columns)])
    each = F.explode(F.array(*[F.col(f"_s{i}") for i in range(len(columns))])).alias("s")
    basics = cut_lineage(wide.select(*group, each).select(*group, "s.*").filter("n > 0"), "sketches")

    def hits(edges: DataFrame, pairs: int) -> DataFrame:
        side = edges.groupBy(*group).agg(*[F.max(F.when(F.col("feature") == c, F.col("_e"))).alias(f"_e{i}") for i, c in enumerate(columns)])
        side = broadcast_if_small(side)
        beside = rows.join(side, group) if group else rows.crossJoin(side)
        values = [F.struct(F.lit(c).alias("feature"), F.col(f"_v{i}").alias("_v"), F.col(f"_e{i}").alias("_e")) for i, c in enumerate(columns)]
        long = beside.select(*group, F.explode(F.array(*values)).alias("p")).select(*group, "p.*").filter("_v IS NOT NULL")
        inside = " OR ".join(f"(_e[{2 * i}] <= _v AND _v <= _e[{2 * i + 1}])" for i in range(pairs))
        cell = " + ".join(f"if(_e[{i}] < _v, 1, 0)" for i in range(2 * pairs))
        counts = long.groupBy(*key, F.expr(cell).alias("_cell"), F.when(F.expr(inside), F.col("_v")).alias("_own")).agg(
            F.min("_v").alias("_v"), F.max("_v").alias("_most"), F.count("*").alias("_n")
        )
        counts = cut_lineage(counts.drop("_cell", "_own"), "counts")
        return cut_lineage(_hits(counts, key, list(probs.values())), "hits")

    found = hits(basics, len(probs))
    gaps = found.filter(F.col("_v") < F.col("_most"))
    if has_rows(gaps):
        more = gaps.groupBy(*key).agg(
            F.flatten(F.array(*[F.array(F.min(F.when(F.col("q") == p, F.col("_v"))), F.max(F.when(F.col("q") == p, F.col("_most")))) for p in probs.values()])).alias("_more")
        )
        none = F.array(*[F.lit(None).cast("double")] * (2 * len(probs)))
        wider = basics.join(more, key, "left").select(*key, F.concat("_e", F.coalesce("_more", none)).alias("_e"))
        found = hits(wider, 2 * len(probs))
    ranks = _interpolated(found, key)
    quantiles = ranks.groupBy(*key).agg(*[F.max(F.when(F.col("q") == p, F.col("quantile"))).alias(name) for name, p in probs.items()])
    return basics.drop("_e").join(quantiles, key)
