"""Detectors over an entity's own points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.expressions import epoch_micros
from riskloom.operators.baseline import iqr_score, zscore
from riskloom.plans.hotkeys import DEFAULT_LIMITS, SkewLimits, find_hot, with_tail_rows
from riskloom.plans.ranks import exact_quantiles

POINTS = 30
EWMA_ALPHA = 0.3
# A block of the scan keeps weights within e to this power, far inside a double's range; four of them leave it.
EWMA_SPAN = 230.0


def _windowed(events: DataFrame, value: str, points: int, limits: SkewLimits):
    """Measured rows with `_t`, and the window of up to `points` earlier points of the entity."""
    rows = events.filter(F.col(value).isNotNull()).withColumn("_t", epoch_micros("ts"))
    few = SkewLimits(limits.segment_rows, limits.segment_rows, limits.local_table_rows)
    hot = find_hot(rows, ["entity_id"], "_t", 86_400, few)
    rows, part = with_tail_rows(rows, hot, ["entity_id"], ["_t", "event_id"], [value], points)
    return rows, Window.partitionBy(*part).orderBy("_t", "event_id").rowsBetween(-points, -1)


def _own(rows: DataFrame, events: DataFrame, *extra: str) -> DataFrame:
    return rows.filter(~F.col("_ghost")).select(*events.columns, *extra)


def rolling_z(events: DataFrame, value: str = "amount", points: int = POINTS, limits: SkewLimits = DEFAULT_LIMITS) -> DataFrame:
    """Deviation from the last points' mean, in their standard deviations; null before two points."""
    rows, w = _windowed(events, value, points, limits)
    std = F.stddev_samp(value).over(w)
    z = F.when(std > 0, (F.col(value) - F.avg(value).over(w)) / std).when(std == 0, 0.0)
    return _own(rows.withColumn("rolling_z", z), events, "rolling_z")


def moving_avg_dev(events: DataFrame, value: str = "amount", points: int = POINTS, limits: SkewLimits = DEFAULT_LIMITS) -> DataFrame:
    """Relative distance from the last points' mean; null before the first point or at mean zero."""
    rows, w = _windowed(events, value, points, limits)
    mean = F.avg(value).over(w)
    dev = F.when(mean != 0, F.abs(F.col(value) - mean) / F.abs(mean))
    return _own(rows.withColumn("moving_avg", mean).withColumn("moving_avg_dev", dev), events, "moving_avg", "moving_avg_dev")


def ewma_dev(
    events: DataFrame,
    value: str = "amount",
    alpha: float = EWMA_ALPHA,
    limits: SkewLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Distance from the exponentially weighted mean of all earlier points of the entity; null at its first.

    The mean starts at the first point and moves by `alpha` of the way to each next one. A point is an affine
    map of the mean, and so is a block of points; blocks are folded on their own and their maps composed, so
    no history is cut, gathered in an array or held by one task. Null and NaN values are no points.
    """
    rows = events.filter(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("_t", epoch_micros("ts"))
    few = SkewLimits(limits.segment_rows, limits.segment_rows, limits.local_table_rows)
    hot = find_hot(rows, ["entity_id"], "_t", 86_400, few)
    part = ["entity_id"]
    if hot is not None:
        rows, part = hot.tag(rows, "_t").drop("_hot"), ["entity_id", "_seg"]
    at = F.row_number().over(Window.partitionBy(*part).orderBy("_t", "event_id")) - 1
    rows = rows.withColumn("_i", at.cast("long"))
    if hot is not None:
        sizes = rows.groupBy(*part).agg(F.count("*").alias("_size"))
        before = Window.partitionBy("entity_id").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select(*part, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
        rows = rows.join(offsets, part).withColumn("_i", F.col("_i") + F.col("_before")).drop("_before", "_seg")
    weight = F.when(F.col("_i") == 0, 1.0).otherwise(alpha)
    out = _decayed(rows.withColumn("_x", F.col(value) * weight), math.log1p(-alpha), limits.segment_rows)
    return out.select(*events.columns, F.col("_past").alias("ewma"), F.abs(F.col(value) - F.col("_past")).alias("ewma_dev"))


def _decayed(rows: DataFrame, log_decay: float, longest: int) -> DataFrame:
    """rows (entity_id, _i, _x, ...) with `_past`, the sum of _x of all smaller _i, decayed once for each step between.

    `_i` counts from 0 without gaps in every entity. Rows are taken in blocks; a block's own sum uses weights
    that grow from its first row on. What earlier blocks leave is, where a block's decay is next to nothing,
    that of the last four of them (a fifth would be below the least double), else the same sum over blocks.
    """
    size = max(2, min(longest, math.ceil(EWMA_SPAN / -log_decay)))
    blocks = rows.withColumns({"_b": F.expr(f"_i div {size}L"), "_p": F.pmod("_i", F.lit(size))})
    grown = F.col("_x") * F.exp(F.col("_p") * -log_decay)
    own = F.sum(grown).over(Window.partitionBy("entity_id", "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.when(F.col("_p") > 0, own * F.exp((F.col("_p") - 1) * log_decay))
    totals = blocks.groupBy("entity_id", "_b").agg(
        F.sum(F.col("_x") * F.exp((size - 1 - F.col("_p")) * log_decay)).alias("_total"), F.count("*").alias("_n")
    ).filter(F.col("_n") == size)  # only an entity's last block is shorter, and nothing follows it
    if -log_decay * size >= EWMA_SPAN:
        after: list[Column] = [F.struct((F.col("_b") + k).alias("_b"), (F.col("_total") * math.exp((k - 1) * size * log_decay)).alias("_in")) for k in range(1, 5)]
        entering = totals.select("entity_id", F.explode(F.array(*after)).alias("e")).groupBy("entity_id", "e._b").agg(F.sum("e._in").alias("_in"))
    else:
        steps = totals.select("entity_id", F.col("_b").alias("_i"), F.col("_total").alias("_x"))
        summed = _decayed(steps, size * log_decay, longest)
        whole = F.col("_x") + F.coalesce(F.col("_past"), F.lit(0.0)) * math.exp(size * log_decay)
        entering = summed.select("entity_id", (F.col("_i") + 1).alias("_b"), whole.alias("_in"))
    zero = F.lit(0.0)
    past = F.coalesce("_inside", zero) + F.coalesce("_in", zero) * F.exp(F.col("_p") * log_decay)
    seen = blocks.withColumn("_inside", inside).join(entering, ["entity_id", "_b"], "left")
    return seen.withColumn("_past", F.when(F.col("_i") > 0, past)).drop("_b", "_p", "_inside", "_in")


def stat_outliers(df: DataFrame, value: str = "amount") -> DataFrame:
    """Table-wide z-score and interquartile score of a column."""
    basics = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s")).first()
    q = {r["q"]: r["quantile"] for r in exact_quantiles(df, [], value, [0.25, 0.75]).collect()}
    if basics["s"] is None or not q:
        return df.withColumn("global_z", F.lit(0.0)).withColumn("global_iqr", F.lit(0.0))
    v = f"CAST(`{value}` AS DOUBLE)"
    z = zscore(v, f"{basics['m']!r}D", f"{basics['s']!r}D")
    iqr = q[0.75] - q[0.25]
    outside = iqr_score(v, f"{q[0.25] - 1.5 * iqr!r}D", f"{q[0.75] + 1.5 * iqr!r}D", f"{iqr!r}D")
    return df.selectExpr("*", f"{z} AS global_z", f"{outside} AS global_iqr")
