"""Point-in-time features: what each event looked like given the entity's past up to that event."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.functions.expressions import (
    MICROS,
    day_of_week,
    epoch_micros,
    fourier,
    hour_of_day,
)
from riskloom.operators.asof import asof_label
from riskloom.plans.hotkeys import DEFAULT_LIMITS, HotKeys, SkewLimits, find_hot, running, with_tail_rows
from riskloom.plans.lineage import cut_lineage


class FeaturePlan:
    """Columns the feature settings ask for."""

    def __init__(self, settings: dict[str, Any] | None = None):
        settings = settings or C.FEATURES
        entity = settings.get("entity", {})
        self.key: list[str] = list(entity.get("partition_columns", ["entity_id"]))
        self.ts: str = entity.get("order_column", "ts")
        self.seconds = {w["name"]: C.interval_seconds(w["interval"]) for w in settings["time_windows"]}
        feats = settings["features"]

        def on(name: str) -> dict[str, Any]:
            part = feats.get(name, {})
            return part if part.get("enabled", False) else {}

        def windows(part: dict[str, Any]) -> list[str]:
            return [w for w in self.seconds if w in part.get("windows", [])]

        self.count_windows = windows(on("event_counts"))
        self.proxy_windows = windows(on("distinct_counts"))
        stats = on("metric_stats")
        self.stat_windows = windows(stats)
        self.stat_column: str = stats.get("column", "amount")
        self.stat_aggs: list[str] = list(stats.get("aggregations", []))
        deltas = on("deltas")
        self.delta_column: str | None = deltas.get("column", "amount") if deltas else None
        self.pct_windows = windows(deltas) if deltas.get("include_pct_change", False) else []
        self.since_last = bool(on("time_since_last"))
        diffs = on("higher_order_diffs")
        self.diff_column: str | None = diffs.get("column", "amount") if diffs else None
        self.diff_order = int(diffs.get("order", 2)) if diffs else 0
        self.label_types: list[str] = list(on("time_since_last_label").get("label_types", ["fraud", "anomaly"])) if on(
            "time_since_last_label"
        ) else []
        season = on("seasonality")
        self.calendar = bool(season)
        self.periods = [(p["name"], int(p["period_seconds"])) for p in season.get("periods", [])]

    @property
    def longest(self) -> int:
        return max(self.seconds.values(), default=86_400)

    def output_columns(self) -> list[str]:
        out = [f"event_count_{w}" for w in self.count_windows]
        out += [f"distinct_event_types_{w}_proxy" for w in self.proxy_windows]
        for w in self.stat_windows:
            out += [f"metric_{a}_{w}" for a in self.stat_aggs if a in ("mean", "std")]
        out += [f"metric_z_{w}" for w in self.stat_windows]
        if self.delta_column:
            out += ["delta_1", *[f"pct_change_{w}" for w in self.pct_windows]]
        if self.since_last:
            out.append("time_since_last_event_seconds")
        if self.diff_column:
            out.append(f"{self.diff_column}_diff_1")
        if self.calendar:
            out += ["hour_of_day", "day_of_week"]
        for name, _ in self.periods:
            out += [f"sin_{name}", f"cos_{name}"]
        if self.diff_column and self.diff_order >= 2:
            out.append(f"{self.diff_column}_diff_2")
        out += [f"time_since_last_{t}_seconds" for t in self.label_types]
        return out


def build_features(
    events: DataFrame,
    labels: DataFrame | None = None,
    settings: dict[str, Any] | None = None,
    limits: SkewLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """All input columns plus every configured feature; exactly one output row per event.

    Ties in event time are ordered by event_id. Trailing windows include both ends and all peers.
    Without `labels`, the time-since-label columns are left out.
    """
    plan = FeaturePlan(settings)
    wanted = [*events.columns, *FeaturePlan(settings).output_columns()]
    if labels is not None and plan.label_types and list(plan.key) != ["entity_id"]:
        # labels name an entity alone: with another key they are matched apart from the windows
        types, plan.label_types = plan.label_types, []
        return asof_label(_features(events, None, plan, limits), labels, types).select(*wanted)
    if labels is None:
        plan.label_types = []
    return _features(events, labels, plan, limits)


def _features(events: DataFrame, labels: DataFrame | None, plan: FeaturePlan, limits: SkewLimits) -> DataFrame:
    base = events.withColumn("_t", epoch_micros(plan.ts))
    counted = base.select(*plan.key, "_t")
    if plan.label_types:  # labels share their entity's task
        counted = counted.unionByName(_label_rows(labels, plan, 1).select(*plan.key, "_t"))
    hot = find_hot(counted, plan.key, "_t", plan.longest, limits)
    if hot is None:
        out = _sparse(base, labels, plan)
    else:
        tagged = hot.tag(base, "_t").drop("_seg")
        out = _sparse(tagged.filter(~F.col("_hot")).drop("_hot"), labels, plan).unionByName(
            _dense(tagged.filter("_hot").drop("_hot"), labels, plan, hot)
        )
    return out.select(*events.columns, *plan.output_columns())


def _label_rows(labels: DataFrame, plan: FeaturePlan, kind: int) -> DataFrame:
    return labels.filter(F.col("label_type").isin(plan.label_types)).select(
        *[F.col("scope_id").alias(k) for k in plan.key[:1]],
        epoch_micros("ts_start").alias("_t"),
        F.lit(kind).alias("_kind"),
        *[F.when(F.col("label_type") == t, epoch_micros("ts_start")).alias(f"_lab_{t}") for t in plan.label_types],
    )


def _sparse(base: DataFrame, labels: DataFrame | None, plan: FeaturePlan) -> DataFrame:
    """One exchange and one sort on (key, time): every window below shares them."""
    rows = base.withColumn("_kind", F.lit(0))
    order = ["_t", "_kind", "event_id"]
    by_key = Window.partitionBy(*plan.key)
    if plan.label_types:
        rows = rows.unionByName(_label_rows(labels, plan, 1), allowMissingColumns=True)
        past = by_key.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.select(
            *base.columns, "_kind", *[F.max(f"_lab_{t}").over(past).alias(f"_lab_{t}") for t in plan.label_types]
        ).filter(F.col("_kind") == 0)
    rows = _lag_columns(rows, by_key.orderBy(*order), plan)

    def trailing(w: str):
        return by_key.orderBy("_t").rangeBetween(-plan.seconds[w] * MICROS, Window.currentRow)

    x, d = F.col(plan.stat_column), F.col(plan.delta_column or "amount")
    rows = rows.select(
        "*",
        *[F.count("*").over(trailing(w)).alias(f"_n_{w}") for w in {*plan.count_windows, *plan.proxy_windows}],
        *[F.avg(x).over(trailing(w)).alias(f"_mean_{w}") for w in plan.stat_windows],
        *[F.stddev_samp(x).over(trailing(w)).alias(f"_std_{w}") for w in plan.stat_windows],
        *[
            F.min(F.struct("_t", "event_id", d.alias("x"))).over(trailing(w))["x"].alias(f"_first_{w}")
            for w in plan.pct_windows
        ],
    )
    return _finish(rows, plan, base.columns)


def _lag_columns(rows: DataFrame, w, plan: FeaturePlan) -> DataFrame:
    if plan.since_last:
        rows = rows.withColumn("_prev_t", F.lag("_t").over(w))
    if plan.delta_column:
        rows = rows.withColumn("_delta", F.col(plan.delta_column) - F.lag(plan.delta_column).over(w))
    if plan.diff_column:
        rows = rows.withColumn("_diff_1", F.col(plan.diff_column) - F.lag(plan.diff_column).over(w))
        if plan.diff_order >= 2:
            rows = rows.withColumn("_diff_2", F.col("_diff_1") - F.lag("_diff_1").over(w))
    return rows


def _dense(base: DataFrame, labels: DataFrame | None, plan: FeaturePlan, hot: HotKeys) -> DataFrame:
    """Same features in bounded segments, O(1) per row and window, by merging states instead of re-reading frames."""
    columns = list(dict.fromkeys(["amount", plan.stat_column, plan.delta_column or "amount", plan.diff_column or "amount"]))
    rows, part = with_tail_rows(base, hot, plan.key, ["_t", "event_id"], columns, 2)
    rows = _lag_columns(rows, Window.partitionBy(*part).orderBy("_t", "event_id"), plan)
    rows = rows.filter(~F.col("_ghost")).drop("_ghost", "_seg", "_hot")
    if plan.label_types:
        keys = hot.table.select(*plan.key)
        hot_labels = _label_rows(labels, plan, 2).join(F.broadcast(keys) if hot.small else keys, plan.key, "left_semi")
        swept = rows.withColumn("_kind", F.lit(1)).unionByName(hot_labels, allowMissingColumns=True)
        swept = running(swept, hot, plan.key, maxes=[f"_lab_{t}" for t in plan.label_types])
        rows = swept.filter(F.col("_kind") == 1).drop("_kind")
    # every window below reads these rows several times
    rows = cut_lineage(rows, "dense-rows")
    shortest = hot.table.agg(F.min("_seg_us")).first()[0]
    names = list(dict.fromkeys([*plan.count_windows, *plan.proxy_windows, *plan.stat_windows, *plan.pct_windows]))
    for name in names:
        rows = _window_states(rows, plan, hot, name, shortest)
    return _finish(rows, plan, base.columns)


# What is known of a set of rows: how many, the first one, and of the measured values their number, mean,
# sum of squared distances from it, least and largest. Two sets' states merge; nothing is ever taken away.


def _state(present: Column, first: Column, x: Column, over=None) -> Column:
    """State of the rows of a group, or of a frame."""
    on = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    n = on(F.count(x))
    return F.struct(
        on(F.count(present)).alias("rows"),
        on(F.min(first)).alias("first"),
        n.alias("n"),
        on(F.avg(x)).alias("mean"),
        (on(F.var_pop(x)) * n).alias("m2"),
        on(F.min(x)).alias("lo"),
        on(F.max(x)).alias("hi"),
    )


def _merged(a: Column, b: Column) -> Column:
    """State of two disjoint sets of rows together; a null state is that of no rows."""
    na, nb = F.coalesce(a["n"], F.lit(0)), F.coalesce(b["n"], F.lit(0))
    n, d = na + nb, b["mean"] - a["mean"]
    both = (na > 0) & (nb > 0)
    return F.struct(
        (F.coalesce(a["rows"], F.lit(0)) + F.coalesce(b["rows"], F.lit(0))).alias("rows"),
        F.least(a["first"], b["first"]).alias("first"),
        n.alias("n"),
        F.when(both, a["mean"] + d * nb / n).otherwise(F.coalesce(a["mean"], b["mean"])).alias("mean"),
        F.when(both, a["m2"] + b["m2"] + d * d * na * nb / n).otherwise(F.coalesce(a["m2"], b["m2"])).alias("m2"),
        F.least(a["lo"], b["lo"]).alias("lo"),
        F.greatest(a["hi"], b["hi"]).alias("hi"),
    )


def _window_states(rows: DataFrame, plan: FeaturePlan, hot: HotKeys, name: str, shortest: int) -> DataFrame:
    """Count, mean, deviation and first row of one trailing window, for every row.

    Time is cut into blocks, `_m` of them to a window: one, or as many as keep a block within a segment. A
    window that ends in block b starts in block b - _m. So it is the end of that one, the whole blocks between,
    and the start of its own: running states from both sides, and one merge for each block.
    """
    key, width = plan.key, plan.seconds[name] * MICROS
    x = F.col(plan.stat_column).cast("double")
    first = F.struct("_t", "event_id", F.col(plan.delta_column or "amount").alias("x"))
    blocks = hot.table.select(*key, F.greatest(F.lit(1), F.ceil(F.lit(width) / F.col("_seg_us"))).cast("long").alias("_m"))
    inside = f"pmod(_t, {width}L)"
    block = F.expr(f"_m * ((_t - {inside}) div {width}L) + ({inside} * _m) div {width}L")
    at = rows.join(F.broadcast(blocks) if hot.small else blocks, key).withColumn("_b", block)
    part = Window.partitionBy(*key, "_b")
    head = part.orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    slim = at.select(*key, "_b", "_t", x.alias("_x"), first.alias("_first"))
    state = F.col("_head")
    started = at.withColumn("_head", _state(F.col("_t"), first, x, head))
    if shortest < width:  # else every window is two adjoining blocks
        most = -(-width // shortest)
        totals = at.groupBy(*key, "_b", "_m").agg(_state(F.col("_t"), first, x).alias("_s"))
        near = Window.partitionBy(*key).orderBy("_b").rangeBetween(1 - most, -1)
        earlier = F.filter(F.collect_list(F.struct("_b", "_s")).over(near), lambda e: e["_b"] > F.col("_b") - F.col("_m"))
        nothing = F.lit(None).cast(totals.schema["_s"].dataType)
        # every state passes through the merge, so that the folded type is the merge's own
        start = _merged(nothing, nothing).cast(totals.select(_merged(F.col("_s"), F.col("_s")).alias("s")).schema["s"].dataType)
        between = totals.withColumn("_earlier", earlier).select(*key, "_b", F.aggregate("_earlier", start, lambda s, e: _merged(s, e["_s"])).alias("_mid"))
        started = started.join(between, [*key, "_b"])
        state = _merged(F.col("_mid"), state)
    carried = [c for c in rows.columns if c not in key]
    asked = started.select(
        *key,
        (F.col("_b") - F.col("_m")).alias("_b"),
        (F.col("_t") - width).alias("_t"),
        F.struct(*carried, state.alias("_own")).alias("_row"),
    )
    tail = part.orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    swept = slim.unionByName(asked, allowMissingColumns=True).withColumn("_tail", _state(F.col("_first"), F.col("_first"), F.col("_x"), tail))
    whole = (
        swept.filter(F.col("_row").isNotNull())
        .select(*key, "_row.*", "_tail")
        .withColumn("_s", _merged(F.col("_tail"), F.col("_own")))
        .drop("_tail", "_own")
    )
    s = F.col("_s")
    constant = (s["lo"] == s["hi"]) & (F.abs(s["hi"]) < math.inf)  # sums of equal values may be off by a digit
    std = F.when(s["n"] > 1, F.when(constant, 0.0).otherwise(F.sqrt(s["m2"] / (s["n"] - 1))))
    return whole.select(
        *rows.columns,
        s["rows"].alias(f"_n_{name}"),
        F.when(constant, s["lo"]).otherwise(s["mean"]).alias(f"_mean_{name}"),
        std.alias(f"_std_{name}"),
        s["first"]["x"].alias(f"_first_{name}"),
    )


def _finish(rows: DataFrame, plan: FeaturePlan, keep: Sequence[str]) -> DataFrame:
    """Turn window totals into the named features, after the kept columns."""
    out = {}
    for w in plan.count_windows:
        out[f"event_count_{w}"] = F.col(f"_n_{w}")
    for w in plan.proxy_windows:
        out[f"distinct_event_types_{w}_proxy"] = F.col(f"_n_{w}")
    for w in plan.stat_windows:
        mean, std = F.col(f"_mean_{w}"), F.col(f"_std_{w}")
        out[f"metric_mean_{w}"] = mean
        out[f"metric_std_{w}"] = std
        out[f"metric_z_{w}"] = F.when(std > 0, (F.col(plan.stat_column) - mean) / std).otherwise(F.lit(0.0))
    if plan.delta_column:
        out["delta_1"] = F.col("_delta")
        for w in plan.pct_windows:
            f = F.col(f"_first_{w}")
            out[f"pct_change_{w}"] = F.when(f > 0, (F.col(plan.delta_column) - f) / f * 100).otherwise(F.lit(0.0))
    if plan.since_last:
        out["time_since_last_event_seconds"] = (F.col("_t") - F.col("_prev_t")) / F.lit(float(MICROS))
    if plan.diff_column:
        out[f"{plan.diff_column}_diff_1"] = F.col("_diff_1")
        if plan.diff_order >= 2:
            out[f"{plan.diff_column}_diff_2"] = F.col("_diff_2")
    if plan.calendar:
        out["hour_of_day"] = hour_of_day(plan.ts)
        out["day_of_week"] = day_of_week(plan.ts)
    for name, seconds in plan.periods:
        out[f"sin_{name}"], out[f"cos_{name}"] = fourier(plan.ts, seconds)
    for t in plan.label_types:
        out[f"time_since_last_{t}_seconds"] = (F.col("_t") - F.col(f"_lab_{t}")) / F.lit(float(MICROS))
    wanted = plan.output_columns()
    return rows.select(*keep, *[out[c].alias(c) for c in wanted])


def features_asof(
    events: DataFrame,
    as_of,
    entity_ids: Sequence[str] | DataFrame,
    labels: DataFrame | None = None,
    settings: dict[str, Any] | None = None,
    limits: SkewLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Latest feature row at or before `as_of` for each entity, with its rank column `rn`.

    Time is cut before the windows run: every frame looks back, so later rows cannot matter.
    """
    past = filter_entity_asof(events, entity_ids, as_of)
    return latest_per_entity(build_features(past, labels, settings, limits))


def filter_entity_asof(events: DataFrame, entity_ids: Sequence[str] | DataFrame, as_of) -> DataFrame:
    """Events of the entities at or before a time; a DataFrame of ids becomes a semi join."""
    past = events.filter(F.col("ts") <= F.lit(as_of).cast("timestamp"))
    if isinstance(entity_ids, DataFrame):
        return past.join(entity_ids.select("entity_id").distinct(), "entity_id", "left_semi")
    return past.filter(F.col("entity_id").isin(list(entity_ids)))


def latest_per_entity(df: DataFrame) -> DataFrame:
    """Newest row per entity; the rank filter prunes on the map side, so a huge entity is cheap."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == 1)


def latest_one(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("ts"), F.desc("event_id")).limit(1)


def fill_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing numeric features count as zero."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in present})


def distinct_in_window(
    events: DataFrame,
    column: str = "event_type",
    window: tuple[str, int] = ("24h", 86_400),
    limits: SkewLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Exact distinct count of `column` per entity in the trailing window, nulls ignored."""
    name, seconds = window
    alias = f"distinct_{column}s_{name}"
    base = events.withColumn("_t", epoch_micros("ts"))
    hot = find_hot(base, ["entity_id"], "_t", seconds, limits)
    frame = Window.partitionBy("entity_id").orderBy("_t").rangeBetween(-seconds * MICROS, Window.currentRow)
    sparse = lambda d: d.withColumn(alias, F.size(F.collect_set(column).over(frame)).cast("long"))
    if hot is None:
        return sparse(base).drop("_t")
    tagged = hot.tag(base, "_t").drop("_seg")
    return (
        sparse(tagged.filter(~F.col("_hot")).drop("_hot"))
        .unionByName(_dense_distinct(tagged.filter("_hot").drop("_hot"), column, seconds, alias, hot))
        .select(*events.columns, alias)
    )


def _dense_distinct(base: DataFrame, column: str, seconds: int, alias: str, hot: HotKeys) -> DataFrame:
    """A value counts from its event until just after event + window, unless renewed before that."""
    width = seconds * MICROS
    narrow = base.filter(F.col(column).isNotNull()).select("entity_id", "_t", F.col(column).alias("_v"))
    # The last sighting of each value before a segment, from per-segment maxima.
    tagged = hot.tag(narrow, "_t")
    seen = tagged.groupBy("entity_id", "_v", "_seg").agg(F.max("_t").alias("_last"))
    past = Window.partitionBy("entity_id", "_v").orderBy("_seg")
    carried = seen.select("entity_id", "_v", "_seg", F.lag("_last").over(past).alias("_carry"))
    times = tagged.groupBy("entity_id", "_v", "_seg", "_t").agg(F.count("*").alias("_c"))
    w = Window.partitionBy("entity_id", "_v", "_seg").orderBy("_t")
    times = (
        times.join(carried, ["entity_id", "_v", "_seg"])
        .withColumn("_prev", F.coalesce(F.lag("_t").over(w), F.col("_carry")))
    )
    fresh = F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") > width)
    one = F.lit(1).cast("long")
    marks = times.select(
        "entity_id",
        F.explode(
            F.array(
                F.when(fresh, F.struct(F.col("_t").alias("_t"), F.lit(0).alias("_kind"), one.alias("_d"))).otherwise(
                    F.struct((F.col("_prev") + width).alias("_t"), F.lit(2).alias("_kind"), one.alias("_d"))
                ),
                F.struct((F.col("_t") + width).alias("_t"), F.lit(2).alias("_kind"), (-one).alias("_d")),
            )
        ).alias("m"),
    ).select("entity_id", "m.*")
    body = [c for c in base.columns if c not in ("entity_id", "_t")]
    rows = base.select(
        "entity_id", "_t", F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_d"), F.struct(*body).alias("_row")
    )
    swept = running(rows.unionByName(marks, allowMissingColumns=True), hot, ["entity_id"], ["_d"])
    return swept.filter(F.col("_row").isNotNull()).select(
        "entity_id", "_t", "_row.*", F.col("_d").alias(alias)
    ).select(*base.columns, alias)
