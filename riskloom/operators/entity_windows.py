"""Trailing event counts and success rates of users, merchants and API clients."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import config as C
from riskloom.functions.expressions import MICROS, epoch_micros
from riskloom.plans.hotkeys import DEFAULT_LIMITS, SkewLimits, find_hot, running

KEYS = {"user": "user_id", "merchant": "merchant_id", "api_client": "api_client_id"}


def entity_windows(
    events: DataFrame, kind: str, hours: list[int] | None = None, limits: SkewLimits = DEFAULT_LIMITS
) -> DataFrame:
    """Events that carry the key, with `{kind}_{h}h_event_count` and `{kind}_{h}h_success_rate`.

    Dense keys are swept: an event adds to the running totals at its time and is taken back just
    after time + window.
    """
    key = KEYS[kind]
    hours = hours or C.ENTITY_WINDOW_HOURS[kind]
    rows = (
        events.filter(F.col(key).isNotNull())
        .withColumn("_t", epoch_micros("ts"))
        .withColumn("_ok", F.when(F.col("status") == "success", 1).otherwise(0).cast("long"))
    )
    hot = find_hot(rows, [key], "_t", max(hours) * 3600, limits)
    if hot is None:
        totals = _frames(rows, key, hours)
    else:
        tagged = hot.tag(rows, "_t").drop("_seg")
        totals = _frames(tagged.filter(~F.col("_hot")).drop("_hot"), key, hours).unionByName(
            _sweep(tagged.filter("_hot").drop("_hot"), key, hours, hot)
        )
    out = []
    for h in hours:
        out.append(F.col(f"_n_{h}").alias(f"{kind}_{h}h_event_count"))
        out.append((F.col(f"_k_{h}") / F.col(f"_n_{h}")).alias(f"{kind}_{h}h_success_rate"))
    return totals.select(*events.columns, *out)


def _frames(rows: DataFrame, key: str, hours: list[int]) -> DataFrame:
    cols = []
    for h in hours:
        w = Window.partitionBy(key).orderBy("_t").rangeBetween(-h * 3600 * MICROS, Window.currentRow)
        cols += [F.count("*").over(w).alias(f"_n_{h}"), F.sum("_ok").over(w).alias(f"_k_{h}")]
    return rows.select("*", *cols)


def _sweep(rows: DataFrame, key: str, hours: list[int], hot) -> DataFrame:
    body = F.struct(*[c for c in rows.columns if c not in (key, "_t")])
    blank = F.lit(None).cast(rows.select(body.alias("b")).schema["b"].dataType)

    def point(t, kind, sign, active, payload):
        weights = []
        for h in hours:
            on = h in active
            weights.append(F.lit(sign if on else 0).cast("long").alias(f"_n_{h}"))
            weights.append(((F.col("_ok") * sign) if on else F.lit(0)).cast("long").alias(f"_k_{h}"))
        return F.struct(t.alias("_t"), F.lit(kind).alias("_kind"), payload.alias("_row"), *weights)

    points = [point(F.col("_t"), 1, 1, hours, body)]
    points += [point(F.col("_t") + h * 3600 * MICROS, 2, -1, [h], blank) for h in hours]
    swept = rows.select(key, F.explode(F.array(*points)).alias("p")).select(key, "p.*")
    sums = [f"_{m}_{h}" for h in hours for m in ("n", "k")]
    totals = running(swept, hot, [key], sums).filter(F.col("_row").isNotNull())
    return totals.select(key, "_t", "_row.*", *sums)
