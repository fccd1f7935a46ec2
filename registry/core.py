"""Registration of queries and their SQL checks, and SQL fragments the checks share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.fixtures import LABELS_CTE, RAW_CTE, r6, spark_r6
from riskloom import config as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` is the DuckDB statement that must give the same rows."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def micros(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as microseconds since the epoch, so both engines print them alike."""
    return df.withColumns({c: F.unix_micros(c) for c in columns})


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: spark_r6(F.col(c), digits) for c in columns})


def with_raw(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([RAW_CTE, *ctes]) + "\n" + body


def with_labels(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([RAW_CTE, LABELS_CTE, *ctes]) + "\n" + body


WINDOWED = [
    "event_count_1h", "event_count_24h", "distinct_event_types_24h_proxy",
    "metric_mean_24h", "metric_std_24h", "metric_z_24h", "delta_1", "pct_change_1h", "pct_change_24h",
    "time_since_last_event_seconds", "amount_diff_1", "amount_diff_2",
]
CALENDAR = ["hour_of_day", "day_of_week"]
WAVES = ["sin_hourly", "cos_hourly", "sin_daily", "cos_daily"]
SINCE = ["time_since_last_fraud_seconds", "time_since_last_anomaly_seconds"]
COUNTS = ["event_count_1h", "event_count_24h", "distinct_event_types_24h_proxy", *CALENDAR]

_WAVE_SQL = ", ".join(
    f"{fn}(2 * pi() * (epoch_us(ts) / 1e6) / {period}) as {fn}_{name}"
    for name, period in (("hourly", "3600.0"), ("daily", "86400.0"))
    for fn in ("sin", "cos")
)
FEATURE_CTES = (
    """f1 as (select *, amount - lag(amount) over w as delta_1, amount - lag(amount) over w as amount_diff_1,
 (epoch_us(ts) - lag(epoch_us(ts)) over w) / 1e6 as time_since_last_event_seconds
from raw window w as (partition by entity_id order by ts, event_id))""",
    """f2 as (select *, amount_diff_1 - lag(amount_diff_1) over (partition by entity_id order by ts, event_id) as amount_diff_2,
 count(*) over h1 as event_count_1h, count(*) over h24 as event_count_24h,
 count(*) over h24 as distinct_event_types_24h_proxy,
 avg(amount) over h24 as metric_mean_24h, stddev_samp(amount) over h24 as metric_std_24h,
 first_value(amount) over h1 as first_1h, first_value(amount) over h24 as first_24h
from f1 window h1 as (partition by entity_id order by ts range between interval 1 hour preceding and current row),
 h24 as (partition by entity_id order by ts range between interval 24 hours preceding and current row))""",
    f"""feat as materialized (select * exclude (first_1h, first_24h),
 case when metric_std_24h > 0 then (amount - metric_mean_24h) / metric_std_24h else 0 end as metric_z_24h,
 case when first_1h > 0 then (amount - first_1h) / first_1h * 100 else 0 end as pct_change_1h,
 case when first_24h > 0 then (amount - first_24h) / first_24h * 100 else 0 end as pct_change_24h,
 extract(hour from ts) as hour_of_day, dayofweek(ts) as day_of_week, {_WAVE_SQL}
from f2)""",
)


def with_features(body: str, *ctes: str, labels: bool = False) -> str:
    head = [RAW_CTE, *([LABELS_CTE] if labels else []), *FEATURE_CTES]
    return "with " + ",\n".join([*head, *ctes]) + "\n" + body


def feature_select(columns: Sequence[str]) -> str:
    """SQL select list matching `feature_frame`."""
    return ", ".join(f"cast({c} as bigint) as {c}" if c in COUNTS else f"{r6(c)} as {c}" for c in columns)


def feature_frame(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = [F.col(c).cast("long").alias(c) if c in COUNTS else spark_r6(F.col(c)).alias(c) for c in columns]
    return df.select("event_id", *out)


# Long form of the baseline features, profile per signal, and the score of every event. Values are cut
# to nine digits on both sides: percentile bands compare for equality, and a z-score such as 1/sqrt(2)
# that many events share may differ between engines in its last bit.
SCORE_DIGITS = 9
_PERCENTILES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
LONG_CTE = (
    "lng as materialized ("
    + "\nunion all ".join(
        f"select event_id, source_dataset, entity_type, '{c}' as feature, round(cast({c} as double), {SCORE_DIGITS}) as v from feat where {c} is not null"
        for c in C.BASELINE_FEATURES
    )
    + ")"
)
PROFILE_CTE = (
    "prof as materialized (select source_dataset, entity_type, feature, count(*) as n, avg(v) as mean, stddev_samp(v) as std, "
    + ", ".join(f"quantile_cont(v, {p}) as {n}" for n, p in _PERCENTILES.items())
    + ", quantile_cont(v, 0.75) - quantile_cont(v, 0.25) as iqr, min(v) as min, max(v) as max"
    " from lng group by all having count(*) > 10)"
)
PARTS_CTE = """parts as (select event_id, feature,
 case when std = 0 then 0 else abs((v - mean) / std) end as z,
 case when iqr = 0 then 0 when v < p25 - 1.5 * iqr then least((p25 - 1.5 * iqr - v) / iqr, 5)
  when v > p75 + 1.5 * iqr then least((v - p75 - 1.5 * iqr) / iqr, 5) else 0 end as i,
 case when v <= p1 or v >= p99 then 1.0 when v <= p5 or v >= p95 then 0.7 when v <= p25 or v >= p75 then 0.3 else 0 end as p
from lng join prof using (source_dataset, entity_type, feature))"""
COMBINED_CTE = (
    "comb as (select event_id, feature, z, i, p, cast(0.4 * least(z / 5, 1) + 0.3 * least(i / 3, 1) + 0.3 * p as double) as c from parts)"
)
SCORE_CTE = f"""scored as materialized (select feat.*, round(coalesce(s.score, 0.0), {SCORE_DIGITS}) as baseline_score from feat left join
 (select event_id, 0.6 * avg(c) + 0.4 * max(c) as score from comb group by event_id) s using (event_id))"""
SCORE_CTES = (LONG_CTE, PROFILE_CTE, PARTS_CTE, COMBINED_CTE, SCORE_CTE)


def with_scores(body: str, *ctes: str, labels: bool = False) -> str:
    return with_features(body, *SCORE_CTES, *ctes, labels=labels)
