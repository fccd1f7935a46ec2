"""The given `events` table read as canonical events and labels, for Spark and for SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.schema import EVENT_COLUMNS, LABEL_COLUMNS
from riskloom.session import pin_utc


def _event_columns(text: str, ts: str) -> list[str]:
    return [
        f"sha1(concat_ws('|','EVENTS',cast(event_id as {text}))) as event_id",
        f"{ts} as ts",
        "case user_id % 5 when 1 then 'device' when 2 then 'system_metric' else 'user' end as entity_type",
        "concat(case user_id % 5 when 1 then 'dev_' when 2 then 'metric_' else 'user_' end,"
        f" cast(user_id as {text})) as entity_id",
        "event_type",
        "case event_type when 'error' then 'fail' when 'signup' then 'unknown' else 'success' end as status",
        "case when event_type = 'view' then null else value end as amount",
        "case user_id % 5 when 3 then 'USD' when 4 then 'EUR' end as currency",
        f"case when user_id % 5 <> 2 then concat('user_', cast(user_id as {text})) end as user_id",
        f"case when event_type = 'purchase' then concat('m_', cast(event_id % 50 as {text})) end as merchant_id",
        f"case when event_type = 'click' then concat('api_', cast(event_id % 20 as {text})) end as api_client_id",
        f"case when user_id % 5 in (0,1) then concat('pc_', cast(user_id % 7 as {text})) end as device_id",
        *[f"cast(null as {text}) as {c}" for c in ("ip_hash", "ua_hash", "endpoint")],
        f"case when event_type = 'error' then concat('E', cast(event_id % 4 as {text})) end as error_code",
        "case user_id % 5 when 1 then 'endpoint' when 3 then 'payment' when 4 then 'card_present' end as channel",
        "case user_id % 5 when 0 then 'CERT' when 1 then 'CERT' when 2 then 'NAB' when 3 then 'IEEE_CIS'"
        " else 'CREDITCARD' end as source_dataset",
        "case when event_id % 97 = 0 then 'adversarial_fx' else 'batch_001' end as ingest_batch_id",
        "props as metadata",
        "event_id as seq",
    ]


def _label_columns(text: str, six_hours: str) -> list[str]:
    return [
        "ts as ts_start",
        f"case when seq % 80 = 0 then ts + interval {six_hours} end as ts_end",
        "entity_type as label_scope",
        "entity_id as scope_id",
        "case when seq % 120 = 0 then 'fraud' else 'anomaly' end as label_type",
        "cast(case when seq % 200 = 0 then 0 else 1 end as int) as label",
        "cast(case when seq % 120 = 0 then 5 else 3 end as int) as severity",
        "source_dataset",
        "ingest_batch_id",
        f"concat('{{\"seq\":', cast(seq as {text}), '}}') as metadata",
    ]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def raw_with_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_event_columns("string", "cast(ts as timestamp)"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_with_seq(spark, sf_dir).select(*EVENT_COLUMNS)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fortieth event opens a label: the fixture's definition of a label, not a row cap."""
    marked = raw_with_seq(spark, sf_dir).filter("seq % 40 = 0")
    return marked.selectExpr(*_label_columns("string", "'6' hour")).select(*LABEL_COLUMNS)


# DuckDB side: prepend to a check's own WITH list.
RAW_CTE = "raw as (select " + ",\n ".join(_event_columns("varchar", "ts")) + "\nfrom events)"
LABELS_CTE = "lab as (select " + ",\n ".join(_label_columns("varchar", "6 hours")) + "\nfrom raw where seq % 40 = 0)"


def with_ctes(*ctes: str, body: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + body


def r6(expr: str, digits: int = 6) -> str:
    """Rounded double without a negative zero."""
    return f"case when round(cast({expr} as double), {digits}) = 0 then 0.0 else round(cast({expr} as double), {digits}) end"


def spark_r6(col, digits: int = 6):
    from pyspark.sql import functions as F

    r = F.round(col.cast("double"), digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)
