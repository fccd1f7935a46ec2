"""Normalising rows into the canonical tables, and appending them without duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.expressions import parse_utc
from riskloom.schema import (
    ENTITY_TYPES,
    EVENT_COLUMNS,
    INGEST_BATCHES,
    LABEL_COLUMNS,
    LABELS,
    RAW_EVENTS,
    REQUIRED_EVENT_COLUMNS,
    REQUIRED_LABEL_COLUMNS,
    STATUSES,
    conform,
)


def _require(df: DataFrame, columns: Sequence[str], table: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{table} is missing columns: {missing}")


def _timestamp(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp")
    return parse_utc(name)


def _number(df: DataFrame, name: str) -> Column:
    x = F.col(name).try_cast("double")
    return F.when(~F.isnan(x), x)


def _json(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_json(F.col(name), {"ignoreNullFields": "false"})
    return F.col(name).cast("string")


def coerce_events(df: DataFrame) -> DataFrame:
    """Canonical types; unreadable times and amounts become null; rows short of a required column go."""
    _require(df, EVENT_COLUMNS, "raw_events")
    typed = df.withColumns(
        {"ts": _timestamp(df, "ts"), "amount": _number(df, "amount"), "metadata": _json(df, "metadata")}
    )
    return conform(typed.dropna(subset=REQUIRED_EVENT_COLUMNS), RAW_EVENTS)


def coerce_labels(df: DataFrame) -> DataFrame:
    """Same for labels; an open end stays null."""
    _require(df, LABEL_COLUMNS, "labels_outcomes")
    typed = df.withColumns(
        {
            "ts_start": _timestamp(df, "ts_start"),
            "ts_end": _timestamp(df, "ts_end"),
            "metadata": _json(df, "metadata"),
        }
    )
    return conform(typed.dropna(subset=REQUIRED_LABEL_COLUMNS), LABELS)


def fill_canonical(df: DataFrame) -> DataFrame:
    return conform(df, RAW_EVENTS)


def split_invalid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) by the two enumerations; a null member is rejected."""
    ok = F.coalesce(F.col("entity_type").isin(ENTITY_TYPES) & F.col("status").isin(STATUSES), F.lit(False))
    return df.filter(ok), df.filter(~ok)


EVENT_KEY = ["source_dataset", "event_id"]


def first_per_key(df: DataFrame, key: Sequence[str] = EVENT_KEY) -> DataFrame:
    """Earliest row per key; the rank filter prunes copies before the shuffle."""
    order = [F.asc("ts"), *[F.asc(c) for c in df.columns if c not in key and c != "ts"]]
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def new_events(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the batch to append: first per key, and no key already stored."""
    return first_per_key(batch).join(existing.select(*EVENT_KEY), EVENT_KEY, "left_anti").select(*batch.columns)


def upsert_events(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Table contents after an insert that leaves stored keys untouched."""
    return existing.unionByName(new_events(existing, coerce_events(batch)))


def append_labels(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Labels are appended as they are; repeats are kept."""
    return existing.unionByName(coerce_labels(batch))


def ensure_batches(existing: DataFrame, batches: DataFrame) -> DataFrame:
    """Batch register with unseen batch ids added once."""
    w = Window.partitionBy("ingest_batch_id").orderBy("source_dataset", "notes")
    fresh = (
        conform(batches, INGEST_BATCHES)
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") == 1)
        .drop("_rn")
        .join(existing.select("ingest_batch_id"), "ingest_batch_id", "left_anti")
    )
    return existing.unionByName(fresh)
