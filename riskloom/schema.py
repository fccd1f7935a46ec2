"""Canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()

RAW_EVENTS = T.StructType(
    [
        T.StructField("event_id", _S),
        T.StructField("ts", T.TimestampType()),
        T.StructField("entity_type", _S),
        T.StructField("entity_id", _S),
        T.StructField("event_type", _S),
        T.StructField("status", _S),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", _S),
        T.StructField("user_id", _S),
        T.StructField("merchant_id", _S),
        T.StructField("api_client_id", _S),
        T.StructField("device_id", _S),
        T.StructField("ip_hash", _S),
        T.StructField("ua_hash", _S),
        T.StructField("endpoint", _S),
        T.StructField("error_code", _S),
        T.StructField("channel", _S),
        T.StructField("source_dataset", _S),
        T.StructField("ingest_batch_id", _S),
        T.StructField("metadata", _S),
    ]
)

LABELS = T.StructType(
    [
        T.StructField("ts_start", T.TimestampType()),
        T.StructField("ts_end", T.TimestampType()),
        T.StructField("label_scope", _S),
        T.StructField("scope_id", _S),
        T.StructField("label_type", _S),
        T.StructField("label", T.IntegerType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("source_dataset", _S),
        T.StructField("ingest_batch_id", _S),
        T.StructField("metadata", _S),
    ]
)

INGEST_BATCHES = T.StructType(
    [
        T.StructField("ingest_batch_id", _S),
        T.StructField("source_dataset", _S),
        T.StructField("notes", _S),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("prediction_id", _S),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("entity_id", _S),
        T.StructField("source_dataset", _S),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("predicted_label", T.IntegerType()),
    ]
)

FEEDBACK = T.StructType(
    [
        T.StructField("prediction_id", _S),
        T.StructField("actual_label", T.IntegerType()),
        T.StructField("notes", _S),
        T.StructField("recorded_at", T.TimestampType()),
    ]
)

EVENT_COLUMNS = RAW_EVENTS.fieldNames()
LABEL_COLUMNS = LABELS.fieldNames()

# Columns a row must fill, and the accepted members of the two enumerations.
REQUIRED_EVENT_COLUMNS = [
    "event_id", "ts", "entity_type", "entity_id",
    "event_type", "status", "source_dataset", "ingest_batch_id",
]
REQUIRED_LABEL_COLUMNS = [
    "ts_start", "label_scope", "scope_id", "label_type",
    "label", "source_dataset", "ingest_batch_id",
]
ENTITY_TYPES = ["user", "merchant", "api_client", "device", "system_metric"]
STATUSES = ["success", "fail", "unknown"]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add absent columns as null and put every column in canonical order and type."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )
