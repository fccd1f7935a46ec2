"""Raw source files read into the canonical tables.

Every source has a reader (files to text columns) and mappings (columns to events and labels), so the
mappings also work on tables that already hold the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.expressions import (
    MICROS,
    iso_utc,
    micros_to_ts,
    normalize_status,
    parse_utc,
    stable_event_id,
)
from riskloom.operators.ingest import coerce_events, coerce_labels
from riskloom.schema import EVENT_COLUMNS, LABEL_COLUMNS
from riskloom.sources.rows import with_row_index

# Source names, ingest batch ids and the first instant of the two transaction sets.
CARD, CARD_BATCH, CARD_START = "CREDITCARD", "creditcard_001", "2013-09-01"
ECOM, ECOM_BATCH, ECOM_START = "IEEE_CIS", "ieee_cis_txn_001", "2017-12-01"
LOGON, LOGON_BATCH = "CERT", "cert_logon_001"
DEVICE_BATCH = "cert_device_001"
METRIC, METRIC_BATCH, METRIC_GROUP = "NAB", "nab_realKnownCause_001", "realKnownCause"

# Accepted header names per device-log field, best first.
DEVICE_HEADERS = {
    "id": ["id", "row_id", "event_id"],
    "date": ["date", "datetime", "timestamp", "time"],
    "user": ["user", "username", "userid"],
    "pc": ["pc", "device", "host"],
    "activity": ["activity", "action", "event"],
}
DELIMITERS = [",", ";", "\t", "|"]


def read_csv(spark: SparkSession, path, delimiter: str = ",", line_breaks: bool = False) -> DataFrame:
    """Header CSV as text columns; a doubled quote inside quotes is one quote.

    Splits follow the file sizes. Fields that hold line breaks need `line_breaks`, which reads each file
    in one task.
    """
    reader = spark.read.option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"')
    return reader.option("multiLine", line_breaks).csv(path)


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter seen most often in the first line."""
    first = spark.read.text(path).limit(1).first()
    line = first[0] if first else ""
    return max(DELIMITERS, key=line.count)


def _events(df: DataFrame, **columns: Column) -> DataFrame:
    named = [columns.get(c, F.lit(None).cast("string")).alias(c) for c in EVENT_COLUMNS]
    return coerce_events(df.select(*named))


def _labels(df: DataFrame, **columns: Column) -> DataFrame:
    named = [columns.get(c, F.lit(None).cast("string")).alias(c) for c in LABEL_COLUMNS]
    return coerce_labels(df.select(*named))


def _after(start: str, seconds: Column) -> Column:
    micros = F.round(seconds.try_cast("double") * MICROS).cast("long")
    return micros_to_ts(F.unix_micros(F.lit(start).cast("timestamp")) + micros)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


# --- card transactions -------------------------------------------------------------------------


def read_card(spark: SparkSession, path: str) -> DataFrame:
    return with_row_index(read_csv(spark, path))


def card_events(df: DataFrame, row: str = "row_index") -> DataFrame:
    """One purchase per file row; the V columns are kept as JSON."""
    entity = F.concat(F.lit("cc_txn_"), F.col(row).cast("string"))
    kept = [c for c in df.columns if c.startswith("V")]
    return _events(
        df,
        event_id=stable_event_id(F.lit(CARD), F.col(row)),
        ts=_after(CARD_START, F.col("Time")),
        entity_type=F.lit("user"),
        entity_id=entity,
        event_type=F.lit("transaction_auth"),
        status=F.lit("success"),
        amount=F.col("Amount"),
        currency=F.lit("EUR"),
        user_id=entity,
        channel=F.lit("card_present"),
        source_dataset=F.lit(CARD),
        ingest_batch_id=F.lit(CARD_BATCH),
        metadata=_json(**{c: F.col(c).try_cast("double") for c in kept}) if kept else F.lit("{}"),
    )


def card_labels(df: DataFrame, row: str = "row_index") -> DataFrame:
    return _labels(
        df.filter(F.col("Class").try_cast("double") == 1),
        ts_start=_after(CARD_START, F.col("Time")),
        label_scope=F.lit("user"),
        scope_id=F.concat(F.lit("cc_txn_"), F.col(row).cast("string")),
        label_type=F.lit("fraud"),
        label=F.lit(1),
        severity=F.lit(5),
        source_dataset=F.lit(CARD),
        ingest_batch_id=F.lit(CARD_BATCH),
        metadata=_json(**{"class": F.lit(1)}),
    )


# --- e-commerce transactions -------------------------------------------------------------------


def read_ecom(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """All rows of the file, or its first `rows` by position, picked without gathering them."""
    df = read_csv(spark, path)
    if rows is None:
        return df
    return with_row_index(df).filter(F.col("row_index") < rows).drop("row_index")


def ecom_events(df: DataFrame) -> DataFrame:
    txn = F.col("TransactionID").cast("string")
    entity = F.concat(F.lit("user_"), txn)
    return _events(
        df,
        event_id=stable_event_id(F.lit(ECOM), txn),
        ts=_after(ECOM_START, F.floor(F.col("TransactionDT").try_cast("double"))),
        entity_type=F.lit("user"),
        entity_id=entity,
        event_type=F.lit("transaction_auth"),
        status=F.lit("success"),
        amount=F.col("TransactionAmt"),
        currency=F.lit("USD"),
        user_id=entity,
        channel=F.lit("payment"),
        source_dataset=F.lit(ECOM),
        ingest_batch_id=F.lit(ECOM_BATCH),
        metadata=_json(transaction_id=txn),
    )


def ecom_labels(df: DataFrame) -> DataFrame:
    """Fraud labels; a file without the fraud column has none."""
    txn = F.col("TransactionID").cast("string")
    fraud = F.col("isFraud").try_cast("double") == 1 if "isFraud" in df.columns else F.lit(False)
    return _labels(
        df.filter(fraud),
        ts_start=_after(ECOM_START, F.floor(F.col("TransactionDT").try_cast("double"))),
        label_scope=F.lit("user"),
        scope_id=F.concat(F.lit("user_"), txn),
        label_type=F.lit("fraud"),
        label=F.lit(1),
        severity=F.lit(5),
        source_dataset=F.lit(ECOM),
        ingest_batch_id=F.lit(ECOM_BATCH),
        metadata=_json(transaction_id=txn),
    )


# --- logons ------------------------------------------------------------------------------------

# Source dates come as ISO or as month/day/year; the first pattern that fits is used.
DATE_PATTERNS = ["M/d/yyyy H:mm:ss", "M/d/yyyy H:mm"]


def tolerant_ts(c: Column | str) -> Column:
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(parse_utc(text), *[F.try_to_timestamp(text, F.lit(p)) for p in DATE_PATTERNS])


def unreadable_dates(df: DataFrame, column: str = "date") -> DataFrame:
    """The rows whose date no pattern reads. They give no event; a caller may keep them as rejects."""
    return df.filter(tolerant_ts(column).isNull())


def logon_events(df: DataFrame) -> DataFrame:
    """Logins; status from `success`, else from `activity`, else unknown."""
    if "success" in df.columns:
        said = F.col("success").cast("string")
    elif "activity" in df.columns:
        word = F.lower(F.trim(F.col("activity").cast("string")))
        said = F.when(word.isin("logon", "logoff"), "success").otherwise(word)
    else:
        said = F.lit("unknown")
    pc = F.col("pc").cast("string") if "pc" in df.columns else F.lit(None).cast("string")
    parsed = df.withColumn("_ts", tolerant_ts("date")).filter(F.col("_ts").isNotNull() & F.col("user").isNotNull())
    status = normalize_status(said)
    user = F.col("user").cast("string")
    return _events(
        parsed,
        event_id=stable_event_id(F.lit(LOGON), user, iso_utc("_ts"), F.coalesce(pc, F.lit("nan")), status),
        ts=F.col("_ts"),
        entity_type=F.lit("user"),
        entity_id=user,
        event_type=F.lit("login"),
        status=status,
        user_id=user,
        device_id=pc,
        source_dataset=F.lit(LOGON),
        ingest_batch_id=F.lit(LOGON_BATCH),
        metadata=F.lit("{}"),
    )


# --- devices -----------------------------------------------------------------------------------


def read_device(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, sniff_delimiter(spark, path))


def device_columns(df: DataFrame) -> dict[str, str] | None:
    """Field to actual header, case ignored; None when a field is missing."""
    by_lower = {c.lower(): c for c in df.columns}
    found = {f: next((by_lower[n] for n in names if n in by_lower), None) for f, names in DEVICE_HEADERS.items()}
    return None if None in found.values() else found  # type: ignore[return-value]


def device_events(df: DataFrame) -> DataFrame:
    """Device log rows; an input without the needed headers gives no events."""
    names = device_columns(df)
    if names is None:
        empty = df.limit(0).select(*[F.lit(None).cast("string").alias(c) for c in EVENT_COLUMNS])
        return coerce_events(empty)
    col = {f: F.col(f"`{n}`") for f, n in names.items()}
    whole = df.filter(col["id"].isNotNull() & col["user"].isNotNull() & col["pc"].isNotNull() & col["activity"].isNotNull())
    return _events(
        whole,
        event_id=col["id"].cast("string"),
        ts=tolerant_ts(col["date"]),
        entity_type=F.lit("device"),
        entity_id=col["pc"].cast("string"),
        event_type=F.lower(col["activity"].cast("string")),
        status=F.lit("success"),
        user_id=col["user"].cast("string"),
        device_id=col["pc"].cast("string"),
        channel=F.lit("endpoint"),
        source_dataset=F.lit(LOGON),
        ingest_batch_id=F.lit(DEVICE_BATCH),
        metadata=_json(cert_row_id=col["id"].cast("string")),
    )


# --- metric series -----------------------------------------------------------------------------


def file_stem(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return read_csv(spark, folder).select("timestamp", "value", F.col("_metadata.file_name").alias("file_name"))


def metric_events(df: DataFrame) -> DataFrame:
    """One observation per row; the metric is the file stem."""
    metric = file_stem(F.col("file_name"))
    parsed = df.withColumn("_ts", tolerant_ts("timestamp")).filter(F.col("_ts").isNotNull())
    return _events(
        parsed,
        event_id=stable_event_id(F.lit(METRIC), metric, iso_utc("_ts")),
        ts=F.col("_ts"),
        entity_type=F.lit("system_metric"),
        entity_id=metric,
        event_type=F.lit("metric_observation"),
        status=F.lit("success"),
        amount=F.col("value"),
        source_dataset=F.lit(METRIC),
        ingest_batch_id=F.lit(METRIC_BATCH),
        metadata=_json(nab_file=F.col("file_name")),
    )


def read_metric_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))


def metric_labels(df: DataFrame) -> DataFrame:
    """Labels from JSON text {path: [window, ...]}; a window is a start or a start and an end."""
    pairs = df.select(F.explode(F.from_json("json", "map<string,array<string>>")).alias("path", "windows"))
    windows = (
        pairs.filter(F.col("path").contains(METRIC_GROUP))
        .select("path", F.explode("windows").alias("w"))
        .select("path", F.split(F.trim("w"), r"\s+").alias("part"))
        .filter(F.size("part") >= 2)
    )
    start = parse_utc(F.concat_ws(" ", F.slice("part", 1, 2)))
    end = F.when(F.size("part") >= 4, parse_utc(F.concat_ws(" ", F.slice("part", 3, 2))))
    return _labels(
        windows,
        ts_start=start,
        ts_end=end,
        label_scope=F.lit("system_metric"),
        scope_id=file_stem(F.col("path")),
        label_type=F.lit("anomaly"),
        label=F.lit(1),
        severity=F.lit(3),
        source_dataset=F.lit(METRIC),
        ingest_batch_id=F.lit(METRIC_BATCH),
        metadata=_json(nab_label_path=F.col("path")),
    )
