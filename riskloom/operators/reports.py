"""Summaries of events, features and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import config as C
from riskloom.plans.ranks import statistics

# A column shows its distinct count below the first, its values up to the second.
SHOW_COUNT_BELOW = 20
SHOW_VALUES_UPTO = 10
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def source_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("source_dataset").agg(
        F.count("*").alias("event_count"),
        F.countDistinct("entity_id").alias("entity_count"),
        F.min("ts").alias("first_event"),
        F.max("ts").alias("last_event"),
    )


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(top) if top else counts


def amount_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("row_count"),
        F.count("amount").alias("amount_count"),
        F.avg("amount").alias("amount_mean"),
        F.min("amount").alias("amount_min"),
        F.max("amount").alias("amount_max"),
        F.min("ts").alias("first_event"),
        F.max("ts").alias("last_event"),
    )


def _flat_columns(df: DataFrame) -> list[str]:
    nested = (T.StructType, T.MapType, T.ArrayType)
    return [f.name for f in df.schema if not isinstance(f.dataType, nested)]


def _long(df: DataFrame, values: dict[str, Column], value_name: str) -> Column:
    """(column, value) pairs as an array, to be exploded."""
    return F.array(*[F.struct(F.lit(n).alias("column_name"), v.alias(value_name)) for n, v in values.items()])


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: nulls, distinct count when below 20, and the sorted values when at most 10.

    A sketch pass finds the few-valued columns, so only those are grouped exactly and the map side
    reduces them to a handful of rows.
    """
    columns = _flat_columns(df)
    sketch = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = [c for c in columns if sketch[c] <= 3 * SHOW_COUNT_BELOW]
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    null_rows = nulls.select(
        F.explode(_long(nulls, {c: F.col(c) for c in columns}, "null_count")).alias("p")
    ).select("p.*")
    if few:
        seen = (
            df.select(F.explode(_long(df, {c: F.col(c).cast("string") for c in few}, "v")).alias("p"))
            .select("p.*")
            .filter(F.col("v").isNotNull())
            .distinct()
        )
        values = seen.groupBy("column_name").agg(
            F.count("*").alias("unique_count"),
            F.array_join(F.sort_array(F.collect_list("v")), "|").alias("values_list"),
        )
    else:
        values = df.sparkSession.createDataFrame([], "column_name string, unique_count long, values_list string")
    shown = F.col("unique_count") < SHOW_COUNT_BELOW
    empty = F.col("column_name").isin(few) & F.col("unique_count").isNull()
    return null_rows.join(values, "column_name", "left").select(
        "column_name",
        "null_count",
        F.when(empty, F.lit(0).cast("long")).when(shown, F.col("unique_count")).alias("unique_count"),
        F.when(F.col("unique_count") <= SHOW_VALUES_UPTO, F.col("values_list")).alias("values_list"),
    )


def null_report(df: DataFrame) -> DataFrame:
    """Columns that hold nulls, with their share in percent."""
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    return (
        counts.select("_rows", F.explode(_long(counts, {c: F.col(c) for c in df.columns}, "null_count")).alias("p"))
        .select("p.column_name", "p.null_count", F.round(F.col("p.null_count") * 100 / F.col("_rows"), 2).alias("null_pct"))
        .filter(F.col("null_count") > 0)
    )


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(part in c for part in C.FEATURE_NAME_PARTS)]


def unpivot_numeric(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, value) with nulls left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.*").filter(F.col("value").isNotNull())


def describe(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 3) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum of every feature column."""
    columns = list(columns or feature_columns(df))
    stats = ["mean", "std", "min", *QUARTILES, "max"]
    return statistics(df, [], columns, QUARTILES).select("feature", "n", *[F.round(s, digits).alias(s) for s in stats])


def label_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n"))


def distinct_signals(df: DataFrame) -> DataFrame:
    return df.filter(F.col("source_dataset").isNotNull()).select("source_dataset", "entity_type").distinct()


def first_per_entity(df: DataFrame, whole_row: bool = False) -> DataFrame:
    """Newest value of every column per entity.

    By default each column gives its newest non-null value (a result may mix rows); `whole_row`
    takes the newest row as it stands.
    """
    rest = [c for c in df.columns if c != "entity_id"]
    newest = F.struct("ts", "event_id")
    if whole_row:
        agg = [F.max_by(F.struct(*rest), newest).alias("_r")]
        return df.groupBy("entity_id").agg(*agg).select("entity_id", "_r.*").select(*df.columns)
    return (
        df.groupBy("entity_id")
        .agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), newest)).alias(c) for c in rest])
        .select(*df.columns)
    )


def entity_span(df: DataFrame) -> DataFrame:
    return df.groupBy("entity_id").agg(F.min("ts").alias("ts_start"), F.max("ts").alias("ts_end"))


def score_histogram(df: DataFrame, score: str = "baseline_score", bins: int = 50, by: str = "source_dataset") -> DataFrame:
    """Counts per equal-width bin of [0, 1] and source."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(score).isNotNull()).groupBy(by, b.alias("bin")).agg(F.count("*").alias("n"))


def score_quartiles(df: DataFrame, score: str, by: str) -> DataFrame:
    """Box-plot numbers of a score per group, exact."""
    return statistics(df, [by], [score], QUARTILES).select(by, "n", "min", "max", "mean", *QUARTILES)


def anomaly_rate(df: DataFrame, score: str = "baseline_score", threshold: float = 0.5) -> DataFrame:
    hits = F.count_if(F.col(score) >= threshold)
    return df.agg(
        F.count("*").alias("total"),
        hits.alias("anomalies"),
        F.when(F.count("*") > 0, hits / F.count("*")).otherwise(F.lit(0.0)).alias("rate"),
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def schema_report(df: DataFrame) -> DataFrame:
    """Column positions, names and types of a table, with its row count."""
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(n).alias("column_name"), F.lit(t).alias("data_type"))
            for i, (n, t) in enumerate(df.dtypes)
        ]
    )
    return df.agg(F.count("*").alias("row_count")).select(F.explode(pairs).alias("p"), "row_count").select("p.*", "row_count")


def read_events(df: DataFrame, start=None, end=None, limit: int | None = 100) -> DataFrame:
    """Events inside a closed time range, newest first."""
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    ordered = df.orderBy(F.desc("ts"), F.desc("event_id"))
    return ordered.limit(limit) if limit else ordered


def top_anomalies(df: DataFrame, score: str, threshold: float = 0.5, n: int | None = None) -> DataFrame:
    """Rows at or above the threshold, highest first; ties by event_id."""
    hits = df.filter(F.col(score) >= threshold).orderBy(F.desc(score), F.asc("event_id"))
    return hits.limit(n) if n else hits
