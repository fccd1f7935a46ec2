"""Canonical tables on shared storage, and small JSON side files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.schema import conform


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return conform(df, schema) if schema is not None else df


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ("source_dataset",)) -> None:
    """Rebuild or append; files are laid out by source so a source filter prunes folders."""
    by = [c for c in partition_by if c in df.columns]
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_by_day(df: DataFrame, path: str, mode: str = "append", ts: str = "ts") -> None:
    """Long histories: folders per source and day, so a time range prunes too."""
    df.withColumn("day", F.to_date(ts)).write.mode(mode).partitionBy("source_dataset", "day").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Any JDBC table; url, dbtable, credentials and partitioning come from the caller."""
    return spark.read.format("jdbc").options(**options).load()


def save_side_table(df: DataFrame, path: str) -> None:
    """Profiles, feature statistics, importances: JSON lines, arrays and structs included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load_side_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
