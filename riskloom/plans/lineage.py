"""Cutting long lineages in a way that survives losing an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for a table written on the way, in the shared folder the session names.

    A private folder is taken only where none is configured and the master is local (tests).
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="riskloom-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write_scratch(df: DataFrame, name: str = "step") -> tuple[DataFrame, str]:
    """The same rows, read back from a written table, and its folder."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """The same rows, read back from a written table.

    A table rather than a checkpoint of rows: later passes prune columns and push filters into it,
    and lost executors cost only a re-read.
    """
    return write_scratch(df, name)[0]


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder that `write_scratch` made, wherever it lies; nothing may read it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
