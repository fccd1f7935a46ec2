"""What the text operators share: reading tables, running Arrow functions, lineage cuts, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.plans.lineage import drop_scratch, write_scratch

ROWS_PER_STEP = 512
BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
RELEASE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path only Spark needs to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: str) -> F.Column:
    """A-Z to a-z and nothing else (`lower` would also change letters outside ASCII)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.col(column), upper, upper.lower())


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Apply `fn` to slices of at most ROWS_PER_STEP rows; what it yields is the result.

    A batch of whole texts is held by the executor and by its Python worker at once, so the session bounds its
    bytes from here on (Spark's default is 64 MB), unless it has a bound of its own.
    """
    conf = df.sparkSession.conf
    if conf.get(BYTES_PER_BATCH, None) is None:
        conf.set(BYTES_PER_BATCH, "4m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_STEP):
                yield from fn(batch.slice(at, ROWS_PER_STEP))

    return df.mapInArrow(run, schema)


def row_numbers(df: DataFrame) -> DataFrame:
    """The rows with a number of their own, `row`, in front. Numbers hold only within one run of the plan: write them down before use."""
    return df.select(F.monotonically_increasing_id().alias("row"), "*")


class Scratch:
    """Tables written inside a `with` block: deleted at its end, but for those kept, which go to the block around it.

    What leaves the block may only read kept tables; everything else must have been computed by then.
    """

    _open: ClassVar[list[Scratch]] = []

    def __init__(self) -> None:
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        self._open.append(self)
        return self

    def __exit__(self, *error: object) -> None:
        self._open.remove(self)
        for df, path in self.tables:
            drop_scratch(df.sparkSession, path)

    def _entry(self, df: DataFrame) -> tuple[DataFrame, str]:
        entry = next(t for t in self.tables if t[0] is df)
        self.tables.remove(entry)
        return entry

    def keep(self, df: DataFrame) -> DataFrame:
        """A table, as `written` gave it, to outlive the block."""
        entry, at = self._entry(df), self._open.index(self)
        if at:
            self._open[at - 1].tables.append(entry)
        return df

    def drop(self, df: DataFrame) -> None:
        """Delete a table now."""
        drop_scratch(df.sparkSession, self._entry(df)[1])


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df` from a table in the shared folder, so that a lost executor costs only a re-read.

    The write is a query of its own that nothing else reads, so its shuffle files go as soon as it ends. The
    table belongs to the innermost open Scratch block.
    """
    conf = df.sparkSession.conf
    before = conf.get(RELEASE_SHUFFLES, None)
    conf.set(RELEASE_SHUFFLES, "true")
    try:
        table, path = write_scratch(df, f"llm-{name}")
        if Scratch._open:
            Scratch._open[-1].tables.append((table, path))
        return table
    finally:
        if before is None:
            conf.unset(RELEASE_SHUFFLES)
        else:
            conf.set(RELEASE_SHUFFLES, before)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): (node, root), root = smallest node of the component.

    Each round takes the smallest root among neighbours, hooks roots onto it and then follows the root
    once (pointer jumping), so chains shrink by halves; every round is written. Nothing is collected
    but one count per round. Any orderable node type does.
    """
    with Scratch() as mine:
        both = written(
            edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
        )
        labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "roots")
        for _ in range(max_rounds):
            with Scratch() as step:
                near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
                joined = labels.join(near.withColumnRenamed("a", "node"), "node").withColumn("low", F.least("root", "near"))
                # a root is hooked onto the smallest root any of its members sees
                hooks = written(joined.groupBy(F.col("root").alias("old")).agg(F.min("low").alias("hook")), "hooks")
                hooked = written(
                    joined.join(hooks, joined["root"] == hooks["old"]).select("node", "root", F.least("low", "hook").alias("new")),
                    "hooked",
                )
                jump = hooked.select(F.col("node").alias("new"), F.col("new").alias("far"))
                far = hooked.join(jump, "new").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved"))
                moved = step.keep(written(far, "roots"))
            mine.drop(labels)
            labels = moved
            if moved.agg(F.count_if("moved")).first()[0] == 0:
                mine.keep(moved)
                return moved.select("node", "root")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
