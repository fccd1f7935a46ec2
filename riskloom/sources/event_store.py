"""A stored event table that grows by upserts: an event already there, by source and event id, stays as it is.

Rows lie in folders per source and delta; a delta is what one upsert added, or several of those joined. Nothing
is rewritten in place. A small table beside them keeps, for every folder, its number of rows, its least and
largest id, and a Bloom filter in pages of 32,768 bits: an id has one page of a filter and four bits in it.
An upsert joins the ids of its batch with those pages first. Only folders that may hold one of them are read,
and of these only the key columns; a batch of new events reads next to none of the table.

A delta counts once its row in `folders` is written, after its data and its filter. So a failed upsert
leaves nothing that is read, and one done again under its own name takes the place of the first try.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.ingest import EVENT_KEY, coerce_events, first_per_key
from riskloom.plans.lineage import cut_lineage, drop_scratch
from riskloom.plans.small import broadcast_if_small
from riskloom.schema import RAW_EVENTS, conform
from riskloom.streaming.source import stream_events

PAGE_BITS = 32_768
KEYS_PER_PAGE = 3_000  # eleven bits a key, of which four are set: one absent id in 80 passes
BITS = 4
DELTAS = 32

FOLDERS = "source_dataset string, delta string, n long, least string, most string, pages int, replaced array<string>"
FILTERS = "source_dataset string, delta string, page int, bits binary"


def _page(pages: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), F.col("event_id")), pages).cast("int")


def _bit(i: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), F.col("event_id")), F.lit(PAGE_BITS)).cast("int")


def _is_set(bits: str, at: Column) -> Column:
    """Whether a bit of a page is set."""
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, at % 8) == 1


class EventStore:
    """The table in the folder `path`, which every executor reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def folders(self) -> DataFrame:
        """One row for each live folder."""
        every = self._table("folders", FOLDERS)
        gone = every.select("source_dataset", F.explode("replaced").alias("delta")).distinct()
        return every.join(broadcast_if_small(gone), ["source_dataset", "delta"], "left_anti")

    def _data(self, folders: list) -> DataFrame | None:
        """Rows of folders, which are named, not searched for."""
        paths = [f"{self.path}/data/source_dataset={r['source_dataset']}/delta={r['delta']}" for r in folders]
        if not paths:
            return None
        return conform(self.spark.read.option("basePath", f"{self.path}/data").parquet(*paths), RAW_EVENTS)

    def read(self, sources: list[str] | None = None) -> DataFrame:
        """The events of all sources, or of some."""
        live = self.folders() if sources is None else self.folders().filter(F.col("source_dataset").isin(sources))
        found = self._data(live.select("source_dataset", "delta").collect())
        return self.spark.createDataFrame([], RAW_EVENTS) if found is None else found

    def suspects(self, keys: DataFrame, but: str | None = None) -> DataFrame:
        """(source_dataset, event_id, delta): folders that may hold a key, by range and filter."""
        live = self.folders() if but is None else self.folders().filter(F.col("delta") != but)
        asked = keys.select(*EVENT_KEY).join(broadcast_if_small(live), "source_dataset")
        asked = asked.filter(F.col("event_id").between(F.col("least"), F.col("most"))).withColumn("page", _page(F.col("pages")))
        pages = self._table("filters", FILTERS)
        held = asked.select(*EVENT_KEY, "delta", "page").join(pages, ["source_dataset", "delta", "page"])
        for i in range(1, BITS + 1):
            held = held.filter(_is_set("bits", _bit(i)))
        return held.select(*EVENT_KEY, "delta")

    def new_rows(self, batch: DataFrame, but: str | None = None) -> DataFrame:
        """Of canonical rows with distinct keys, those the table does not hold; reads suspected folders only."""
        # at most as many rows as there are folders
        touched = self.suspects(batch, but).select("source_dataset", "delta").distinct().collect()
        stored = self._data(touched)
        return batch if stored is None else batch.join(stored.select(*EVENT_KEY), EVENT_KEY, "left_anti")

    def upsert(self, batch: DataFrame, name: str) -> None:
        """Add the first row of every key the table does not hold yet, as the delta `name`.

        Rows short of a required column go, as in `coerce_events`. The same name again replaces its own delta.
        """
        rows = cut_lineage(first_per_key(coerce_events(batch)), "upsert-batch")
        self._add(self.new_rows(rows, name), name, {})

    def _add(self, rows: DataFrame, name: str, replaced: dict[str, list[str]]) -> None:
        rows.withColumn("delta", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "source_dataset", "delta"
        ).parquet(f"{self.path}/data")
        try:
            written = self.spark.read.option("basePath", f"{self.path}/data").parquet(f"{self.path}/data/source_dataset=*/delta={name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return  # nothing was new, or the batch was empty
        keys = written.select(*EVENT_KEY)
        pages = F.ceil(F.count("*") / KEYS_PER_PAGE).cast("int").alias("pages")
        told = keys.groupBy("source_dataset").agg(F.count("*").alias("n"), F.min("event_id").alias("least"), F.max("event_id").alias("most"), pages)
        told = cut_lineage(told, "upsert-folders")
        at = keys.join(broadcast_if_small(told.select("source_dataset", "pages")), "source_dataset").select(
            "source_dataset", _page(F.col("pages")).alias("page"), F.explode(F.array(*[_bit(i) for i in range(1, BITS + 1)])).alias("bit")
        )
        filters = at.groupBy("source_dataset", "page").agg(F.bitmap_construct_agg("bit").alias("bits"))
        self._write(filters.withColumn("delta", F.lit(name)), FILTERS, f"filters/upsert={name}")
        given = [(s, d) for s, d in replaced.items()] or [(None, None)]
        gone = self.spark.createDataFrame(given, "source_dataset string, replaced array<string>")
        self._write(told.withColumn("delta", F.lit(name)).join(F.broadcast(gone), "source_dataset", "left"), FOLDERS, f"folders/upsert={name}")

    def _write(self, rows: DataFrame, schema: str, folder: str) -> None:
        names = [c.split()[0] for c in schema.split(", ")]
        rows.select(*names).write.mode("overwrite").parquet(f"{self.path}/{folder}")

    def compact(self, name: str, most: int = DELTAS) -> list[str]:
        """Join the deltas of every source that has more than `most`, as the delta `name`; returns those sources.

        Readers see the old folders until the new ones are complete, and then only those.
        """
        live = self.folders().groupBy("source_dataset").agg(F.collect_list("delta").alias("deltas")).filter(F.size("deltas") > most).collect()
        if live:
            rows = self._data([{"source_dataset": r["source_dataset"], "delta": d} for r in live for d in r["deltas"]])
            self._add(rows.repartition("source_dataset", F.substring("event_id", 1, 2)), name, {r["source_dataset"]: r["deltas"] for r in live})
        return sorted(r["source_dataset"] for r in live)

    def vacuum(self) -> int:
        """Delete folders that compaction has replaced; nothing may still be reading them."""
        every = self._table("folders", FOLDERS)
        gone = every.select("source_dataset", F.explode("replaced").alias("delta")).distinct().collect()
        for r in gone:
            drop_scratch(self.spark, f"{self.path}/data/source_dataset={r['source_dataset']}/delta={r['delta']}")
        return len(gone)


def run_upsert_stream(spark: SparkSession, source: str, store: EventStore, checkpoint: str, files_per_batch: int = 100):
    """Upsert all files waiting in `source`, then stop; a batch done again replaces its own delta."""

    def add(df: DataFrame, batch_id: int) -> None:
        store.upsert(df, f"batch{batch_id}")
        if batch_id and batch_id % DELTAS == 0:
            store.compact(f"upto{batch_id}", 1)

    stream = stream_events(spark, source, RAW_EVENTS, files_per_batch)
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
