"""Point-in-time features of arriving events, by the same operator that builds the batch table, in any order of arrival.

A batch is computed together with what its features can look back on: its entities' events on the days of
the longest window around each of its rows, and their last two events however old.

A row older than its entity's last one is late. It has features like any other, and it changes those of
rows already emitted: all rows up to the longest window after it, and the two rows that follow it, however
far. Just these are computed again and go to `corrections`, with the batch's number as their version; the
newest version of a row counts. What follows a late row is found in `edges`, the first and last rows of each
entity and day, so no more of the history is read than the days around late rows and corrected ones.

Every write goes to a folder named by the batch and no batch reads its own or later folders, so a replayed
batch overwrites its own output and changes nothing else. An event is known by source and event id; events
that may arrive twice go through `deduplicated` first.
"""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.expressions import MICROS, epoch_micros
from riskloom.operators.features import FeaturePlan, build_features
from riskloom.operators.ingest import EVENT_KEY
from riskloom.plans.hotkeys import DEFAULT_LIMITS, SkewLimits, find_hot, running, with_tail_rows
from riskloom.plans.sampling import top_per_group
from riskloom.plans.small import has_rows
from riskloom.schema import EVENT_COLUMNS, RAW_EVENTS
from riskloom.streaming.source import stream_events

LOOKBACK_ROWS = 2
COMPACT_EVERY = 50
# A batch that spans more days reads the history without naming its day folders.
NAMED_DAYS = 90


def _read(spark: SparkSession, path: str, base: str | None = None) -> DataFrame | None:
    try:
        return (spark.read.option("basePath", base) if base else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _last_rows(rows: DataFrame) -> DataFrame:
    return top_per_group(rows, ["entity_id"], [F.desc("ts"), F.desc("event_id")], LOOKBACK_ROWS)


def _edge_rows(rows: DataFrame, in_tasks: bool = False) -> DataFrame:
    """First and last rows of each entity and day; by one sort if the days of an entity fit in a task (`in_tasks`)."""
    by_day = ["entity_id", "day"]
    dated = rows.withColumn("day", F.to_date("ts"))
    if in_tasks:
        w = Window.partitionBy(*by_day)
        placed = dated.withColumns({"_rn": F.row_number().over(w.orderBy("ts", "event_id")), "_n": F.count("*").over(w)})
        ends = placed.filter((F.col("_rn") <= LOOKBACK_ROWS) | (F.col("_rn") > F.col("_n") - LOOKBACK_ROWS)).drop("_rn", "_n")
        # an event is of one entity and day, so copies lie in one task already
        return ends.dropDuplicates([*by_day, *EVENT_KEY])
    ends = [top_per_group(dated, by_day, [f("ts"), f("event_id")], LOOKBACK_ROWS) for f in (F.asc, F.desc)]
    return ends[0].unionByName(ends[1]).dropDuplicates(EVENT_KEY)


def _add(rows: DataFrame | None, more: DataFrame | None) -> DataFrame | None:
    """Rows of both, each event once; `rows` win."""
    if rows is None or more is None:
        return more if rows is None else rows
    return rows.unionByName(more.join(rows.select(*EVENT_KEY), EVENT_KEY, "left_anti"), allowMissingColumns=True)


def _newest(rows: DataFrame) -> DataFrame:
    """The newest version of each event's features."""
    return top_per_group(rows, EVENT_KEY, [F.desc("version")], 1)


class FeatureStream:
    """Folders under `state`: history (by day, then batch), tails (last rows per entity and batch), edges (first
    and last rows per entity, day and batch), corrections; features as first emitted go to `out`."""

    def __init__(
        self,
        state: str,
        out: str,
        labels: DataFrame | None = None,
        settings: dict[str, Any] | None = None,
        limits: SkewLimits = DEFAULT_LIMITS,
    ):
        self.state, self.out, self.labels, self.settings, self.limits = state, out, labels, settings, limits
        plan = FeaturePlan(settings)
        self.seconds = plan.longest
        used = [plan.stat_column, plan.delta_column, plan.diff_column]
        self.edge_columns = list(dict.fromkeys([*EVENT_KEY, "entity_id", "ts", *filter(None, used)]))

    def _upto(self, spark: SparkSession, name: str, batch_id: int) -> DataFrame | None:
        """Rows written before this batch: the newest compacted base and the batches after it."""
        base_id = (batch_id - 1) // COMPACT_EVERY * COMPACT_EVERY if batch_id > 0 else 0
        rows = _read(spark, f"{self.state}/{name}")
        if rows is not None:
            rows = rows.filter((F.col("batch_id") < batch_id) & (F.col("batch_id") >= base_id)).drop("batch_id")
        base = _read(spark, f"{self.state}/{name}-base/upto={base_id}") if base_id > 0 else None
        if base is not None:
            rows = base if rows is None else rows.unionByName(base)
        return rows

    def _around(self, rows: DataFrame, batch_id: int, forward: bool) -> DataFrame | None:
        """Stored events on the days that the windows of `rows` reach, of the same entity."""
        spark = rows.sparkSession
        reach = F.make_dt_interval(secs=F.lit(float(self.seconds)))
        last = F.col("ts") + reach if forward else F.col("ts")
        # times stay inside Spark, under its session zone; the driver's clock zone plays no part
        days = F.sequence(F.to_date(F.col("ts") - reach), F.to_date(last))
        wanted = rows.select("entity_id", F.explode(days).alias("day")).distinct()
        named = [r["d"] for r in wanted.select(F.date_format("day", "yyyy-MM-dd").alias("d")).distinct().limit(NAMED_DAYS + 1).collect()]
        base = f"{self.state}/history"
        if len(named) > NAMED_DAYS:
            history = _read(spark, base)
        else:
            history = _read(spark, f"{base}/day={{{','.join(sorted(named))}}}", base) if named else None
        if history is None:
            return None
        stored = history.filter(F.col("batch_id") < batch_id).join(wanted, ["entity_id", "day"], "left_semi")
        return stored.select(*EVENT_COLUMNS)

    def _changed(self, rows: DataFrame) -> DataFrame:
        """Stored rows whose features a late row changes; `rows` hold the `_late` rows and what may follow them."""
        seconds = self.seconds
        at = rows.withColumns({"_t": epoch_micros("ts"), "_kind": F.lit(0)}).withColumn("_late_t", F.when(F.col("_late"), F.col("_t")))
        hot = find_hot(at, ["entity_id"], "_t", seconds, SkewLimits(self.limits.segment_rows, self.limits.segment_rows, self.limits.local_table_rows))
        swept = running(at, hot, ["entity_id"], maxes=["_late_t"])
        tailed, part = with_tail_rows(swept, hot, ["entity_id"], ["_t", "event_id"], ["_late"], LOOKBACK_ROWS)
        w = Window.partitionBy(*part).orderBy("_t", "event_id")
        follows: Column = F.lit(False)
        for k in range(1, LOOKBACK_ROWS + 1):
            follows = follows | F.coalesce(F.lag("_late", k).over(w), F.lit(False))
        marked = tailed.withColumn("_follows", follows).filter(~F.col("_ghost"))
        inside = F.coalesce(F.col("_t") - F.col("_late_t") <= seconds * MICROS, F.lit(False))
        return marked.filter(F.col("_stored") & (inside | F.col("_follows"))).select(*EVENT_KEY, "entity_id", "ts")

    def _earlier(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame | None, DataFrame | None]:
        """(stored rows the batch's features need, keys of stored rows it changes), both None on a first batch."""
        spark = batch.sparkSession
        tails = self._upto(spark, "tails", batch_id)
        if tails is None:
            return None, None
        tails = _last_rows(tails.join(batch.select("entity_id").distinct(), "entity_id", "left_semi")).persist()
        self._held.append(tails)
        seen = tails.groupBy("entity_id").agg(F.max(F.struct("ts", "event_id")).alias("_seen"))
        late = batch.join(seen, "entity_id").filter(F.struct("ts", "event_id") < F.col("_seen")).select(*EVENT_COLUMNS)
        if not has_rows(late):
            return _add(self._around(batch, batch_id, forward=False), tails), None
        near = _add(self._around(batch, batch_id, forward=True), tails)
        edges = self._upto(spark, "edges", batch_id)
        if edges is not None:
            edges = edges.select(*self.edge_columns).join(late.select("entity_id").distinct(), "entity_id", "left_semi")
            near = _add(near, edges)
        near = near.persist()
        self._held.append(near)
        narrow = lambda df, is_late, stored: df.select(*EVENT_KEY, "entity_id", "ts", is_late.alias("_late"), F.lit(stored).alias("_stored"))
        of_late = late.select("entity_id").distinct()
        is_late = F.coalesce(F.struct("ts", "event_id") < F.col("_seen"), F.lit(False))
        rows = narrow(batch.join(seen, "entity_id", "left"), is_late, False).unionByName(narrow(near, F.lit(False), True))
        changed = self._changed(rows.join(of_late, "entity_id", "left_semi")).persist()
        self._held.append(changed)
        # a changed row far from the batch's own days needs its whole row and window
        far = self._around(changed, batch_id, forward=False)
        return _add(far, near), changed.select(*EVENT_KEY)

    def process(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Features of the batch's rows; also updates the folders and corrects rows emitted before."""
        spark = batch.sparkSession
        batch = batch.select(*EVENT_COLUMNS).persist()
        self._held: list[DataFrame] = [batch]
        try:
            most = batch.groupBy("entity_id").count().agg(F.max("count")).first()[0]
            if not most:
                return batch
            past, changed = self._earlier(batch, batch_id)
            marked = batch.withColumn("_new", F.lit(True))
            if past is not None:
                past = past.select(*EVENT_COLUMNS).withColumn("_new", F.lit(False))
                if changed is not None:
                    past = past.join(changed.withColumn("_fix", F.lit(True)), EVENT_KEY, "left")
                marked = marked.unionByName(past, allowMissingColumns=True)
            features = build_features(marked, self.labels, self.settings, self.limits)
            if changed is not None:
                features = features.filter(F.col("_new") | F.col("_fix")).persist()
                self._held.append(features)
                fixed = features.filter(~F.col("_new")).drop("_new", "_fix").withColumn("version", F.lit(batch_id))
                fixed.write.mode("overwrite").parquet(f"{self.state}/corrections/batch_id={batch_id}")
                features = features.drop("_fix")
            features.filter("_new").drop("_new").write.mode("overwrite").parquet(f"{self.out}/batch_id={batch_id}")
            _last_rows(batch).write.mode("overwrite").parquet(f"{self.state}/tails/batch_id={batch_id}")
            _edge_rows(batch, most <= self.limits.segment_rows).select(*self.edge_columns).write.mode("overwrite").parquet(f"{self.state}/edges/batch_id={batch_id}")
            (
                batch.withColumns({"day": F.to_date("ts"), "batch_id": F.lit(batch_id)})
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("day", "batch_id")
                .parquet(f"{self.state}/history")
            )
            if batch_id > 0 and batch_id % COMPACT_EVERY == 0:
                self._compact(spark, batch_id)
            return spark.read.parquet(f"{self.out}/batch_id={batch_id}")
        finally:
            for df in self._held:
                df.unpersist()

    def _compact(self, spark: SparkSession, batch_id: int) -> None:
        """What the folders of all batches before `batch_id` come down to, as the new base of each."""
        for name, reduce in (("tails", _last_rows), ("edges", _edge_rows), ("corrections", _newest)):
            rows = self._upto(spark, name, batch_id)
            if rows is not None:
                reduce(rows).drop("day").write.mode("overwrite").parquet(f"{self.state}/{name}-base/upto={batch_id}")

    def current(self, spark: SparkSession) -> DataFrame:
        """Features of all events so far, each in its newest version; `version` is the batch that made it."""
        first = spark.read.parquet(self.out).withColumnRenamed("batch_id", "version").withColumn("version", F.col("version").cast("int"))
        last = first.agg(F.max("version")).first()[0]
        fixed = self._upto(spark, "corrections", last + 1)
        if fixed is None:
            return first
        newest = _newest(fixed).select(*first.columns)
        return first.join(newest.select(*EVENT_KEY), EVENT_KEY, "left_anti").select(*first.columns).unionByName(newest)


def run_feature_stream(
    spark: SparkSession,
    source: str,
    state: str,
    out: str,
    checkpoint: str,
    labels: DataFrame | None = None,
    files_per_batch: int = 100,
):
    """Process all files waiting in `source`, then stop; run again for new files."""
    worker = FeatureStream(state, out, labels)
    stream = stream_events(spark, source, RAW_EVENTS, files_per_batch)
    query = (
        stream.writeStream.foreachBatch(lambda df, i: worker.process(df, i))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
