"""Structured Streaming forms. Sources are the given events, written in time order as landing files."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import CALENDAR, WINDOWED, feature_frame, feature_select, micros, query, rounded, with_features, with_raw, with_scores
from registry.fixtures import r6, raw_events
from registry.q_explain import WEIGHTS
from registry.q_reports import scored
from riskloom.operators import explain, impact
from riskloom.plans.lineage import scratch_folder
from riskloom.schema import RAW_EVENTS
from riskloom.streaming import counts as stream_counts
from riskloom.streaming.features import FeatureStream, run_feature_stream
from riskloom.streaming.score import Scoring, run_scoring_stream, stream_totals
from riskloom.streaming.source import deduplicated, stream_events

SLICES = 3


ALL_FILES = 1_000_000  # one micro-batch per landed slice


def land_in_slices(df, path: str, after_each, slices: int = SLICES) -> None:
    """Append equal slices of the time span one after the other, calling `after_each` in between."""
    span = df.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    width = (span["b"] - span["a"]) // slices + 1
    part = F.floor((F.unix_micros("ts") - F.lit(span["a"])) / F.lit(width))
    for i in range(slices):
        df.filter(part == i).write.mode("append").parquet(path)
        after_each()


def _drain(spark, df, make_stream, name):
    """Land `df` in slices, run the stream over each into a table, and read the table."""
    path, out, checkpoint = (scratch_folder(spark, f"{name}-{x}") for x in ("landing", "out", "checkpoint"))
    schema = None

    def run():
        nonlocal schema
        stream = make_stream(path)
        schema = stream.schema
        query_ = (
            stream.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query_.awaitTermination()

    land_in_slices(df, path, run)
    return spark.read.schema(schema).parquet(out)


@query("stream_source", with_raw("select event_id, epoch_us(ts) as ts from raw where source_dataset = 'CERT'"))
def stream_source(spark, d):
    out = _drain(spark, raw_events(spark, d), lambda p: stream_events(spark, p, RAW_EVENTS, ALL_FILES, "CERT"), "arrived")
    return micros(out.select("event_id", "ts"), "ts")


@query("stream_dedup", with_raw("select event_id, source_dataset from raw"))
def stream_dedup(spark, d):
    """Every event lands twice; one copy passes."""
    ev = raw_events(spark, d)
    make = lambda p: deduplicated(stream_events(spark, p, RAW_EVENTS, ALL_FILES))
    return _drain(spark, ev.unionByName(ev), make, "unique").select("event_id", "source_dataset")


_BOTH = [*WINDOWED, *CALENDAR]


@query("stream_features", with_features(f"select event_id, {feature_select(_BOTH)} from feat"))
def stream_features(spark, d):
    path, state, out, checkpoint = (scratch_folder(spark, x) for x in ("landing", "state", "features", "checkpoint"))
    run = lambda: run_feature_stream(spark, path, state, out, checkpoint, files_per_batch=ALL_FILES)
    land_in_slices(raw_events(spark, d), path, run)
    return feature_frame(spark.read.parquet(out), _BOTH)


@query("stream_features_late", with_features(f"select event_id, {feature_select(_BOTH)} from feat"))
def stream_features_late(spark, d):
    """Events land in no order: most of the second and third slice is late, and corrects what came before."""
    path, state, out, checkpoint = (scratch_folder(spark, x) for x in ("landing", "state", "features", "checkpoint"))
    ev = raw_events(spark, d)
    slice_of = F.pmod(F.xxhash64("event_id"), F.lit(SLICES))
    for i in range(SLICES):
        ev.filter(slice_of == i).write.mode("append").parquet(path)
        run_feature_stream(spark, path, state, out, checkpoint, files_per_batch=ALL_FILES)
    return feature_frame(FeatureStream(state, out).current(spark), _BOTH)


def _scored_stream(spark, d):
    """Baseline-scored feature rows landing as files, run through the scoring stream."""
    rows = scored(spark, d, every_feature=True).withColumn("anomaly_score", F.col("baseline_score"))
    rows = rows.withColumn("is_anomaly", F.when(F.col("anomaly_score") >= 0.5, 1).otherwise(0))
    stats = explain.stats_dict(explain.feature_stats(rows))
    scoring = Scoring(lambda df: df, stats, WEIGHTS, impact.rules(spark))
    path, out, checkpoint = (scratch_folder(spark, x) for x in ("landing", "scored-stream", "checkpoint"))
    run = lambda: run_scoring_stream(spark, path, rows.schema, scoring, out, checkpoint, ALL_FILES)
    land_in_slices(rows, path, run)
    return out


@query("stream_score")
def stream_score(spark, d):
    out = _scored_stream(spark, d)
    return spark.read.parquet(f"{out}/anomalies").select("event_id", "entity_id", "anomaly_score", "summary", "scenario", "cost")


@query(
    "stream_run",
    with_scores(
        f"""select n as total_processed, hits as total_anomalies, {r6('hits / greatest(n, 1)')} as anomaly_rate from
 (select count(*) as n, count(*) filter (baseline_score >= 0.5) as hits from scored)"""
    ),
)
def stream_run(spark, d):
    """Totals of the whole run."""
    return rounded(stream_totals(spark, _scored_stream(spark, d)), ["anomaly_rate"])


def _window_sql(size_us: int, slide_us: int) -> str:
    copies = size_us // slide_us
    return f"""select entity_id, s as window_start, s + {size_us} as window_end, count(*) as n from
 (select entity_id, (epoch_us(ts) // {slide_us} - k) * {slide_us} as s from raw, (select unnest(range({copies})) as k)) group by all"""


@query("window_counts_tumbling", with_raw(_window_sql(3_600_000_000, 3_600_000_000)))
def window_counts_tumbling(spark, d):
    return micros(stream_counts.window_counts(raw_events(spark, d)), "window_start", "window_end")


@query("window_counts_sliding", with_raw(_window_sql(6 * 3_600_000_000, 3_600_000_000)))
def window_counts_sliding(spark, d):
    return micros(stream_counts.window_counts(raw_events(spark, d), "6 hours", "1 hour"), "window_start", "window_end")


@query(
    "session_counts",
    with_raw(
        """select entity_id, min(t) as window_start, max(t) + 1800000000 as window_end, count(*) as n from
 (select entity_id, t, sum(fresh) over (partition by entity_id order by t) as s from
 (select entity_id, epoch_us(ts) as t, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by entity_id order by ts) < 1800000000 then 0 else 1 end as fresh from raw))
 group by entity_id, s"""
    ),
)
def session_counts(spark, d):
    return micros(stream_counts.session_counts(raw_events(spark, d)), "window_start", "window_end")


# The watermark of the last batch stands a day before the newest event of all.
_CLOSED = "(select max(epoch_us(ts)) from raw) - 86400000000"


def _counted_stream(spark, d, **window):
    path, out, checkpoint = (scratch_folder(spark, x) for x in ("landing", "counts", "checkpoint"))
    run = lambda: stream_counts.run_count_stream(spark, path, out, checkpoint, files_per_batch=ALL_FILES, **window)
    land_in_slices(raw_events(spark, d), path, run)
    return micros(stream_counts.current_counts(spark, out), "window_start", "window_end")


@query("stream_counts", with_raw(_window_sql(3_600_000_000, 3_600_000_000)))
def stream_counts_(spark, d):
    """Hourly counts by the stream, open windows included."""
    return _counted_stream(spark, d)


@query("stream_counts_sliding", with_raw(_window_sql(6 * 3_600_000_000, 3_600_000_000)))
def stream_counts_sliding(spark, d):
    return _counted_stream(spark, d, size="6 hours", slide="1 hour")


@query("stream_counts_closed", with_raw(f"select * from ({_window_sql(3_600_000_000, 3_600_000_000)}) where window_end <= {_CLOSED}"))
def stream_counts_closed(spark, d):
    """Hourly counts a stream appends: windows that the watermark has passed."""
    make = lambda p: stream_counts.window_counts(stream_events(spark, p, RAW_EVENTS, ALL_FILES))
    return micros(_drain(spark, raw_events(spark, d), make, "hourly"), "window_start", "window_end")
