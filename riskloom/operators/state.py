"""Entity state by the hour: intervals of constant state, snapshots, state as of a time, transitions, memory.

State is what an entity did in the hour that ends and in the last 24. It changes only where an hour with
events enters, and one and 24 hours later where it leaves: at most three change points for each hour with
events, however long the entity is quiet in between. Everything here comes from the intervals between change
points; only a result that is one row per hour is laid out by the hour, at its end.

An entity's state runs from the hour of its first event to that of its last one. Functions with time bounds
pass them on to the event table, so only the hours they need are read, and beside them each entity's span.
"""

from __future__ import annotations

import math
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600
DAY_HOURS = 24
SPIKE = 2.0
ENTITY = ["entity_type", "entity_id"]
STATE = ["events_1h", "events_24h", "amount_24h", "success_rate_24h"]


def _hour(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(HOUR * 1_000_000)).cast("long")


def _time(hour: Column) -> Column:
    """The end of an hour, which is the time of its snapshot."""
    return F.timestamp_seconds((hour + 1) * HOUR)


def _seconds(at: datetime | str) -> float:
    """Seconds since the epoch of a time in UTC, given as text or as a datetime."""
    t = datetime.fromisoformat(at) if isinstance(at, str) else at
    return (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp()


def _last_hour(upto: datetime | str) -> int:
    """The last hour that ends at or before a time."""
    return math.floor(_seconds(upto) / HOUR) - 1


def _between(events: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """Events of the hours `first` to `last`, as bounds on the time column that reach the scan."""
    bound = lambda hour: F.lit(datetime.fromtimestamp(hour * HOUR, timezone.utc))
    if first is not None:
        events = events.filter(F.col("ts") >= bound(first))
    return events if last is None else events.filter(F.col("ts") < bound(last + 1))


def hourly_totals(events: DataFrame) -> DataFrame:
    """Per entity and hour: events, successes and summed amount. `h` counts hours since the epoch."""
    return events.groupBy(*ENTITY, _hour(F.col("ts")).alias("h")).agg(
        F.count("*").alias("events"),
        F.count_if(F.col("status") == "success").alias("successes"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"),
    )


def _spans(events: DataFrame) -> DataFrame:
    """First and last hour of every entity."""
    return events.groupBy(*ENTITY).agg(_hour(F.min("ts")).alias("a"), _hour(F.max("ts")).alias("b"))


def _intervals(events: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """entity, h, until, and the state from hour h to hour `until`; of hours `first` to `last`, if given."""
    hours = hourly_totals(_between(events, None if first is None else first - DAY_HOURS + 1, last))
    nothing = [F.lit(0).cast("long").alias("events"), F.lit(0).cast("long").alias("successes"), F.lit(0.0).alias("amount")]
    leaves = hours.select(*ENTITY, F.explode(F.array(F.col("h") + 1, F.col("h") + DAY_HOURS)).alias("h"), *nothing)
    points = hours.unionByName(leaves)
    spans = _spans(events)
    if first is not None:
        # entities that were there all along are quiet, not absent
        starts = spans.filter(F.col("b") >= first)
        if last is not None:
            starts = starts.filter(F.col("a") <= last)
        points = points.unionByName(starts.select(*ENTITY, F.greatest("a", F.lit(first)).alias("h"), *nothing))
    points = points.groupBy(*ENTITY, "h").agg(*[F.sum(c).alias(c) for c in ("events", "successes", "amount")])
    by_time = Window.partitionBy(*ENTITY).orderBy("h")
    day = by_time.rangeBetween(1 - DAY_HOURS, 0)
    n = F.sum("events").over(day)
    states = points.select(
        *ENTITY,
        "h",
        F.lead("h").over(by_time).alias("_next"),
        F.col("events").alias("events_1h"),
        n.alias("events_24h"),
        F.sum("amount").over(day).alias("amount_24h"),
        F.when(n > 0, F.sum("successes").over(day) / n).alias("success_rate_24h"),
    ).join(spans.select(*ENTITY, "b"), ENTITY)
    end = F.col("b") if last is None else F.least("b", F.lit(last))
    states = states.withColumn("until", F.least(F.col("_next") - 1, end)).filter(F.col("h") <= end)
    if first is not None:
        states = states.filter(F.col("h") >= first)
    return states.select(*ENTITY, "h", "until", *STATE)


def state_intervals(events: DataFrame, start=None, end=None) -> DataFrame:
    """State with its validity: the first and the last hourly snapshot that show it, and how many there are.

    Rows grow with the hours that have events, not with the time between them. With `start` or `end`, of
    snapshots inside that closed range.
    """
    first = None if start is None else math.ceil(_seconds(start) / HOUR) - 1
    rows = _intervals(events, first, None if end is None else _last_hour(end))
    span = (F.col("until") - F.col("h") + 1).alias("snapshots")
    return rows.select(*ENTITY, _time(F.col("h")).alias("valid_from"), _time(F.col("until")).alias("valid_to"), span, *STATE)


def _laid_out(intervals: DataFrame) -> DataFrame:
    """One row for each hour. Events of the hour itself make an interval of their own."""
    return intervals.select(*ENTITY, F.explode(F.sequence("h", "until")).alias("h"), *STATE).select(*ENTITY, _time(F.col("h")).alias("snapshot_ts"), *STATE)


def state_snapshots(events: DataFrame) -> DataFrame:
    """State at the end of every hour from an entity's first to its last event."""
    return _laid_out(_intervals(events))


def snapshot_asof(events: DataFrame, as_of) -> DataFrame:
    """Latest snapshot per entity at or before a time: one pass over the events before it."""
    last = _last_hour(as_of)
    at = _spans(events).filter(F.col("a") <= last).select(*ENTITY, F.least("b", F.lit(last)).alias("at"))
    hours = hourly_totals(_between(events, None, last)).join(at, ENTITY).filter(F.col("h") > F.col("at") - DAY_HOURS)
    held = hours.groupBy(*ENTITY).agg(
        F.coalesce(F.sum(F.when(F.col("h") == F.col("at"), F.col("events"))), F.lit(0)).alias("events_1h"),
        F.sum("events").alias("events_24h"),
        F.sum("amount").alias("amount_24h"),
        F.sum("successes").alias("_good"),
    )
    return at.join(held, ENTITY, "left").select(
        *ENTITY,
        _time(F.col("at")).alias("snapshot_ts"),
        F.coalesce("events_1h", F.lit(0)).alias("events_1h"),
        F.coalesce("events_24h", F.lit(0)).alias("events_24h"),
        F.coalesce("amount_24h", F.lit(0.0)).alias("amount_24h"),
        (F.col("_good") / F.col("events_24h")).alias("success_rate_24h"),
    )


def state_history(events: DataFrame, start, end) -> DataFrame:
    """Snapshots inside a closed range, from the events of the range and the day before it."""
    return _laid_out(_intervals(events, math.ceil(_seconds(start) / HOUR) - 1, _last_hour(end)))


def entity_memory(events: DataFrame, as_of, lookback_hours: int = 168) -> DataFrame:
    """What an entity remembers: latest state and the range of its activity over the lookback."""
    first = math.floor((_seconds(as_of) - lookback_hours * HOUR) / HOUR)
    held = (F.col("until") - F.col("h") + 1).alias("held")
    recent = _intervals(events, first, _last_hour(as_of)).withColumn("held", held)
    return recent.groupBy(*ENTITY).agg(
        F.sum("held").alias("snapshots"),
        _time(F.max("until")).alias("latest_ts"),
        F.max_by("events_24h", "until").alias("latest_events_24h"),
        F.max("events_24h").alias("peak_events_24h"),
        (F.sum(F.col("events_24h") * F.col("held")) / F.sum("held")).alias("mean_events_24h"),
        F.sum("events_1h").alias("events"),
    )


def _steps(events: DataFrame) -> DataFrame:
    """Intervals with the state before each; its first hour is where state changed, if it did."""
    w = Window.partitionBy(*ENTITY).orderBy("h")
    tracked = ["events_24h", "amount_24h"]
    return _intervals(events).select(*ENTITY, "h", "until", *tracked, *[F.lag(c).over(w).alias(f"_p_{c}") for c in tracked])


def _changes(steps: DataFrame) -> DataFrame:
    """Transitions into hour `h`, by size and kind."""

    def relative(c: str):
        before, now = F.col(f"_p_{c}"), F.col(c)
        return (now - before) / F.greatest(F.abs(before), F.lit(1.0))

    e, a = relative("events_24h"), relative("amount_24h")
    kind = (
        F.when(e >= SPIKE - 1, "activity_spike")
        .when(a >= SPIKE - 1, "amount_increase")
        .when(e <= -0.5, "activity_drop")
        .when(a <= -0.5, "amount_decrease")
        .otherwise("steady")
    )
    return steps.select(
        *ENTITY,
        _time(F.col("h") - 1).alias("from_snapshot_ts"),
        _time(F.col("h")).alias("to_snapshot_ts"),
        (F.col("events_24h") - F.col("_p_events_24h")).alias("delta_events_24h"),
        (F.col("amount_24h") - F.col("_p_amount_24h")).alias("delta_amount_24h"),
        F.greatest(F.abs(e), F.abs(a)).alias("change_magnitude"),
        kind.alias("change_type"),
    )


def state_transitions(events: DataFrame) -> DataFrame:
    """Change from the previous hour's snapshot, for every hour, with its size and kind.

    Size is the largest relative change; a factor of two up or down names the kind.
    """
    steps = _steps(events)
    tracked = [c for c in steps.columns if c not in (*ENTITY, "h", "until")]
    moved = steps.filter(F.col("_p_events_24h").isNotNull()).drop("until")
    still = steps.filter(F.col("until") > F.col("h")).select(
        *ENTITY,
        F.explode(F.sequence(F.col("h") + 1, F.col("until"))).alias("h"),
        *[F.col(c.removeprefix("_p_")).alias(c) for c in tracked],
    )
    return _changes(moved.unionByName(still))


def anomalous_transitions(events: DataFrame, magnitude: float = SPIKE - 1) -> DataFrame:
    """Transitions of a size that have a kind; only change points are looked at."""
    changes = _changes(_steps(events).filter(F.col("_p_events_24h").isNotNull()))
    return changes.filter((F.col("change_magnitude") >= magnitude) & (F.col("change_type") != "steady"))
