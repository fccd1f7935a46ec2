"""Hand-made canonical rows."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from riskloom.schema import LABELS, RAW_EVENTS, conform

T0 = datetime(2024, 3, 3, 12, 0, 0, tzinfo=timezone.utc)  # a Sunday


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def events(spark, rows, **defaults):
    """rows: (event_id, entity_id, seconds after T0, amount[, extra columns as dict])."""
    out = []
    for event_id, entity, seconds, amount, *extra in rows:
        row = {
            "event_id": event_id,
            "ts": at(seconds),
            "entity_type": "user",
            "entity_id": entity,
            "event_type": "login",
            "status": "success",
            "amount": None if amount is None else float(amount),
            "source_dataset": "CERT",
            "ingest_batch_id": "b1",
            **defaults,
            **(extra[0] if extra else {}),
        }
        out.append(tuple(row.get(f.name) for f in RAW_EVENTS))
    return conform(spark.createDataFrame(out, RAW_EVENTS), RAW_EVENTS)


def labels(spark, rows):
    """rows: (entity, start seconds, end seconds or None, label_type, label[, batch])."""
    out = []
    for entity, start, end, kind, value, *batch in rows:
        out.append(
            (at(start), None if end is None else at(end), "user", entity, kind, value, 3, "CERT", batch[0] if batch else "b1", None)
        )
    return spark.createDataFrame(out, LABELS)


def by_id(df, *columns):
    return {r["event_id"]: (r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns)) for r in df.collect()}


def same_rows(a, b, key="event_id", tolerance=1e-9, least=1.0):
    """Row by row equality of two frames, floats within a tolerance relative to the larger of `least` and their size."""
    assert a.columns == b.columns
    left = sorted((r.asDict() for r in a.collect()), key=lambda r: tuple(str(r[k]) for k in ([key] if isinstance(key, str) else key)))
    right = sorted((r.asDict() for r in b.collect()), key=lambda r: tuple(str(r[k]) for k in ([key] if isinstance(key, str) else key)))
    assert len(left) == len(right)
    for x, y in zip(left, right):
        for c in a.columns:
            if isinstance(x[c], float) and isinstance(y[c], float):
                alike = x[c] != x[c] and y[c] != y[c]
                assert alike or abs(x[c] - y[c]) <= tolerance * max(least, abs(x[c])), (c, x, y)
            else:
                assert x[c] == y[c], (c, x, y)
