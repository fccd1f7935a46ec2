"""Scalar expressions: identifiers, status words, timestamps, reproducible randomness."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stable_event_id(*parts: Column | str) -> Column:
    """SHA-1 over the parts joined with a bar; a null part reads 'None' so positions never shift."""
    texts = [F.coalesce(as_col(p).cast("string"), F.lit("None")) for p in parts]
    return F.sha1(F.concat_ws("|", *texts))


def iso_utc(ts: Column | str) -> Column:
    """ISO-8601 text with offset; microseconds appear only when they are not zero."""
    t = as_col(ts)
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssxxx")
    fine = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(F.unix_micros(t) % MICROS == 0, whole).otherwise(fine)


# Words that mean success or failure in source logs.
SUCCESS_WORDS = ["1", "true", "t", "success", "successful"]
FAIL_WORDS = ["0", "false", "f", "fail", "failed"]


def normalize_status(c: Column | str) -> Column:
    word = F.lower(F.trim(as_col(c).cast("string")))
    return (
        F.when(word.isin(SUCCESS_WORDS), "success")
        .when(word.isin(FAIL_WORDS), "fail")
        .otherwise("unknown")
    )


def epoch_micros(ts: Column | str) -> Column:
    return F.unix_micros(as_col(ts))


def epoch_seconds(ts: Column | str) -> Column:
    return F.unix_micros(as_col(ts)) / F.lit(float(MICROS))


def micros_to_ts(c: Column | str) -> Column:
    return F.timestamp_micros(as_col(c))


def parse_utc(c: Column | str) -> Column:
    """Tolerant parse: text that is no timestamp becomes null."""
    return F.try_to_timestamp(as_col(c).cast("string"))


def hour_of_day(ts: Column | str) -> Column:
    return F.hour(as_col(ts))


def day_of_week(ts: Column | str) -> Column:
    """Sunday is 0."""
    return F.dayofweek(as_col(ts)) - 1


def fourier(ts: Column | str, period_seconds: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * epoch_seconds(ts) / F.lit(float(period_seconds))
    return F.sin(angle), F.cos(angle)


def hash_order(id_col: Column | str, seed: str = "") -> Column:
    """Reproducible random order: MD5 of the id (a seed gives another draw)."""
    base = as_col(id_col).cast("string")
    return F.md5(F.concat(base, F.lit(seed)) if seed else base)


def unit_from_hex(hex_col: Column) -> Column:
    """Uniform in [0, 1) from the first 13 hex digits; sorts the way the hex text does."""
    return F.conv(F.substring(hex_col, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def uniform(salt: str, *parts: Column | str) -> Column:
    """Deterministic uniform draw per row, strictly inside (0, 1): 52 bits of the MD5 of salt and parts."""
    text = F.concat_ws("|", F.lit(salt), *[as_col(p).cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def standard_normal(salt: str, *parts: Column | str) -> Column:
    """Box-Muller over two deterministic uniforms."""
    u1 = uniform(salt + "/radius", *parts)
    u2 = uniform(salt + "/angle", *parts)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def exponential(salt: str, mean: Column | float, *parts: Column | str) -> Column:
    return -F.log(uniform(salt, *parts)) * mean
