"""Time functions. Instants are ``timestamp``; text forms are always UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.functions.text import strip

# The precision a timestamp's length stands for, and its floor in seconds.
PRECISION_OF_LENGTH = {19: "second", 16: "minute", 13: "hour", 10: "day"}
PRECISION_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since the epoch as a long; accepts either timestamp type."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value)


def timestamp_precision(raw: Column) -> Column:
    """second / minute / hour / day, judged by length without the zone."""
    body = F.regexp_replace(strip(raw), r"Z+\z", "")
    has_plus = body.rlike(r"(?s)\A[^T]*T.*\+")
    no_zone = F.when(
        has_plus, F.regexp_extract(body, r"(?s)\A([^T]*T[^+]*)\+", 1)
    ).otherwise(F.regexp_replace(body, r"(?s)\A([^T]*T[^-]*)-.*", "$1"))
    length = F.length(no_zone)
    out = F.lit("second")
    for size, name in PRECISION_OF_LENGTH.items():
        out = F.when(length == size, F.lit(name)).otherwise(out)
    return F.when(raw.isNull(), F.lit(None).cast("string")).otherwise(out)


def precision_floor(precision: Column) -> Column:
    """Seconds covered by one step of that precision; unknown counts as 1."""
    out = F.lit(1)
    for name, seconds in PRECISION_SECONDS.items():
        out = F.when(precision == name, F.lit(seconds)).otherwise(out)
    return out


# ISO 8601 as a date part, an optional time after any one separator, an optional offset.
_DATE = r"(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-?W\d{2}(?:-?[1-7])?)"
_CLOCK = (
    r"([01]\d|2[0-3])(?::([0-5]\d)(?::([0-5]\d)(?:[.,](\d+))?)?"
    r"|([0-5]\d)(?:([0-5]\d)(?:[.,](\d+))?)?)?"
)
_OFFSET = (
    r"(?:([+-])([01]\d|2[0-3])(?::([0-5]\d)(?::([0-5]\d)(?:\.\d+)?)?"
    r"|([0-5]\d)([0-5]\d)?)?)?"
)
ISO = rf"(?s)\A{_DATE}(?:.{_CLOCK}{_OFFSET})?\z"


# What the pattern accepts is rewritten step by step to one spelling that casts.
_CANONICAL = [
    (r"\A(\d{4})(\d{2})(\d{2})(?=\D|\z)", "$1-$2-$3"),
    (r"(?s)\A(.{10})\z", "$1T00:00:00"),
    (r"(?s)\A(.{10}).", "$1T"),
    (r"\A(.{11}\d{2})(\d{2})(\d{2})(?=[.,+-]|\z)", "$1:$2:$3"),
    (r"\A(.{11}\d{2})(\d{2})(?=[+-]|\z)", "$1:$2"),
    (r"\A(.{11}\d{2})(?=[+-]|\z)", "$1:00"),
    (r"\A(.{11}\d{2}:\d{2})(?=[+-]|\z)", "$1:00"),
    (r"\A(.{19})[.,](\d{1,6})\d*", "$1.$2"),
    (r"\A(.{19}[^+-]*[+-]\d{2})\z", "$1:00"),
    (r"\A(.{19}[^+-]*[+-]\d{2})(\d{2})(\d{2})?\z", "$1:$2"),
    (r"\A(.{19}[^+-]*[+-]\d{2}:\d{2})[:.\d]*\z", "$1"),
    (r"\A(.{19}[^+-]*)\z", "$1+00:00"),
]


def _week_to_calendar(value: Column) -> Column:
    """``2026-W32-2T...`` with the week written as a calendar date."""
    compact = F.replace(F.regexp_extract(value, _DATE, 1), F.lit("-"), F.lit(""))
    week = F.substring(compact, 6, 2).try_cast("int")
    weekday = F.coalesce(F.substring(compact, 8, 1).try_cast("int"), F.lit(1))
    fourth = F.concat(F.substring(compact, 1, 4), F.lit("-01-04")).try_cast("date")
    day = F.date_add(F.date_trunc("week", fourth).cast("date"), (week - 1) * 7 + weekday - 1)
    valid = (week >= 1) & (F.weekofyear(day) == week)
    return F.when(
        valid, F.concat(day.cast("string"), F.regexp_replace(value, rf"\A{_DATE}", ""))
    )


def parse_iso(raw: Column) -> Column:
    """ISO 8601 text to an instant; blank or malformed gives null, no zone means UTC.

    The pattern decides what is accepted, so that neither Spark's wider casts
    (``2026``, ``9:12``) nor its narrower ones (``T09:12+00:00``) leak through.
    """
    value = F.replace(strip(raw), F.lit("Z"), F.lit("+00:00"))
    text = F.when(value.rlike(r"\A\d{4}-?W"), _week_to_calendar(value)).otherwise(value)
    for pattern, replacement in _CANONICAL:
        text = F.regexp_replace(text, pattern, replacement)
    return F.when(value.rlike(ISO), text.try_cast("timestamp"))


def rfc3339_micros(ts: Column) -> Column:
    """``2026-08-04T09:12:04.000000Z`` for an instant in a UTC session."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def export_time(ts: Column) -> Column:
    """Millisecond precision, truncated, with ``Z``."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_offset_text(ts: Column) -> Column:
    """Python's ``isoformat()`` of a UTC time: no fraction when it is zero."""
    stamp = ts.cast("timestamp")
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(stamp, ".SSSSSS")
    return F.concat(
        whole, F.when(fraction != ".000000", fraction).otherwise(F.lit("")), F.lit("+00:00")
    )


def hour_of_week(ts: Column) -> Column:
    """0 for Monday 00h to 167 for Sunday 23h, UTC."""
    stamp = ts.cast("timestamp")
    return F.weekday(stamp) * 24 + F.hour(stamp)


def observed_days(observing_since: Column, now: Column) -> Column:
    """Whole days since observation began; 0 when it has not."""
    return F.coalesce(
        F.floor((micros(now) - micros(observing_since)) / (86400 * MICROS)), F.lit(0)
    ).cast("long")


def run_seconds(started: Column, finished: Column) -> Column:
    return (micros(finished) - micros(started)) / F.lit(MICROS)
