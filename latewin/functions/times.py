"""Event times as whole epoch seconds, from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number and as a calendar time.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
CALENDAR = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"


def _whole_seconds(ts: Column) -> Column:
    micros = F.unix_micros(ts)
    seconds = micros / F.lit(1_000_000.0)
    return F.when(micros < 0, F.ceil(seconds)).otherwise(F.floor(seconds)).cast("long")


def canonical_time(text: Column) -> Column:
    """A whole number as it is, else a timestamp in the session zone, else null."""
    return F.coalesce(
        text.try_cast("bigint"), F.unix_timestamp(F.try_to_timestamp(text))
    )


def lenient_time(text: Column) -> Column:
    """Any number truncated, or a date or timestamp with optional fraction; else null."""
    trimmed = F.trim(text)
    number = F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double").try_cast("bigint"))
    calendar = F.when(trimmed.rlike(CALENDAR), trimmed.try_cast("timestamp"))
    return F.coalesce(number, _whole_seconds(calendar))


def to_event_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def to_epoch(ts: Column) -> Column:
    return ts.cast("long")
