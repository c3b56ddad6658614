"""Row validation, duplicates and uniqueness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewin.functions.columns import resolve_columns
from latewin.functions.times import canonical_time, lenient_time

IDENTITY = ("Time", "DeviceId", "Sensor", "Value")


def _cell(name: str) -> Column:
    return F.trim(F.col(f"`{name}`"))


def _blank(cell: Column) -> Column:
    return F.coalesce(cell == "", F.lit(True))


def validate_rows(raw: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Parse string rows and say what is wrong with each.

    ``reject_reason`` is null for a good row, else ``blank`` (nothing in any
    cell), ``missing`` (a required cell is blank), ``bad_value`` or ``bad_time``.
    ``carry`` names columns that are passed through and are not data.
    """
    data = [c for c in raw.columns if c not in carry]
    names = resolve_columns(data)
    time, device, sensor, value = (
        _cell(names[k]) for k in ("event_time", "device_id", "sensor", "value")
    )
    number, seconds = value.try_cast("double"), lenient_time(time)
    empty = F.lit(True)
    for c in data:
        empty = empty & _blank(_cell(c))
    missing = _blank(time) | _blank(device) | _blank(sensor) | _blank(value)
    reason = (
        F.when(empty, "blank")
        .when(missing, "missing")
        .when(number.isNull(), "bad_value")
        .when(seconds.isNull(), "bad_time")
    )
    return raw.select(
        *carry,
        seconds.alias("event_time"),
        device.alias("device_id"),
        sensor.alias("sensor"),
        number.alias("value"),
        time.alias("raw_timestamp"),
        value.alias("raw_value"),
        reason.alias("reject_reason"),
    )


def good_rows(validated: DataFrame) -> DataFrame:
    return validated.filter("reject_reason is null").drop("reject_reason", "raw_value")


def quarantine(validated: DataFrame) -> DataFrame:
    """Rejected rows that are worth reporting; entirely blank rows are not."""
    return validated.filter("reject_reason is not null and reject_reason <> 'blank'")


def validation_counts(validated: DataFrame) -> DataFrame:
    def number(reason: str) -> Column:
        return F.count(F.when(F.col("reject_reason") == reason, 1))

    return validated.agg(
        F.count(F.when(F.col("reject_reason").isNull(), 1)).alias("valid_rows"),
        number("blank").alias("blank_rows"),
        number("missing").alias("missing_values"),
        number("bad_value").alias("bad_values"),
        number("bad_time").alias("bad_times"),
    )


def raise_on_bad_cell(validated: DataFrame) -> None:
    """Raise for the first unparsable cell by ``line``; missing cells are only counted."""
    bad = (
        validated.filter(F.col("reject_reason").isin("bad_value", "bad_time"))
        .orderBy("line")
        .limit(1)
        .collect()
    )
    if not bad:
        return
    row = bad[0]
    if row.reject_reason == "bad_value":
        raise ValueError(f"Line {row.line}: Invalid numeric value '{row.raw_value}'")
    raise ValueError(f"Line {row.line}: Unable to parse timestamp '{row.raw_timestamp}'")


def canonicalize(raw: DataFrame) -> DataFrame:
    """Typed canonical columns from string rows; unreadable cells become null."""
    names = resolve_columns(raw.columns)
    return raw.select(
        canonical_time(F.col(f"`{names['event_time']}`")).alias("Time"),
        F.col(f"`{names['device_id']}`").alias("DeviceId"),
        F.col(f"`{names['sensor']}`").alias("Sensor"),
        F.col(f"`{names['value']}`").try_cast("double").alias("Value"),
    )


def split_nulls(canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete rows, and rows with a null in any column."""
    whole = F.lit(True)
    for c in IDENTITY:
        whole = whole & F.col(c).isNotNull()
    return canonical.filter(whole), canonical.filter(~whole)


def deduplicate(canonical: DataFrame, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """One row per identity; the identity is all columns, so any copy will do."""
    return canonical.dropDuplicates(list(identity))


def duplicate_count(events: DataFrame) -> DataFrame:
    """How many rows repeat an earlier (time, device, sensor, value to 6 places)."""
    groups = events.groupBy(
        "event_time", "device_id", "sensor", F.round("value", 6).alias("value")
    ).agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("duplicate_rows")
    )


def uniqueness(rows: DataFrame, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """Rows, distinct identities, surplus copies and whether there are none."""
    groups = rows.groupBy(*identity).agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("total_rows"),
        F.count(F.lit(1)).alias("unique_rows"),
    ).select(
        "total_rows",
        "unique_rows",
        (F.col("total_rows") - F.col("unique_rows")).alias("duplicate_rows"),
        (F.col("total_rows") == F.col("unique_rows")).alias("is_unique"),
    )


def slice_first(
    rows: DataFrame, size: int, order: Sequence[str] = IDENTITY
) -> DataFrame:
    """The first rows in a fixed order, as a distributed top-k."""
    return rows.orderBy(*order).limit(size)


def in_event_order(canonical: DataFrame) -> DataFrame:
    """Event-time order with readable stand-ins for nulls."""
    return canonical.select(
        F.coalesce("Time", F.lit(0)).alias("Time"),
        F.coalesce("DeviceId", F.lit("None")).alias("DeviceId"),
        F.coalesce("Sensor", F.lit("None")).alias("Sensor"),
        F.coalesce("Value", F.lit(0.0)).alias("Value"),
    ).orderBy("Time", "DeviceId", "Sensor")


def with_event_ids(arrivals: DataFrame) -> DataFrame:
    """0-based ``arrival_sequence`` and the ids built from it."""
    sequence = F.col("n") - 1
    return arrivals.withColumns(
        {
            "arrival_sequence": sequence,
            "event_id": F.concat(F.lit("ev-"), sequence.cast("string")),
            "message_id": F.concat_ws(
                "-",
                F.col("event_time").cast("string"),
                "device_id",
                "sensor",
                sequence.cast("string"),
            ),
        }
    )
