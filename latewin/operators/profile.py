"""Profile of a stream in arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewin.operators.lateness import observe_order
from latewin.operators.ordering import with_run_value
from latewin.operators.validate import duplicate_count

SHOWN_DEVICES = 20
_PREVIEW = ("n", "event_time", "device_id", "sensor", "value")


def profile_summary(events: DataFrame) -> DataFrame:
    """Disorder, lateness and time span, in one aggregate over the arrivals."""
    obs = observe_order(events)
    total = F.count(F.lit(1))
    ooo = F.sum(F.col("out_of_order").cast("long"))
    return obs.agg(
        total.alias("total_events"),
        F.min("event_time").alias("min_timestamp"),
        F.max("event_time").alias("max_timestamp"),
        (F.max("event_time") - F.min("event_time")).alias("timespan_seconds"),
        F.coalesce(ooo, F.lit(0)).alias("ooo_events"),
        F.round(ooo / total * 100, 2).alias("ooo_percentage"),
        F.max("lateness").alias("max_lateness_seconds"),
        F.round(F.sum("lateness") / total, 3).alias("avg_lateness_seconds"),
        F.coalesce(F.sum(F.col("inversion").cast("long")), F.lit(0)).alias("inversions"),
    )


def profile_values(events: DataFrame) -> DataFrame:
    """Distinct devices (first few by name) and sensors (all by name)."""
    devices = events.select("device_id").distinct()
    sensors = events.select("sensor").distinct()
    shown = devices.orderBy("device_id").limit(SHOWN_DEVICES)
    out = devices.agg(F.count(F.lit(1)).alias("devices_count"))
    out = with_run_value(
        out, shown.agg(F.array_sort(F.collect_list("device_id")).alias("devices")), ["devices"], ()
    )
    named = sensors.agg(
        F.count(F.lit(1)).alias("sensors_count"),
        F.array_sort(F.collect_list("sensor")).alias("sensors"),
    )
    return with_run_value(out, named, ["sensors_count", "sensors"], ())


def arrival_preview(events: DataFrame, size: int = 10) -> DataFrame:
    return events.orderBy("n").limit(size).select(*_PREVIEW)


def event_time_preview(events: DataFrame, pool: int = 20, size: int = 10) -> DataFrame:
    """The first arrivals, shown in event-time order."""
    head = events.orderBy("n").limit(pool)
    return head.orderBy("event_time", "n").limit(size).select(*_PREVIEW)


def profile(events: DataFrame, missing_values: int = 0, columns=None) -> DataFrame:
    """The whole profile as one row; an empty stream has only ``total_events`` 0."""
    out = profile_summary(events)
    values = profile_values(events)
    out = with_run_value(out, values, values.columns, ())
    out = with_run_value(out, duplicate_count(events), ["duplicate_rows"], ())
    header = columns or ["Timestamp", "DeviceId", "Sensor", "Value"]
    return out.withColumns(
        {
            "missing_values": F.lit(missing_values).cast("long"),
            "columns": F.array(*[F.lit(c) for c in header]),
        }
    )
