"""Sources and sinks: everything is written, read back and compared with the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from latewin.operators.validate import canonicalize, deduplicate, with_event_ids
from latewin.operators.windows import window_aggregate
from latewin.plans import bindings as b
from latewin.plans.catalog import sql as s
from latewin.plans.catalog.basics import TEXT, text_rows
from latewin.plans.catalog.registry import query
from latewin.session import scratch_dir
from latewin.sources import files, messages

W = b.WINDOW
PLAIN = f"WITH {s.EV}, {s.pairs(W, 'ev')} {s.agg()}"


def _canonical(spark, d):
    return b.canonical(spark, d).select(
        F.col("event_time").alias("Time"),
        F.col("device_id").alias("DeviceId"),
        F.col("sensor").alias("Sensor"),
        F.col("value").alias("Value"),
    )


def _rows(spark, d):
    rows = window_aggregate(b.canonical(spark, d), W, round_to=6)
    return rows


@query(
    "canonical_store",
    f"""WITH {s.EV} SELECT DISTINCT event_time AS "Time", device_id AS "DeviceId",
    sensor AS "Sensor", value AS "Value" FROM ev""",
)
def canonical_store(spark, d):
    """Write with a replica, verify, and read the replica through the fallback."""
    main, copy = scratch_dir(spark, "canonical"), scratch_dir(spark, "replica")
    rows = deduplicate(_canonical(spark, d))
    if not files.write_canonical(rows, main, partitions=8, replica=copy):
        raise RuntimeError("replica was not written")
    files.assert_written(files.read_back_check(rows, main))
    return files.read_canonical(spark, main + "-absent", copy)


@query(
    "canonical_manifest",
    f"""WITH {s.EV}, doubled AS (SELECT * FROM ev UNION ALL SELECT * FROM ev WHERE i % 7 = 0),
    u AS (SELECT DISTINCT event_time, device_id, sensor, value FROM doubled)
    SELECT CAST(4 AS BIGINT) AS files, (SELECT count(*) FROM doubled) AS raw_rows,
    (SELECT count(*) FROM u) AS canonical_rows, (SELECT count(*) FROM u) AS unique_rows,
    (SELECT count(*) FROM doubled) - (SELECT count(*) FROM u) AS duplicate_rows,
    (SELECT count(*) FROM u) AS written_rows, CAST({W.window} AS BIGINT) AS window_seconds,
    CAST({W.slide} AS BIGINT) AS slide_seconds""",
)
def canonical_manifest(spark, d):
    """CSV files with repeated rows, canonicalised, stored and counted."""
    raw_path, path = scratch_dir(spark, "raw"), scratch_dir(spark, "canonical")
    rows = b.canonical(spark, d)
    doubled = rows.unionByName(rows.filter(F.col("i") % 7 == 0)).select(
        F.col("event_time").alias("Time"),
        F.col("device_id").alias("DeviceId"),
        F.col("sensor").alias("Sensor"),
        F.col("value").alias("Value"),
    )
    doubled.repartition(4).write.option("header", True).csv(raw_path)
    raw = files.read_raw_csv(spark, raw_path)
    canonical = deduplicate(canonicalize(raw))
    files.write_canonical(canonical, path)
    return files.manifest(raw, canonical, W.window, W.slide, spark.read.parquet(path))


@query(
    "arrival_csv",
    f"""WITH {TEXT} SELECT row_number() OVER (ORDER BY line) AS n,
    'ev-' || CAST(row_number() OVER (ORDER BY line) - 1 AS VARCHAR) AS event_id, event_time,
    device_id, sensor, value, raw_timestamp FROM parsed WHERE reject_reason IS NULL""",
)
def arrival_csv(spark, d):
    """Arrival order taken from the lines of a CSV written in order."""
    path = scratch_dir(spark, "arrivals")
    raw = text_rows(spark, d, ("Timestamp", "DeviceId", "Sensor", "Value")).orderBy("line")
    raw.drop("line").write.option("header", True).option("emptyValue", "").option(
        "ignoreLeadingWhiteSpace", False
    ).csv(path)
    return files.read_arrival_csv(spark, path, strict=False).select(
        "n", "event_id", "event_time", "device_id", "sensor", "value", "raw_timestamp"
    )


@query(
    "arrival_csv_breaks",
    f"""WITH {TEXT} SELECT row_number() OVER (ORDER BY line) AS n, event_time,
    device_id || CASE WHEN line % 3 = 0 THEN chr(10) || '"' || sensor || '",' || chr(10) || 'x'
      ELSE '' END AS device_id, sensor, value FROM parsed WHERE reject_reason IS NULL""",
)
def arrival_csv_breaks(spark, d):
    """The same with line breaks, quotes and commas inside every third device's cell."""
    path = scratch_dir(spark, "arrivals")
    raw = text_rows(spark, d, ("Timestamp", "DeviceId", "Sensor", "Value"))
    tail = F.concat(F.lit('\n"'), F.col("Sensor"), F.lit('",\nx'))
    longer = (F.col("line") % 3 == 0) & (F.trim("DeviceId") != "")
    raw = raw.withColumn(
        "DeviceId", F.when(longer, F.concat("DeviceId", tail)).otherwise(F.col("DeviceId"))
    ).orderBy("line")
    raw.drop("line").write.options(header=True, emptyValue="", **files.QUOTING).csv(path)
    return files.read_arrival_csv(spark, path, strict=False).select(
        "n", "event_time", "device_id", "sensor", "value"
    )


@query(
    "json_roundtrip",
    f"""WITH {s.arr()} SELECT n, 'ev-' || CAST(n - 1 AS VARCHAR) AS event_id, event_time,
    device_id, sensor, value, n - 1 AS arrival_sequence, 'heavy_ooo' AS scenario FROM arr""",
)
def json_roundtrip(spark, d):
    """Bus messages encoded and decoded again."""
    events = with_event_ids(b.arrivals(spark, d))
    return messages.decode_events(messages.encode_events(events, "heavy_ooo"))


@query("result_json_lines", PLAIN)
def result_json_lines(spark, d):
    path = scratch_dir(spark, "rows-json")
    files.write_json(_rows(spark, d), path)
    return files.read_json_rows(spark, path)


@query("sink_roundtrip", PLAIN)
def sink_roundtrip(spark, d):
    path = scratch_dir(spark, "rows-parquet")
    files.write_aggregate(_rows(spark, d), path)
    return spark.read.parquet(path)


@query("summary_csv", PLAIN)
def summary_csv(spark, d):
    path = scratch_dir(spark, "rows-csv")
    rows = _rows(spark, d)
    files.write_summary_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("final_row_sink", PLAIN)
def final_row_sink(spark, d):
    """Final rows appended in two batches, the second written twice."""
    path = scratch_dir(spark, "final-rows")
    rows = _rows(spark, d)
    early = F.pmod(F.floor(F.col("start") / W.slide), F.lit(2)) == 0
    files.write_final_rows(rows.filter(early), path, 0)
    for _ in range(2):
        files.write_final_rows(rows.filter(~early), path, 1)
    return files.read_final_rows(spark, path)
