"""Windows, validation, identifiers, disorder and profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from latewin.functions.times import canonical_time, lenient_time, to_epoch, to_event_timestamp
from latewin.functions.columns import with_canonical_names
from latewin.operators import disorder, profile, validate
from latewin.operators.lateness import arrival_lateness, inversions
from latewin.operators.windows import (
    KEYS,
    finish,
    merge_partials,
    native_window_aggregate,
    sliding_windows,
    window_aggregate,
    window_partials,
)
from latewin.plans import bindings as b
from latewin.plans.catalog import sql as s
from latewin.plans.catalog.registry import query

W, TUMBLE = b.WINDOW, b.TUMBLING


# -- windows -----------------------------------------------------------------


@query("sliding_window_agg", f"WITH {s.EV}, {s.pairs(W, 'ev')} {s.agg()}")
def sliding_window_agg(spark, d):
    return window_aggregate(b.canonical(spark, d), W, round_to=6)


@query("tumbling_window_agg", f"WITH {s.EV}, {s.pairs(TUMBLE, 'ev')} {s.agg(TUMBLE)}")
def tumbling_window_agg(spark, d):
    return window_aggregate(b.canonical(spark, d), TUMBLE, round_to=6)


@query("window_agg_rounded", f"WITH {s.arr()}, {s.pairs(W, 'arr')} {s.agg()}")
def window_agg_rounded(spark, d):
    """The arrival-independent truth, taken over disordered arrivals."""
    return window_aggregate(b.arrivals(spark, d), W, round_to=6)


@query("native_window_agg", f"WITH {s.EV}, {s.pairs(W, 'ev')} {s.agg()}")
def native_window_agg(spark, d):
    rows = native_window_aggregate(b.canonical(spark, d), W)
    return rows.withColumns({c: F.round(c, 6) for c in ("sum", "avg")})


@query(
    "window_assign",
    f"""WITH {s.EV}, {s.pairs(W, "ev")}
    SELECT i, event_time, start, start + {W.window} AS "end" FROM pairs""",
)
def window_assign(spark, d):
    return sliding_windows(b.canonical(spark, d), W).select("i", "event_time", "start", "end")


@query("pane_merge_agg", f"WITH {s.EV}, {s.pairs(W, 'ev')} {s.agg()}")
def pane_merge_agg(spark, d):
    """Partials of two interleaved halves of the stream, merged by key."""
    events = b.canonical(spark, d)
    halves = [window_partials(events.filter(F.col("i") % 2 == half), W) for half in (0, 1)]
    return finish(merge_partials(*halves), W, round_to=6)


@query(
    "batch_window_run",
    f"""WITH {s.EV}, {s.pairs(W, "ev")}, rows AS ({s.agg()})
    SELECT (SELECT count(*) FROM ev) AS input_events, count(*) AS result_rows,
    CAST(sum(count) AS BIGINT) AS pairs, min(start) AS first_start, max("end") AS last_end,
    CAST({W.window} AS BIGINT) AS window_seconds, CAST({W.slide} AS BIGINT) AS slide_seconds
    FROM rows""",
)
def batch_window_run(spark, d):
    """Run record of the batch window operator over the whole table."""
    events = b.canonical(spark, d)
    rows = window_aggregate(events, W)
    return rows.agg(
        F.count(F.lit(1)).alias("result_rows"),
        F.sum("count").alias("pairs"),
        F.min("start").alias("first_start"),
        F.max("end").alias("last_end"),
    ).select(
        events.agg(F.count(F.lit(1))).scalar().alias("input_events"),
        "*",
        F.lit(W.window).cast("long").alias("window_seconds"),
        F.lit(W.slide).cast("long").alias("slide_seconds"),
    )


# -- canonical store, identifiers ----------------------------------------------

DOUBLED = f"""{s.EV}, doubled AS (
  SELECT * FROM ev UNION ALL SELECT * FROM ev WHERE i % 7 = 0)"""


def _doubled(spark, d):
    events = b.canonical(spark, d)
    rows = events.unionByName(events.filter(F.col("i") % 7 == 0))
    return rows.select(
        F.col("event_time").alias("Time"),
        F.col("device_id").alias("DeviceId"),
        F.col("sensor").alias("Sensor"),
        F.col("value").alias("Value"),
    )


@query(
    "canonical_dedup",
    f"""WITH {DOUBLED} SELECT DISTINCT event_time AS "Time", device_id AS "DeviceId",
    sensor AS "Sensor", value AS "Value" FROM doubled""",
)
def canonical_dedup(spark, d):
    return validate.deduplicate(_doubled(spark, d))


@query(
    "uniqueness_check",
    f"""WITH {DOUBLED}, g AS (SELECT count(*) AS c FROM doubled
      GROUP BY event_time, device_id, sensor, value)
    SELECT CAST(sum(c) AS BIGINT) AS total_rows, count(*) AS unique_rows,
      CAST(sum(c) - count(*) AS BIGINT) AS duplicate_rows, sum(c) = count(*) AS is_unique FROM g""",
)
def uniqueness_check(spark, d):
    return validate.uniqueness(_doubled(spark, d))


@query(
    "duplicate_count",
    f"""WITH {DOUBLED}, g AS (SELECT count(*) AS c FROM doubled
      GROUP BY event_time, device_id, sensor, round(value, 6))
    SELECT CAST(sum(c - 1) AS BIGINT) AS duplicate_rows FROM g""",
)
def duplicate_count(spark, d):
    rows = _doubled(spark, d).toDF("event_time", "device_id", "sensor", "value")
    return validate.duplicate_count(rows)


@query(
    "deterministic_slice",
    f"""WITH {s.EV} SELECT event_time AS "Time", device_id AS "DeviceId", sensor AS "Sensor",
    value AS "Value" FROM ev ORDER BY event_time, device_id, sensor, value LIMIT 1000""",
)
def deterministic_slice(spark, d):
    rows = b.canonical(spark, d).select(
        F.col("event_time").alias("Time"),
        F.col("device_id").alias("DeviceId"),
        F.col("sensor").alias("Sensor"),
        F.col("value").alias("Value"),
    )
    return validate.slice_first(rows, 1000)


@query(
    "event_order_readback",
    f"""WITH {s.EV} SELECT CASE WHEN i % 11 = 0 THEN 0 ELSE event_time END AS "Time",
    CASE WHEN i % 13 = 0 THEN 'None' ELSE device_id END AS "DeviceId", sensor AS "Sensor",
    CASE WHEN i % 17 = 0 THEN 0.0 ELSE value END AS "Value" FROM ev""",
)
def event_order_readback(spark, d):
    i = F.col("i")
    rows = b.canonical(spark, d).select(
        F.when(i % 11 != 0, F.col("event_time")).alias("Time"),
        F.when(i % 13 != 0, F.col("device_id")).alias("DeviceId"),
        F.col("sensor").alias("Sensor"),
        F.when(i % 17 != 0, F.col("value")).alias("Value"),
    )
    return validate.in_event_order(rows)


@query(
    "event_ids",
    f"""WITH {s.arr()} SELECT i, n, n - 1 AS arrival_sequence,
    'ev-' || CAST(n - 1 AS VARCHAR) AS event_id,
    CAST(event_time AS VARCHAR) || '-' || device_id || '-' || sensor || '-'
      || CAST(n - 1 AS VARCHAR) AS message_id FROM arr""",
)
def event_ids(spark, d):
    return validate.with_event_ids(b.arrivals(spark, d)).select(
        "i", "n", "arrival_sequence", "event_id", "message_id"
    )


@query(
    "epoch_roundtrip",
    f"""WITH {s.EV} SELECT i, event_time, CAST(epoch(make_timestamp(event_time * 1000000))
      AS BIGINT) AS back FROM ev""",
)
def epoch_roundtrip(spark, d):
    ts = to_event_timestamp(F.col("event_time"))
    return b.canonical(spark, d).select("i", "event_time", to_epoch(ts).alias("back"))


# -- text input -------------------------------------------------------------------

# One text column per field, with cells broken by formula on the row number.
TEXT = """txt AS (
  SELECT event_id AS line,
    CASE WHEN event_id % 41 = 0 THEN '' WHEN event_id % 43 = 0 THEN 'yesterday'
         WHEN event_id % 5 = 1 THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR)
         WHEN event_id % 5 = 2 THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) || '.7'
         WHEN event_id % 5 = 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.5'
         WHEN event_id % 5 = 4 THEN strftime(ts, '%Y-%m-%d')
         ELSE ' ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' END AS t,
    CASE WHEN event_id % 37 = 0 THEN ' ' ELSE 'D' || CAST(user_id % 3 AS VARCHAR) END AS dv,
    event_type AS sn,
    CASE WHEN event_id % 53 = 0 THEN 'NotANumber'
         ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS vl
  FROM events),
parsed AS (
  SELECT line, trim(t) AS raw_timestamp, trim(dv) AS device_id, sn AS sensor,
    CASE WHEN vl = 'NotANumber' THEN NULL ELSE CAST(vl AS DOUBLE) END AS value,
    CASE WHEN t IN ('', 'yesterday') THEN NULL ELSE CAST(
      CASE WHEN line % 5 IN (1, 2) THEN floor(epoch(e.ts))
           WHEN line % 5 = 4 THEN epoch(date_trunc('day', e.ts))
           ELSE floor(epoch(e.ts)) END AS BIGINT) END AS event_time,
    CASE WHEN t = '' OR trim(dv) = '' THEN 'missing'
         WHEN vl = 'NotANumber' THEN 'bad_value'
         WHEN t = 'yesterday' THEN 'bad_time' END AS reject_reason
  FROM txt JOIN events e ON e.event_id = txt.line)"""


def text_rows(spark, d, columns=(" Timestamp", "DEVICE", "Sensor_Type", "Reading")):
    """The events as text cells under alias headers, some of them broken."""
    i, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    seconds = F.floor(F.unix_micros(ts) / 1_000_000).cast("string")
    t = (
        F.when(i % 41 == 0, "")
        .when(i % 43 == 0, "yesterday")
        .when(i % 5 == 1, seconds)
        .when(i % 5 == 2, F.concat(seconds, F.lit(".7")))
        .when(i % 5 == 3, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".5")))
        .when(i % 5 == 4, F.date_format(ts, "yyyy-MM-dd"))
        .otherwise(F.concat(F.lit(" "), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" ")))
    )
    device = F.when(i % 37 == 0, " ").otherwise(
        F.concat(F.lit("D"), (F.col("user_id") % 3).cast("string"))
    )
    value = F.when(i % 53 == 0, "NotANumber").otherwise(
        F.round(F.col("value") * 100).cast("long").cast("string")
    )
    return b.table(spark, d, "events").select(
        i.alias("line"),
        t.alias(columns[0]),
        device.alias(columns[1]),
        F.col("event_type").alias(columns[2]),
        value.alias(columns[3]),
    )


@query(
    "parse_validate",
    f"""WITH {TEXT} SELECT line, event_time, device_id, sensor, value, raw_timestamp,
    reject_reason FROM parsed""",
)
def parse_validate(spark, d):
    return validate.validate_rows(text_rows(spark, d), carry=["line"]).drop("raw_value")


@query(
    "parse_counts",
    f"""WITH {TEXT} SELECT count(*) FILTER (reject_reason IS NULL) AS valid_rows,
    CAST(0 AS BIGINT) AS blank_rows,
    count(*) FILTER (reject_reason = 'missing') AS missing_values,
    count(*) FILTER (reject_reason = 'bad_value') AS bad_values,
    count(*) FILTER (reject_reason = 'bad_time') AS bad_times FROM parsed""",
)
def parse_counts(spark, d):
    return validate.validation_counts(
        validate.validate_rows(text_rows(spark, d), carry=["line"])
    )


@query(
    "quarantine_rows",
    f"""WITH {TEXT} SELECT line, reject_reason FROM parsed WHERE reject_reason IS NOT NULL""",
)
def quarantine_rows(spark, d):
    checked = validate.validate_rows(text_rows(spark, d), carry=["line"])
    return validate.quarantine(checked).select("line", "reject_reason")


@query("lenient_timestamp", f"WITH {TEXT} SELECT line, event_time FROM parsed")
def lenient_timestamp(spark, d):
    rows = text_rows(spark, d)
    return rows.select("line", lenient_time(F.col(f"`{rows.columns[1]}`")).alias("event_time"))


@query(
    "canonical_timestamp",
    f"""WITH {TEXT} SELECT line, CASE WHEN t IN ('', 'yesterday') OR line % 5 = 2 THEN NULL
    ELSE event_time END AS "Time" FROM txt JOIN parsed USING (line)""",
)
def canonical_timestamp(spark, d):
    """The strict cast: whole numbers and timestamps only."""
    rows = text_rows(spark, d)
    return rows.select("line", canonical_time(F.col(f"`{rows.columns[1]}`")).alias("Time"))


@query(
    "alias_mapping",
    f"""WITH {TEXT} SELECT t AS event_time, dv AS device_id, sn AS sensor, vl AS value
    FROM txt""",
)
def alias_mapping(spark, d):
    return with_canonical_names(text_rows(spark, d).drop("line"))


@query(
    "null_quarantine",
    f"""WITH {TEXT} SELECT line FROM txt WHERE t IN ('', 'yesterday') OR line % 5 = 2
      OR vl = 'NotANumber'""",
)
def null_quarantine(spark, d):
    rows = text_rows(spark, d)
    typed = rows.select(
        "line",
        canonical_time(F.col(f"`{rows.columns[1]}`")).alias("Time"),
        F.col(f"`{rows.columns[2]}`").alias("DeviceId"),
        F.col(f"`{rows.columns[3]}`").alias("Sensor"),
        F.col(f"`{rows.columns[4]}`").try_cast("double").alias("Value"),
    )
    return validate.split_nulls(typed)[1].select("line")


# -- disorder -----------------------------------------------------------------------


def _scenario_query(short: str, scenario: str):
    @query(f"inject_disorder_{short}", f"WITH {s.arr(scenario)} SELECT i, n FROM arr")
    def run(spark, d):
        return b.arrivals(spark, d, scenario).select("i", "n")

    return run


for _short, _scenario in (
    ("baseline", "baseline"),
    ("mild", "mild_ooo"),
    ("moderate", "moderate_ooo"),
    ("heavy", "heavy_ooo"),
    ("burst", "burst_ooo"),
):
    _scenario_query(_short, _scenario)


@query("inject_disorder_buffer")
def inject_disorder_buffer(spark, d):
    return disorder.buffer_disorder(b.canonical(spark, d), 0.4).select(
        "i", "n", "disorder_release"
    )


MIXED = f"""{s.EV}, mixed AS (SELECT i, (i * 1103515245 + 12345) % 2147483648 AS r FROM ev)"""


@query(
    "local_shuffle",
    f"WITH {MIXED} SELECT i, row_number() OVER (ORDER BY i // 30, r, i) AS n FROM mixed",
)
def local_shuffle(spark, d):
    return disorder.local_shuffle(b.canonical(spark, d), seed=0).select("i", "n")


@query(
    "full_shuffle", f"WITH {MIXED} SELECT i, row_number() OVER (ORDER BY r, i) AS n FROM mixed"
)
def full_shuffle(spark, d):
    return disorder.full_shuffle(b.canonical(spark, d), seed=0).select("i", "n")


def _swapped_sql() -> str:
    """One step for every round of the permutation; the keys follow from the number of rows."""

    def number(r: int, name: str) -> str:
        return f"('0x' || md5('0|{name}|{r}')[1:12])::BIGINT"

    size, steps, prime = "(SELECT count(*) FROM ev)", ["r0 AS (SELECT i, i AS x FROM ev)"], disorder.SWAP_PRIME
    for r in range(disorder.SWAP_ROUNDS):
        steps.append(f"""o{r} AS (SELECT i, x, (({number(r, "pivot")} % {size} - x) % {size} + {size}) % {size} AS y
          FROM r{r}), h{r} AS (SELECT *, ((greatest(x, y) % {prime}) * ({number(r, "times")} % ({prime} - 2) + 1)
            + {number(r, "plus")} % {prime}) % {prime} AS h FROM o{r}),
        r{r + 1} AS (SELECT i, CASE WHEN (((h * h) % {prime}) // 4096) % 2 = 1 THEN y ELSE x END AS x FROM h{r})""")
    return f"WITH {s.EV}, {', '.join(steps)} SELECT i, x + 1 AS n FROM r{disorder.SWAP_ROUNDS}"


@query("keyed_shuffle", _swapped_sql())
def keyed_shuffle(spark, d):
    events = b.canonical(spark, d)
    return disorder.keyed_shuffle(events, events.count(), seed=0).select("i", "n")


@query(
    "scenario_disorder",
    f"""WITH {s.scenarios_arr()}, {s.obs("scenario")}
    SELECT scenario, count(*) AS events, count(*) FILTER (out_of_order) AS ooo_events,
    max(lateness) AS max_lateness_seconds FROM obs GROUP BY scenario""",
)
def scenario_disorder(spark, d):
    """Disorder each catalogue profile produces."""
    obs = b.observed_scenarios(spark, d)
    return obs.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum(F.col("out_of_order").cast("long")).alias("ooo_events"),
        F.max("lateness").alias("max_lateness_seconds"),
    )


# -- profile ---------------------------------------------------------------------------


@query(
    "arrival_lateness",
    f"""WITH {s.arr()}, {s.obs()} SELECT n, event_time, max_before, max_event_time, lateness,
    out_of_order FROM obs""",
)
def arrival_lateness_rows(spark, d):
    return arrival_lateness(b.arrivals(spark, d)).select(
        "n", "event_time", "max_before", "max_event_time", "lateness", "out_of_order"
    )


@query(
    "profile_summary",
    f"""WITH {s.arr()}, {s.obs()} SELECT count(*) AS total_events,
    min(event_time) AS min_timestamp, max(event_time) AS max_timestamp,
    max(event_time) - min(event_time) AS timespan_seconds,
    count(*) FILTER (out_of_order) AS ooo_events,
    round(count(*) FILTER (out_of_order) / count(*) * 100, 2) AS ooo_percentage,
    max(lateness) AS max_lateness_seconds,
    round(CAST(sum(lateness) AS DOUBLE) / count(*), 3) AS avg_lateness_seconds,
    count(*) FILTER (inversion) AS inversions FROM obs""",
)
def profile_summary(spark, d):
    return profile.profile_summary(b.observed(spark, d))


@query(
    "profile_empty",
    f"""WITH {s.EV} SELECT count(*) AS total_events, max(event_time) AS min_timestamp,
    max(event_time) AS max_timestamp, max(event_time) AS timespan_seconds, 0::BIGINT AS ooo_events,
    max(value) AS ooo_percentage, max(event_time) AS max_lateness_seconds,
    max(value) AS avg_lateness_seconds, 0::BIGINT AS inversions FROM ev WHERE event_time < 0""",
)
def profile_empty(spark, d):
    """The profile of arrivals before 1970, of which there are none."""
    return profile.profile_summary(b.arrivals(spark, d).filter("event_time < 0"))


@query(
    "profile_values",
    f"""WITH {s.EV}, dv AS (SELECT DISTINCT device_id FROM ev),
    sn AS (SELECT DISTINCT sensor FROM ev)
    SELECT (SELECT count(*) FROM dv) AS devices_count,
    (SELECT string_agg(device_id, ',' ORDER BY device_id) FROM
      (SELECT device_id FROM dv ORDER BY device_id LIMIT 20)) AS devices,
    (SELECT count(*) FROM sn) AS sensors_count,
    (SELECT string_agg(sensor, ',' ORDER BY sensor) FROM sn) AS sensors""",
)
def profile_values(spark, d):
    rows = profile.profile_values(b.canonical(spark, d))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("devices", "sensors")})


@query(
    "profile_missing_duplicates",
    f"""WITH {TEXT}, good AS (SELECT * FROM parsed WHERE reject_reason IS NULL),
    g AS (SELECT count(*) AS c FROM good
      GROUP BY event_time, device_id, sensor, round(value, 6))
    SELECT (SELECT count(*) FROM parsed WHERE reject_reason = 'missing') AS missing_values,
    (SELECT count(*) FROM good) AS total_events,
    (SELECT CAST(sum(c - 1) AS BIGINT) FROM g) AS duplicate_rows,
    ' Timestamp,DEVICE,Sensor_Type,Reading' AS columns""",
)
def profile_missing_duplicates(spark, d):
    raw = text_rows(spark, d)
    checked = validate.validate_rows(raw, carry=["line"])
    counts = validate.validation_counts(checked)
    copies = validate.duplicate_count(validate.good_rows(checked))
    return counts.select(
        "missing_values",
        F.col("valid_rows").alias("total_events"),
        copies.scalar().alias("duplicate_rows"),
        F.lit(",".join(raw.columns[1:])).alias("columns"),
    )


@query(
    "inversions",
    f"""WITH {s.arr()}, {s.obs()} SELECT n, event_time, previous_time, inversion FROM obs""",
)
def inversion_rows(spark, d):
    return inversions(b.arrivals(spark, d)).select(
        "n", "event_time", "previous_time", "inversion"
    )


@query(
    "arrival_preview",
    f"""WITH {s.arr()} SELECT n, event_time, device_id, sensor, value FROM arr
    ORDER BY n LIMIT 10""",
)
def arrival_preview(spark, d):
    return profile.arrival_preview(b.arrivals(spark, d))


@query(
    "event_time_preview",
    f"""WITH {s.arr()}, head AS (SELECT * FROM arr ORDER BY n LIMIT 20)
    SELECT n, event_time, device_id, sensor, value FROM head ORDER BY event_time, n LIMIT 10""",
)
def event_time_preview(spark, d):
    return profile.event_time_preview(b.arrivals(spark, d))
