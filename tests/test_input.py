"""Reading, validating, profiling and storing."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from latewin.functions.columns import resolve_columns
from latewin.functions.times import lenient_time
from latewin.operators import disorder, profile, validate
from latewin.operators.ordering import with_arrival_index
from latewin.operators.windows import sliding_windows, window_aggregate
from latewin.schema import LatenessConfig, WindowConfig
from latewin.sources import files

G5 = """Timestamp,DeviceId,Sensor,Value
2024-01-01 10:01:01,D1,Temp,25.1
2024-01-01 10:01:05,D1,Temp,25.8
2024-01-01 10:01:03,D1,Temp,25.3
2024-01-01 10:01:02,D1,Temp,25.2
2024-01-01 10:01:04,D1,Temp,25.5
"""


def test_small_stream_profile_and_windows(spark):
    events = files.read_arrival_text(spark, G5)
    p = profile.profile(events).first()
    assert (p.total_events, p.ooo_events, p.ooo_percentage, p.max_lateness_seconds) == (5, 3, 60.0, 3)
    assert (p.devices_count, p.sensors_count, p.inversions, p.timespan_seconds) == (1, 1, 2, 4)
    assert (p.avg_lateness_seconds, p.devices, p.duplicate_rows) == (1.2, ["D1"], 0)
    rows = window_aggregate(events, WindowConfig(), round_to=6).orderBy("start").collect()
    assert [r.start for r in rows] == list(range(1704103210, 1704103261, 10))
    assert {(r["count"], r["sum"], r["avg"], r["min"], r["max"]) for r in rows} == {
        (5, 126.9, 25.38, 25.1, 25.8)
    }


def test_empty_profile(spark):
    events = files.read_arrival_text(spark, G5).filter("n < 0")
    p = profile.profile(events).first()
    assert p.total_events == 0 and p.min_timestamp is None and p.ooo_events == 0


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("", "empty"),
        (" ,,\n1,2,3", "empty header"),
        ("A,B,C\n1,2,3", "Missing required timestamp"),
        ("Time,B,C\n1,2,3", "Missing required device"),
        (G5 + "2024-01-01,D1,Temp,NotANumber\n", "Line 7: Invalid numeric value 'NotANumber'"),
        (G5 + "\nsoon,D1,Temp,1\n", "Line 8: Unable to parse timestamp 'soon'"),
        ("Time,Device,Sensor,Value\n,D,S,1\n", "no valid data rows"),
    ],
)
def test_bad_text(spark, text, message):
    with pytest.raises(ValueError, match=message):
        files.read_arrival_text(spark, text)


def test_text_sources_are_alike(spark):
    want, *others = (
        files.read_arrival_text(spark, source).orderBy("n").collect()
        for source in (G5, G5.encode(), io.StringIO(G5))
    )
    assert [r.n for r in want] == [1, 2, 3, 4, 5]
    assert all(rows == want for rows in others)


def test_csv_files_keep_line_order_across_splits(spark, tmp_path):
    rows = [f"{1704103200 + (i * 7919) % 5000},D{i % 3},S,{i}" for i in range(3000)]
    for part in (0, 1):
        body = rows[part * 1500 : (part + 1) * 1500]
        body[10:10] = ["", ",,,", "1704103200,,S,1", "1704103200,D1"]
        (tmp_path / f"part{part}.csv").write_text(
            "Time,Device,Sensor,Reading\n" + "\n".join(body) + "\n"
        )
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        events = files.read_arrival_csv(spark, str(tmp_path))
        got = [(r.n, r.value) for r in events.orderBy("n").collect()]
        assert got == [(i + 1, float(i)) for i in range(3000)]
        counts = validate.validation_counts(files.checked_csv_lines(spark, str(tmp_path))).first()
        assert (counts.valid_rows, counts.missing_values) == (3000, 4)
        bad = tmp_path / "part1.csv"
        bad.write_text(bad.read_text() + "1704103200,D1,S,oops\n")
        with pytest.raises(ValueError, match="Line 1506: Invalid numeric value 'oops'"):
            files.read_arrival_csv(spark, str(tmp_path))
        assert files.read_arrival_csv(spark, str(tmp_path), strict=False).count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_no_csv(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read_raw_csv(spark, str(tmp_path / "absent"))
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        files.read_raw_csv(spark, str(tmp_path))


def test_aliases_by_preference():
    got = resolve_columns([" TIME ", "event_time", "Device", "device_id", "sensor_type", "val"])
    assert got == {
        "event_time": " TIME ", "device_id": "device_id", "sensor": "sensor_type", "value": "val",
    }


def test_lenient_times(spark):
    cases = {
        "1704103261": 1704103261,
        "1704103261.7": 1704103261,
        "-1.5": -1,
        "1e3": 1000,
        "2024-01-01 10:01:01": 1704103261,
        "2024-01-01T10:01:01": 1704103261,
        "2024-01-01T10:01:01.5": 1704103261,
        "2024-01-01T10:01:01+01:00": 1704099661,
        "2024-01-01": 1704067200,
        "2024-13-01": None,
        "noon": None,
        "nan": None,
        "": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = {r.t: r.s for r in df.select("t", lenient_time(F.col("t")).alias("s")).collect()}
    assert got == cases


def test_window_starts_of_negative_times(spark):
    df = spark.createDataFrame([(-5,)], "event_time long")
    got = sorted(r.start for r in sliding_windows(df).collect())
    assert got == [-60, -50, -40, -30, -20, -10]


@pytest.mark.parametrize("bad", [(0, 10), (60, 0), (60, 7)])
def test_window_settings(bad):
    with pytest.raises(ValueError):
        WindowConfig(*bad)


@pytest.mark.parametrize(
    "bad",
    [
        {"history": 0}, {"minimum": 30}, {"initial": 1}, {"percentile": 1.0},
        {"percentile": 0.005}, {"min_observations": 0}, {"interval": 0},
    ],
)
def test_lateness_settings(bad):
    with pytest.raises(ValueError):
        LatenessConfig(**bad)


def test_arrival_index_is_dense_over_small_blocks(spark):
    df = spark.range(0, 1000).select((F.col("id") * 3 % 1009).alias("k"), "id")
    got = with_arrival_index(df, ["k", "id"], F.floor(F.col("k") / 17)).orderBy("k", "id")
    assert [r.n for r in got.collect()] == list(range(1, 1001))


def test_buffer_disorder(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "i")
    calm = disorder.buffer_disorder(df, 0.0, block_rows=200).collect()
    assert all(r.n == r.i + 1 and not r.disorder_release for r in calm)
    wild = disorder.buffer_disorder(df, 0.5, block_rows=200)
    rows = wild.collect()
    assert sorted(r.n for r in rows) == list(range(1, 501))
    assert sum(r.disorder_release for r in rows) > 50
    assert max(r.i + 1 - r.n for r in rows) < 20
    assert sorted(rows) == sorted(disorder.buffer_disorder(df, 0.5, block_rows=200).collect())


def test_unknown_scenario():
    with pytest.raises(ValueError, match="unknown scenario"):
        disorder.scenario("storm")


def test_hash_does_not_overflow(spark):
    big = 10**15 + 7
    df = spark.createDataFrame([(big,)], "i long")
    got = df.select(disorder.mix(F.col("i")).alias("r")).first().r
    assert got == (big * 1103515245 + 12345) % 2**31


def test_canonical_store_and_manifest(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.csv").write_text("Time,DeviceId,Sensor,Value\n1,D,S,1\n1,D,S,1\n2,D,S,x\n")
    rows = validate.canonicalize(files.read_raw_csv(spark, str(raw)))
    good, nulls = validate.split_nulls(rows)
    assert (good.count(), nulls.count()) == (2, 1)
    unique = validate.deduplicate(good)
    path = str(tmp_path / "store")
    assert files.write_canonical(unique, path) is None
    files.assert_written(files.read_back_check(unique, path))
    with pytest.raises(RuntimeError, match="read-back"):
        files.assert_written(files.read_back_check(good, path))
    m = files.manifest(
        files.read_raw_csv(spark, str(raw)), unique, 60, 10, spark.read.parquet(path)
    ).first()
    assert (m.files, m.raw_rows, m.unique_rows, m.duplicate_rows, m.written_rows) == (1, 3, 1, 2, 1)


def test_json_layouts(spark, tmp_path):
    row = '{"start":0,"end":60,"DeviceId":"D","Sensor":"S","count":1,"sum":2.0,"avg":2.0,"min":2.0,"max":2.0}'
    (tmp_path / "array.json").write_text(f"[\n{row},\n{row}]")
    (tmp_path / "rows.json").write_text('{"rows": [' + row + "]}")
    array = files.read_json_rows(spark, str(tmp_path / "array.json"), "array").collect()
    nested = files.read_json_rows(spark, str(tmp_path / "rows.json"), "rows").collect()
    assert len(array) == 2 and array[0] == nested[0] and nested[0]["sum"] == 2.0


HEAD = "Timestamp,DeviceId,Sensor,Value\n"


def test_files_whose_headers_differ_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "1,d,s,2\n")
    (tmp_path / "b.csv").write_text("Value,Sensor,DeviceId,Timestamp\n5.0,s,d,7\n")
    with pytest.raises(ValueError, match="b.csv: its header"):
        files.read_arrival_csv(spark, str(tmp_path))
    (tmp_path / "b.csv").write_text('Timestamp,DeviceId,Sensor,"Va\nlue"\n7,s,d,5.0\n')
    with pytest.raises(ValueError, match="b.csv, line 1: a quoted cell goes over"):
        files.read_arrival_csv(spark, str(tmp_path))


def several_lines(rows, seed):
    """CSV text by Python's own writer, and its records."""
    rng = random.Random(seed)
    bits = ["d", " ", ",", '"', "\n", "\n\n", '""', '",', ',"', "e"]
    made = [
        (str(k), "D" + "".join(rng.choices(bits, k=rng.randrange(6))) + "x", f"s{k % 3}", f"{k}.5")
        for k in range(1, rows + 1)
    ]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([HEAD.strip().split(","), *made])
    return out.getvalue(), made


def test_quoted_line_breaks(spark, tmp_path, monkeypatch):
    """Records over several lines, cut in many splits and blocks, are as Python's reader has them."""
    monkeypatch.setattr(files, "BLOCK_ROWS", 64)
    want = []
    for name in ("a", "b"):
        text, made = several_lines(500, name)
        (tmp_path / f"{name}.csv").write_text(text)
        assert list(csv.reader(io.StringIO(text)))[1:] == [list(r) for r in made]
        want += made
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = files.read_arrival_csv(spark, str(tmp_path)).orderBy("n").collect()
        lines = files.checked_csv_lines(spark, str(tmp_path)).orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.n for r in rows] == list(range(1, 1001))
    got = [(str(r.event_time), r.device_id, r.sensor, str(r.value)) for r in rows]
    assert got == want
    assert len(lines) == 1000 and lines[0].line == 2
    text, made = several_lines(60, "c")
    rows = files.read_arrival_text(spark, text).orderBy("n").collect()
    assert [(str(r.event_time), r.device_id, r.sensor, str(r.value)) for r in rows] == made


@pytest.mark.parametrize(
    ("body", "line"),
    [
        ('1,d,s,2\n2,5" pipe,s,3\n3,d,s,4\n', 3),
        ('1,5" pipe,s,3\n3,7" pipe,s,4\n', 2),
        ('1,"d\nd"x,s,3\n', 3),
        ('1,"d\nd",s,3\n2,"e,s,3\n3,f,s,4\n', 4),
    ],
)
def test_stray_quotes_raise_with_their_line(spark, tmp_path, body, line):
    (tmp_path / "a.csv").write_text(HEAD + body)
    with pytest.raises(ValueError, match=f"line {line}: a quote neither opens nor closes"):
        files.read_arrival_csv(spark, str(tmp_path))
    with pytest.raises(ValueError, match=f"line {line}: a quote neither opens nor closes"):
        files.read_arrival_text(spark, HEAD + body)


def test_bad_cell_after_a_line_break_names_its_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + '1,"d\nd",s,2\n2,"e ""1"", f",s,3\n3,d,s,x\n')
    with pytest.raises(ValueError, match="5"):
        files.read_arrival_csv(spark, str(tmp_path))
    rows = files.read_arrival_csv(spark, str(tmp_path), strict=False).orderBy("n").collect()
    assert [(r.n, r.device_id) for r in rows] == [(1, "d\nd"), (2, 'e "1", f')]


def test_quoted_header(spark):
    text = '"Timestamp","DeviceId","Sensor","Value"\n7,"d,1",s,2.5\n'
    row = files.read_arrival_text(spark, text).first()
    assert (row.event_time, row.device_id, row.value) == (7, "d,1", 2.5)
