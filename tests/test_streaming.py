"""Streaming runs against batch results."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latewin import GuardConfig, LatenessConfig, WindowConfig
from latewin.operators import compare as cmp
from latewin.operators.windows import KEYS, pane_of, window_aggregate
from latewin.plans import bindings as b
from latewin.sources import messages
from latewin.sources.replay import read_replay, write_replay
from latewin.streaming.adaptive import AdaptiveStream, run_adaptive
from latewin.streaming.progress import ProgressLog
from latewin.streaming.windows import (
    _merge_panes,
    _panes_of_task,
    run_full_retention,
    run_keyed_state,
)


@pytest.fixture(scope="module")
def events(spark, sf):
    return b.arrivals(spark, sf).select("n", "event_time", "device_id", "sensor", "value").cache()


def replay(spark, events, tmp_path, rows=300):
    path = str(tmp_path / "replay")
    write_replay(events, path, rows)
    return read_replay(spark, path, events.schema)


def test_replay_keeps_block_order(spark, events, tmp_path):
    seen = []
    query = (
        replay(spark, events, tmp_path)
        .writeStream.foreachBatch(
            lambda df, _: seen.append(df.agg(F.min("n"), F.max("n")).first()[:])
        )
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert seen == [(1, 300), (301, 600), (601, 900), (901, 1000)]


def test_full_retention(spark, events, tmp_path):
    log = ProgressLog()
    spark.streams.addListener(log)
    got = run_full_retention(replay(spark, events, tmp_path), b.WINDOW)
    cmp.assert_exact(cmp.verdict(window_aggregate(events, b.WINDOW), got))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(log)
    assert sum(r["received"] for r in log.reports) == events.count()


def test_full_retention_keeps_panes(spark, events, tmp_path, monkeypatch):
    monkeypatch.setattr(
        "latewin.streaming.windows.scratch_dir", lambda _, label: str(tmp_path / label)
    )
    run_full_retention(replay(spark, events, tmp_path), b.WINDOW)
    held = spark.read.format("statestore").load(str(tmp_path / "full-checkpoint"))
    pane = pane_of(F.col("event_time"), b.WINDOW.slide)
    assert held.count() == events.select(pane, *KEYS).distinct().count()
    # A batch writes a row for each pane it touches, not for each covering window.
    batch = F.floor((F.col("n") - 1) / 300).alias("batch_id")
    touched = events.select(batch, pane, *KEYS).distinct()
    assert spark.read.parquet(str(tmp_path / "full-rows")).count() == touched.count()


def test_progress_keeps_all_reports(spark, events, tmp_path):
    log = ProgressLog(keep=2, spark=spark, path=str(tmp_path / "progress"))
    assert log.table().count() == 0
    spark.streams.addListener(log)
    run_full_retention(replay(spark, events, tmp_path), b.WINDOW)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(log)
    rows = log.table().collect()
    assert len(log.reports) == 2 < len(rows)
    assert sum(r.received for r in rows) == events.count()


def test_keyed_state(spark, events, tmp_path):
    got = run_keyed_state(replay(spark, events, tmp_path), 5 * 86400, b.WINDOW)
    cmp.assert_exact(cmp.verdict(window_aggregate(events, b.WINDOW), got))


def test_keyed_state_closes_and_forgets(spark, tmp_path, monkeypatch):
    """Windows are emitted once as the watermark passes them, panes and series go from the
    state, and only readings all of whose windows have ended are lost."""
    monkeypatch.setattr(
        "latewin.streaming.windows.scratch_dir", lambda _, label: str(tmp_path / label)
    )
    schema = "n long, event_time long, device_id string, sensor string, value double"
    # Two series to t=999; only the first goes on, to t=2999. Then a reading for t=100, whose
    # windows have ended, and one for t=2945, with windows on both sides of the watermark.
    rows = [(t, d, 1.0) for t in range(1000) for d in "ab"]
    rows += [(t, "a", 1.0) for t in range(1000, 3000)]
    rows += [(2999, "a", 1.0)] * 1000 + [(100, "b", 9.0), (2945, "a", 9.0)]
    events = spark.createDataFrame(
        [(n, t, d, "s0", v) for n, (t, d, v) in enumerate(rows, 1)], schema
    )
    got = run_keyed_state(replay(spark, events, tmp_path, 1000), 20, WindowConfig(60, 10))
    want = window_aggregate(events.filter("value < 9"), WindowConfig(60, 10))
    got, want = (
        {(r["DeviceId"], r["start"]): (r["count"], r["sum"], r["max"]) for r in x.collect()}
        for x in (got, want)
    )
    assert got.keys() == want.keys()
    # The watermark is at 2970 when the last readings come: 2945 counts in later ends only.
    late = {key: row for key, row in got.items() if row != want[key]}
    assert late == {
        ("a", start): (want["a", start][0] + 1, want["a", start][1] + 9, 9.0)
        for start in (2920, 2930, 2940)
    }
    held = (
        spark.read.format("statestore")
        .option("stateVarName", "series")
        .load(str(tmp_path / "keyed-checkpoint"))
        .select("key.device_id", F.explode("value.start"))
        .collect()
    )
    assert {tuple(r) for r in held} == {("a", start) for start in range(2920, 3000, 10)}


def test_tasks_combine_readings_to_panes(monkeypatch):
    monkeypatch.setattr("latewin.streaming.windows.HELD_PANES", 10)
    batches = [
        pa.record_batch(
            {
                "device_id": ["a"] * 50,
                "sensor": ["s"] * 50,
                "start": [10 * ((b * 50 + i) // 20) for i in range(50)],
                "value": [float(i) for i in range(50)],
            }
        )
        for b in range(20)
    ]
    out = pa.Table.from_batches(_panes_of_task(iter(batches)))
    assert 50 <= out.num_rows < 80
    whole = _merge_panes(out)
    assert whole.num_rows == 50 and set(whole["count"].to_pylist()) == {20}
    assert sum(whole["sum"].to_pylist()) == 20 * sum(range(50))


def late_events(spark):
    """Two readings at t=100 around two thousand seconds of others."""
    rows = [(100, 1.0)] + [(t, 0.5) for t in range(200, 2000, 3)] + [(100, 6.0)]
    return spark.createDataFrame(
        [(n, t, "dev0", "s0", v) for n, (t, v) in enumerate(rows, 1)],
        "n long, event_time long, device_id string, sensor string, value double",
    )


def test_late_event_is_reconciled(spark, tmp_path):
    events = late_events(spark)
    controller = AdaptiveStream(spark, str(tmp_path / "state"))
    got = run_adaptive(replay(spark, events, tmp_path), controller)
    cmp.assert_exact(cmp.verdict(window_aggregate(events), got))
    early = got.filter("start <= 100").collect()
    assert len(early) == 6 and all((r["count"], r["sum"]) == (2, 7.0) for r in early)
    assert controller.control(controller.last_version()).reconciled_events == 6


def test_release_loses_only_what_the_guard_does_not_cover(spark, tmp_path):
    events = late_events(spark)
    source = replay(spark, events, tmp_path)
    controller = AdaptiveStream(spark, str(tmp_path / "a"), guard=GuardConfig("fixed", 5))
    got = run_adaptive(source, controller)
    end = controller.closing
    assert end.frozen > 0 and end.late_after_eviction == 6
    assert all(r["count"] == 1 for r in got.filter("start <= 100").collect())
    assert got.count() == window_aggregate(events).count()
    report = controller.report().orderBy("version").collect()
    assert [r.events for r in report] == [300, 600, 602]
    assert report[-1].frozen <= end.frozen

    strict = AdaptiveStream(
        spark, str(tmp_path / "b"), guard=GuardConfig("fixed", 5), drop_late_after_eviction=False
    )
    with pytest.raises(Exception, match="late events after eviction"):
        run_adaptive(source, strict)

    wide = AdaptiveStream(spark, str(tmp_path / "c"), guard=GuardConfig("fixed", 5000))
    cmp.assert_exact(cmp.verdict(window_aggregate(events), run_adaptive(source, wide)))


def test_repeated_batches_change_nothing(spark, tmp_path):
    events = late_events(spark)
    cut = [events.filter("n <= 300"), events.filter("n > 300")]
    controller = AdaptiveStream(
        spark, str(tmp_path / "s"), WindowConfig(), LatenessConfig(), GuardConfig("fixed", 60)
    )
    for version, batch in enumerate(cut):
        controller(batch, version)
        controller(batch, version)
    # A batch that died before its control file was written is simply run again.
    again = AdaptiveStream(
        spark, str(tmp_path / "t"), WindowConfig(), LatenessConfig(), GuardConfig("fixed", 60)
    )
    again(cut[0], 0)
    commit, again._commit = again._commit, lambda control: None
    again(cut[1], 1)
    again._commit = commit
    again(cut[1], 1)
    assert controller.control(1) == again.control(1)
    a, c = controller.finish(), again.finish()
    cmp.assert_exact(cmp.verdict(a, c))


def test_resumed_run_loses_nothing(spark, tmp_path):
    """Drain, finish, add data, die between write and commit, drain again."""
    events = late_events(spark)
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    controller = AdaptiveStream(spark, str(tmp_path / "s"), guard=GuardConfig("fixed", 5000))

    def drain(part):
        events.filter(part).coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(events.schema).parquet(path)
        return run_adaptive(source, controller, checkpoint)

    first = drain("n <= 300")
    cmp.assert_exact(cmp.verdict(window_aggregate(events.filter("n <= 300")), first))
    assert controller.last_version() == 0
    commit = controller._commit

    def dies(control):
        raise RuntimeError("killed before the commit")

    controller._commit = dies
    with pytest.raises(Exception, match="killed before the commit"):
        drain("n > 300 and n <= 500")
    controller._commit = commit
    cmp.assert_exact(cmp.verdict(window_aggregate(events), drain("n > 500")))


def test_committed_number_with_other_rows_raises(spark, tmp_path):
    events = late_events(spark)
    controller = AdaptiveStream(spark, str(tmp_path / "s"))
    controller(events.filter("n <= 300"), 0)
    with pytest.raises(RuntimeError, match="batch 0 is committed"):
        controller(events.filter("n > 300"), 0)


def test_messages(spark, events):
    sent = events.limit(20).withColumns(
        {"event_id": F.concat(F.lit("ev-"), F.col("n") - 1), "arrival_sequence": F.col("n") - 1}
    )
    wire = messages.encode_events(sent, "mild_ooo")
    assert ": " not in wire.first().value
    back = messages.decode_events(wire.select(F.col("value").cast("binary").alias("value")))
    assert back.select(events.columns).exceptAll(events.limit(20)).count() == 0
    assert back.first().scenario == "mild_ooo"


def test_a_batch_writes_only_the_buckets_it_hits(spark, tmp_path):
    """Buckets that a batch does not hit keep their files; tiers follow without a rewrite."""
    cfg = WindowConfig(60, 10)
    controller = AdaptiveStream(spark, str(tmp_path / "s"), cfg, guard=GuardConfig("fixed", 100))

    def readings(numbers, times):
        rows = [(n, t, "dev0", "s0", 1.0) for n, t in zip(numbers, times, strict=True)]
        return spark.createDataFrame(
            rows, "n long, event_time long, device_id string, sensor string, value double"
        )

    cuts = [
        readings(range(1, 201), range(0, 2000, 10)),  # buckets 0 to 3 of 640 s
        readings(range(201, 301), range(2000, 3000, 10)),  # buckets 3 and 4
        readings(range(301, 303), [3000, 700]),  # bucket 4, and 1 by a late event
    ]
    hit = [{"0", "1", "2", "3"}, {"3", "4"}, {"1", "4"}]
    folder = tmp_path / "s" / "store"
    for version, (batch, wanted) in enumerate(zip(cuts, hit, strict=True)):
        controller(batch, version)
        written = {p.name.split("=")[1] for p in (folder / f"version={version}").glob("bucket=*")}
        assert written == wanted
    now = controller.control(2)
    assert now.buckets == {"0": 0, "1": 2, "2": 0, "3": 1, "4": 2}
    # Replaced two batches ago: gone; replaced by the last batch: still there for a rerun.
    assert not (folder / "version=0" / "bucket=3").exists()
    assert (folder / "version=0" / "bucket=1").exists() and (folder / "version=1" / "bucket=4").exists()
    # The late event met released windows only, so nothing was added.
    assert now.late_after_eviction == 6 and now.frozen > 250
    assert controller.state(2).count() == now.hot + now.archive == sum(now.held.values())
    assert controller.final(2).count() == now.frozen
    events = cuts[0].unionByName(cuts[1]).unionByName(cuts[2].filter("event_time = 3000"))
    cmp.assert_exact(cmp.verdict(window_aggregate(events, cfg), controller.finish()))


def test_late_new_window_behind_the_frontier(spark, tmp_path):
    """A key never seen before opens behind the frontier, is archived at once and released by
    the next cycle; another event for it is then lost."""
    schema = "n long, event_time long, device_id string, sensor string, value double"
    controller = AdaptiveStream(
        spark, str(tmp_path / "s"), WindowConfig(10, 10), guard=GuardConfig("fixed", 0), cycle_batches=2
    )
    batches = [[(1, 0, "a", "s", 1.0), (2, 1000, "a", "s", 1.0)], [(3, 1001, "a", "s", 1.0)],
               [(4, 5, "b", "s", 2.0)], [(5, 6, "b", "s", 3.0)], [(6, 7, "b", "s", 4.0)]]
    seen = []
    for version, rows in enumerate(batches):
        controller(spark.createDataFrame(rows, schema), version)
        c = controller.control(version)
        seen.append((c.hot, c.archive, c.frozen, c.reconciled_events, c.late_after_eviction))
    assert seen == [(1, 1, 0, 0, 0), (1, 0, 1, 0, 0), (1, 1, 1, 0, 0), (1, 0, 2, 1, 0), (1, 0, 2, 1, 1)]
    row = controller.finish().filter("DeviceId = 'b'").first()
    assert (row["count"], row["sum"]) == (2, 5.0)
