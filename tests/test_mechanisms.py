"""Permuted arrival orders, distinct readings, mechanisms without release, repeatable forests."""

import pytest
from pyspark.sql import functions as F

from latewin.operators import disorder, iforest
from latewin.operators.lifecycle import accounting_cycles
from latewin.operators.windows import window_aggregate
from latewin.plans.mechanisms import presets
from latewin.plans.run import Run
from latewin.schema import Mechanism, WindowConfig
from latewin.streaming.windows import IDENTITY, run_deduplicated


@pytest.mark.parametrize("rows", [1, 2, 3, 97, 1000, 4096])
def test_every_position_once(spark, rows):
    out = disorder.keyed_shuffle(spark.range(rows).withColumnRenamed("id", "i"), rows, seed=5)
    got = [r.n for r in out.orderBy("i").collect()]
    assert sorted(got) == list(range(1, rows + 1))
    if rows > 90:
        assert sum(a + 1 == b for a, b in zip(got, got[1:], strict=False)) < rows / 10
        other = disorder.keyed_shuffle(spark.range(rows).withColumnRenamed("id", "i"), rows, seed=6)
        assert got != [r.n for r in other.orderBy("i").collect()]


def test_large_positions_and_no_shuffle(spark):
    rows = 10**12
    some = spark.range(rows - 2000, rows).withColumnRenamed("id", "i")
    out = disorder.keyed_shuffle(some, rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    got = [r.n for r in out.collect()]
    assert len(set(got)) == 2000 and all(1 <= n <= rows for n in got)


@pytest.fixture(scope="module")
def arrivals(spark):
    """Disordered readings of three series."""
    i = F.col("id")
    return spark.range(1, 1501).select(
        i.alias("n"),
        (F.lit(1000) + i * 2 - (i * 7919 % 37)).alias("event_time"),
        F.concat(F.lit("D"), (i % 3).cast("string")).alias("device_id"),
        F.lit("s").alias("sensor"),
        (i % 11).cast("double").alias("value"),
    ).cache()


@pytest.mark.parametrize("name", ["fixed", "fixed_lagged", "aloa", "maso"])
def test_held_rows(arrivals, name):
    """Rows are those of the batch aggregate; tiers are those of a walk over the arrivals."""
    cfg, mech = WindowConfig(60, 10), presets(fixed_seconds=7)[name]
    run = Run(arrivals, mech, cfg, horizon=20 if mech.accounting else None)
    got = {(r.start, r.DeviceId): r for r in run.held.collect()}
    want = {(r.start, r.DeviceId): r for r in window_aggregate(arrivals, cfg).collect()}
    assert got.keys() == want.keys()
    marks = {r.n: r.watermark for r in run.timed.select("n", "watermark").collect()}
    events = {r.n: r for r in arrivals.collect()}
    opened = {}
    for n in sorted(events):
        e = events[n]
        for k in range(6):
            opened.setdefault((e.event_time // 10 * 10 - 10 * k, e.device_id), n)
    last = max(marks)
    for key, row in got.items():
        assert (row["count"], row["sum"]) == (want[key]["count"], pytest.approx(want[key]["sum"]))
        first = opened[key]
        sealed = next((n for n in range(first, last + 1) if marks[n] >= key[0] + 60), None)
        assert (row.opened, row.archived) == (first, sealed)
        assert row.tier == ("hot" if sealed is None else "archive")
    if name == "maso":
        cycles = accounting_cycles(run.timed, run.keys, mech.cycle_events)
        assert sum(r.accounted_cycles for r in got.values()) == cycles.agg(F.sum("total_entries")).first()[0]
    if name == "fixed_lagged":
        tops = 0
        for n in sorted(events):
            before = tops if n > 1 else events[n].event_time
            assert marks[n] == before - 7
            tops = max(tops, events[n].event_time)


def test_only_a_fixed_budget_lags(arrivals):
    with pytest.raises(ValueError, match="fixed budget"):
        Mechanism("x", "adaptive", lagged=True)
    with pytest.raises(ValueError, match="released under a guard"):
        _ = Run(arrivals, presets()["full"]).held


def test_late_repeats_are_found(spark, tmp_path):
    schema = "n long, event_time long, device_id string, sensor string, value double"
    cuts = [
        [(1, 100, "a", "s", 1.0), (2, 100, "a", "s", 1.0), (3, 200, "a", "s", 1.0)],
        [(4, 100, "a", "s", 1.0), (5, 100, "a", "s", 2.0), (6, 100, "b", "s", 1.0)],
    ]
    for part in cuts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in run_deduplicated(source, 1000).collect())
    assert got == sorted({r[1:] for part in cuts for r in part}) and len(IDENTITY) == 4


def test_short_subsamples_are_widened(spark, monkeypatch):
    """Ranks that would leave a tree short are not cut off in silence."""
    rows = 3000
    feats = spark.range(rows).select(
        F.col("id").alias("start"), F.lit("d").alias("DeviceId"), F.lit("s").alias("Sensor")
    )
    cfg = iforest.ForestConfig(trees=4, sample=50)
    cut = iforest._ranked
    shares = []

    def short(features, cfg, share):
        shares.append(share)
        found = cut(features, cfg, share)
        return found if share == 1.0 else found.filter("tree <> 2 or start % 2 = 0")

    monkeypatch.setattr(iforest, "_ranked", short)
    got = iforest.subsamples(feats, rows, cfg).groupBy("tree").count().collect()
    assert {r.tree: r["count"] for r in got} == dict.fromkeys(range(4), 50)
    assert shares[-1] == 1.0 and len(shares) == 2
