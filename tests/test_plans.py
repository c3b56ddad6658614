"""Physical plans: how often a table is read, how many steps a frontier leaves."""

import re

import pytest
from pyspark.sql import functions as F

from latewin.operators import lifecycle as lc
from latewin.operators.lateness import arrival_lateness, inversions, observe_order
from latewin.plans import bindings as b
from latewin.plans.catalog import ENTRIES
from latewin.schema import WindowConfig


def scans(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"FileScan parquet", plan))


@pytest.mark.parametrize("name", ["profile_summary", "ordering_metrics", "scenario_disorder"])
def test_two_scans_at_most(spark, sf, name):
    assert scans(ENTRIES[name].run(spark, sf)) <= 2


def test_one_scan_equals_stacked_ones(spark, sf):
    columns = ["n", "max_before", "max_event_time", "lateness", "out_of_order", "previous_time", "inversion"]
    events = b.arrivals(spark, sf)
    stacked = inversions(arrival_lateness(events)).select(columns)
    for made in (observe_order(events), observe_order(b.observed(spark, sf))):
        assert made.select(columns).exceptAll(stacked).isEmpty()
        assert stacked.exceptAll(made.select(columns)).isEmpty()


def test_many_cycles_on_few_values_leave_one_step_per_value(spark, monkeypatch):
    seen = {}

    def spy(values, series, by=(), value="value"):
        seen.update(series)
        return real(values, series, by, value)

    real = lc.first_reached
    monkeypatch.setattr(lc, "first_reached", spy)
    n = 100_000
    cycles = spark.range(1, n + 1).select(
        F.col("id").alias("position"), (F.col("id") % 7 * 10).alias("frontier")
    )
    timed = spark.createDataFrame(
        [(1, 5, None, 5), (2, 25, 5, 25)],
        "n long, event_time long, watermark_before long, watermark long",
    ).withColumns({"device_id": F.lit("d"), "sensor": F.lit("s"), "value": F.lit(1.0)})
    table = lc.reach_table(timed, WindowConfig(10, 10), cycles)
    assert {r["value"]: r["cleared"] for r in table.collect()} == {10: 1, 30: 3}
    assert seen["cleared"].count() == 7


def test_many_rises_leave_one_step_per_slide(spark, monkeypatch):
    seen, real = {}, lc.first_reached

    def spy(values, series, by=(), value="value"):
        seen.update(series)
        return real(values, series, by, value)

    monkeypatch.setattr(lc, "first_reached", spy)
    n = F.col("id")
    timed = spark.range(1, 1001).select(
        n.alias("n"),
        (n + 5).alias("event_time"),
        n.alias("watermark"),
        F.when(n > 1, n - 1).alias("watermark_before"),
    )
    for horizon in (None, 7):
        table = lc.reach_table(timed, WindowConfig(300, 100), horizon=horizon)
        got = {r["value"]: r["reached"] for r in table.collect()}
        ends = {100 * k for k in range(1, 14)}
        ends |= {e + horizon for e in ends} if horizon else set()
        assert got == {e: e if e <= 1000 else None for e in ends}
        assert seen["reached"].count() == (1001 if horizon else 11) - bool(horizon)
