"""Late events reduced to panes give the counts and rows of every single pair."""

import pytest
from pyspark.sql import functions as F

from latewin import GuardConfig, Mechanism, WindowConfig
from latewin.operators import lifecycle as lc
from latewin.operators.windows import combine, finish, partial_aggregates
from latewin.plans.run import Run

CFG = WindowConfig(60, 10)


@pytest.fixture(scope="module")
def events(spark):
    """1,000 readings in order, then 3,000 late ones that fall into eight panes; a few have no
    device, a few no time."""
    n = F.col("id")
    late = F.lit(1200) + n % 80
    return spark.range(1, 4001).select(
        n.alias("n"),
        F.when(n % 997 != 0, F.when(n <= 1000, 1000 + n).otherwise(late)).alias("event_time"),
        F.when(n % 50 != 0, F.concat(F.lit("D"), (n % 2).cast("string"))).alias("device_id"),
        F.lit("s").alias("sensor"),
        (n % 11).cast("double").alias("value"),
    ).cache()


@pytest.mark.parametrize("guard", [None, GuardConfig("fixed", 30, 1500), GuardConfig("adaptive", 4, 100)])
def test_as_pair_by_pair(events, guard):
    run = Run(events, Mechanism("m", "fixed", 20, guard=guard), CFG)
    groups = run.late_groups
    behind = run.panes.filter("behind").count()
    assert groups.count() <= 7 * behind < 700

    pairs = lc.late_pairs(run.timed, run.keys, CFG).cache()
    want = {r.category: r["count"] for r in pairs.groupBy("category").count().collect()}
    got = run.late.first()
    assert sum(c for name, c in want.items() if name != "A") > 1000
    assert bool(guard and guard.policy == "fixed") <= ("C" in want)
    assert (got.reconciled_events, got.late_after_eviction) == (
        want.get("B", 0), want.get("C", 0)
    )
    assert got.pairs == 6 * events.count()

    if guard is None:
        return
    keys = ["start", "device_id", "sensor"]
    every = lc.classify_pairs(run.timed, run.keys, CFG).filter("category <> 'C'")
    rows = finish(combine(every.groupBy(*keys).agg(*partial_aggregates()), keys), CFG)
    assert run.result.exceptAll(rows).isEmpty() and rows.exceptAll(run.result).isEmpty()


def test_late_pairs_are_not_dealt_out(events):
    """What is exchanged for the late counts are panes, not (event, window) pairs."""
    run = Run(events, Mechanism("m", "fixed", 20), CFG)
    plan = run.late._jdf.queryExecution().executedPlan().toString()
    assert "watermark_before" not in plan
