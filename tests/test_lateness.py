"""Rolling lateness over histories of any length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latewin.operators import lateness as lt
from latewin.schema import LatenessConfig

CONFIGS = [
    {"history": 250, "min_observations": 130, "interval": 100},
    {"history": 30, "min_observations": 100, "interval": 100},
    {"history": 97, "min_observations": 10, "interval": 40},
    {"history": 5000, "min_observations": 100, "interval": 500},
]


@pytest.fixture(scope="module")
def observed(spark):
    """Two arrival orders; the second much more disordered."""
    late = F.when(F.col("id") % 7 < 2 + F.col("run") * 3, F.col("id") * 7919 % 211).otherwise(0)
    events = (
        spark.range(1, 1401)
        .withColumn("run", F.explode(F.array(F.lit(0), F.lit(1))))
        .select("run", F.col("id").alias("n"), (F.col("id") * 3 - late).alias("event_time"))
    )
    return lt.observe_lateness(events, ["run"]).cache()


def expected(observed, cfg, run):
    rows = observed.filter(F.col("run") == run).orderBy("n").collect()
    late = np.array([r.lateness for r in rows])
    out = {}
    for point in range(1, len(rows) + 1):
        first = cfg.min_observations
        if point == first or (point > first and point % cfg.interval == 0):
            past = late[max(0, point - cfg.history) : point]
            out[point] = (
                np.quantile(past, cfg.cut),
                (past > 0).mean(),
                rows[point - 1].arrival_rate,
                rows[point - 1].watermark_lag,
            )
    return out


@pytest.mark.parametrize("sizes", CONFIGS, ids=lambda s: "-".join(map(str, s.values())))
def test_any_history(observed, sizes, monkeypatch):
    monkeypatch.setattr(lt, "BLOCK_ROWS", 256)  # several stretches
    cfg = LatenessConfig(percentile=0.9, **sizes)
    rows = lt.rolling_lateness(observed, cfg, ["run"]).collect()
    for run in (0, 1):
        got = {
            r.point: (r.lateness_percentile, r.ooo_ratio, r.arrival_rate, r.watermark_lag)
            for r in rows
            if r.run == run
        }
        want = expected(observed, cfg, run)
        assert got.keys() == want.keys()
        for point, values in want.items():
            assert got[point] == pytest.approx(values)


def test_arrivals_are_not_copied_to_points(observed):
    """Arrivals are counted before anything is generated, and then as panes only."""
    plan = lt.rolling_lateness(observed, LatenessConfig(history=1000, interval=100))
    text = plan._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    assert text.count("Generate") == 1
    assert "Aggregate" in text.split("Generate")[1] and "Aggregate" not in text.split("Generate")[0]


def test_budget_and_watermark_over_overlapping_histories(observed):
    cfg = LatenessConfig(5, 2, 200, history=250, min_observations=130, interval=100)
    one = observed.filter("run = 1")
    timed = lt.adaptive_watermark(one, lt.adaptive_budget(one, cfg), cfg).orderBy("n").collect()
    stats = {r.point: r.budget for r in lt.rolling_lateness(one, cfg).select(
        "point", lt.budget_expression(cfg).alias("budget")).collect()}
    budget, watermark = cfg.initial, -(10**9)
    for r in timed:
        budget = stats.get(r.n, budget)
        watermark = max(watermark, r.max_event_time - budget)
        assert (r.budget, r.watermark) == (budget, watermark)
