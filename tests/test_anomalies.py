"""Features, exact quantile and isolation forest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latewin.operators import features as ft
from latewin.operators import iforest, quantile
from latewin.operators.windows import window_aggregate
from latewin.schema import RESULT


@pytest.fixture(scope="module")
def rows(spark):
    """2,400 readings of 3 devices and 2 sensors, every 400th five times too large."""
    i = F.col("id")
    base = F.when(i % 2 == 0, 20.0).otherwise(50.0) + (i * 7919 % 100) / 50.0
    events = spark.range(0, 2400).select(
        (F.lit(1704067200) + i * 2).alias("event_time"),
        F.concat(F.lit("D"), (i % 3).cast("string")).alias("device_id"),
        F.concat(F.lit("S"), (i % 2).cast("string")).alias("sensor"),
        F.when(i % 400 == 399, base * 5).otherwise(base).alias("value"),
    )
    return window_aggregate(events).cache()


def test_features_by_hand(spark, monkeypatch):
    monkeypatch.setattr(ft, "STRETCH", 15)
    data = [
        (s, s + 60, "D", "S", 2, float(v), v / 2, 1.0, 3.0)
        for s, v in ((3600, 4), (3610, 6), (3630, 10), (3690, 1))
    ] + [(3610, 3670, "E", "S", None, NAN, float("inf"), 0.0, 0.0)]
    out = {
        (r.DeviceId, r.start): r
        for r in ft.window_features(spark.createDataFrame(data, RESULT)).collect()
    }
    assert [out["D", s].lag_avg_diff for s in (3600, 3610, 3630, 3690)] == [0.0, 1.0, 2.0, -4.5]
    assert out["D", 3690].window_hour == 1.0 and out["D", 3690].window_minute == 1.0
    assert out["D", 3600].avg_ratio == pytest.approx(1.0 / (2.0 + 1e-6))
    e = out["E", 3610]
    assert (e["count"], e["sum"], e.avg, e.lag_avg_diff) == (0.0, 0.0, 1e6, 0.0)


NAN = float("nan")


def test_exact_quantile(spark, monkeypatch):
    monkeypatch.setattr(quantile, "BINS", 7)
    rng = np.random.default_rng(1)
    for values in (
        rng.normal(size=301), np.repeat([1.0, 2.0, 3.0], [100, 1, 50]), np.array([4.0]),
        np.concatenate([np.zeros(200), rng.random(40)]),
    ):
        df = spark.createDataFrame([(float(v),) for v in values], "x double").cache()
        for q in (0.0, 0.3, 0.5, 0.95, 1.0):
            assert quantile.exact_quantile(df, "x", q) == pytest.approx(np.quantile(values, q), abs=1e-12)
    assert quantile.exact_quantile(df.limit(0), "x", 0.5) is None


def test_detection(rows):
    first, again = iforest.Detection(rows), iforest.Detection(rows)
    s = first.summary().first()
    assert s.status == "success" and s.observations_scored == rows.count()
    assert 0 < s.anomaly_percentage <= 5.1
    assert s == again.summary().first()
    bins = first.histogram().collect()
    assert len(bins) == 10 and sum(b["count"] for b in bins) == s.observations_scored
    top = first.top(20).collect()
    assert [t.anomaly_score for t in top] == sorted((t.anomaly_score for t in top), reverse=True)
    spike = F.col("max") > 2 * F.col("min")
    means = {
        r.spike: r.m
        for r in first.scored.groupBy(spike.alias("spike")).agg(F.avg("anomaly_score").alias("m")).collect()
    }
    assert means[True] > means[False]


def test_score_equals_plain_walk(rows):
    feats = ft.window_features(rows).cache()
    forest = iforest.fit_forest(feats, iforest.ForestConfig(trees=7, sample=64)).cache()
    sizes = forest.filter("node = 0").count()
    assert sizes == 7
    nodes = {(n.tree, n.node): n for n in forest.collect()}
    scored = iforest.score(feats, forest, 64).limit(200).collect()
    norm = iforest.average_path([64])[0]
    for r in scored:
        depth = 0.0
        for tree in range(7):
            n = nodes[tree, 0]
            while n.feature >= 0:
                side = n.left if r[ft.FEATURES[n.feature]] <= n.threshold else n.right
                n = nodes[tree, side]
            depth += n.depth
        assert r.score == pytest.approx(2 ** (-depth / 7 / norm))


def test_subsample_is_the_hash_minimum(rows):
    feats = ft.window_features(rows).cache()
    cfg = iforest.ForestConfig(trees=3, sample=20)
    got = iforest.subsamples(feats, feats.count(), cfg).groupBy("tree").count().collect()
    assert {r.tree: r["count"] for r in got} == {0: 20, 1: 20, 2: 20}


def test_too_few_rows(rows):
    d = iforest.Detection(rows.limit(4))
    s = d.summary().first()
    assert (s.status, s.observations_scored, s.anomaly_count) == ("insufficient_data", 4, 0)
    assert d.top().count() == 0 and d.histogram().count() == 0
