"""Features of window rows and isolation-forest scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from latewin.operators.features import FEATURES, clean, window_features
from latewin.operators.iforest import (
    DEPTH_PLACES,
    EULER,
    HASHES,
    PRIME,
    SCORE_PLACES,
    Detection,
    ForestConfig,
    histogram,
)
from latewin.operators.quantile import exact_quantile
from latewin.operators.windows import window_aggregate
from latewin.plans import bindings as b
from latewin.plans.catalog import sql as s
from latewin.plans.catalog.registry import query

W = b.WINDOW
ROWS = f"{s.EV}, {s.pairs(W, 'ev')}, rows AS ({s.agg(places=None)})"


def rows(spark, d):
    return window_aggregate(b.canonical(spark, d), W)


@query(
    "window_features",
    f"""WITH {ROWS} SELECT start, "DeviceId", "Sensor", CAST(count AS DOUBLE) AS count,
    round(sum, 6) AS sum, round(avg, 8) AS avg, min, max, round(max - min, 6) AS val_range,
    round((avg - min) / (max - min + 1e-6), 6) AS avg_ratio,
    CAST((start // 3600) % 24 AS DOUBLE) AS window_hour,
    CAST((start // 60) % 60 AS DOUBLE) AS window_minute,
    round(coalesce(avg - lag(avg) OVER (PARTITION BY "DeviceId", "Sensor" ORDER BY start), 0.0), 8)
      AS lag_avg_diff FROM rows""",
)
def features(spark, d):
    out = window_features(rows(spark, d))
    places = {"sum": 6, "avg": 8, "val_range": 6, "avg_ratio": 6, "lag_avg_diff": 8}
    return out.withColumns({c: F.round(c, k) for c, k in places.items()})


@query(
    "feature_cleanup",
    f"""WITH {s.EV} SELECT i, CASE WHEN i % 7 IN (0, 3) THEN 0.0 WHEN i % 7 = 1 THEN 1e6
    WHEN i % 7 = 2 THEN -1e6 ELSE value END AS cleaned FROM ev""",
)
def feature_cleanup(spark, d):
    k = F.col("i") % 7
    broken = (
        F.when(k == 0, float("nan"))
        .when(k == 1, float("inf"))
        .when(k == 2, float("-inf"))
        .when(k != 3, F.col("value"))
    )
    return b.canonical(spark, d).select("i", clean(broken).alias("cleaned"))


@query(
    "value_histogram",
    f"""WITH {s.EV}, ends AS (SELECT min(value) AS lo, (max(value) - min(value)) / 10 AS w FROM ev),
    placed AS (SELECT CAST(least(floor((value - lo) / w), 9) AS INTEGER) AS bin FROM ev, ends)
    SELECT r.bin, round(lo + w * r.bin, 3) AS bin_start, round(lo + w * (r.bin + 1), 3) AS bin_end,
    count(placed.bin) AS count FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) r
    CROSS JOIN ends LEFT JOIN placed ON placed.bin = r.bin GROUP BY r.bin, lo, w""",
)
def value_histogram(spark, d):
    """The histogram operator of the score report, on a column SQL also has."""
    return histogram(b.canonical(spark, d), "value")


@query(
    "exact_quantile",
    f"""WITH {s.EV} SELECT round(quantile_cont(value, 0.95), 9) AS p95,
    round(quantile_cont(value, 0.5), 9) AS p50 FROM ev""",
)
def quantiles(spark, d):
    """The contamination threshold's operator, on a column SQL also has."""
    values = b.canonical(spark, d).select("value")
    p95, p50 = (exact_quantile(values, "value", q) for q in (0.95, 0.5))
    return values.agg(
        F.round(F.max(F.lit(p95)), 9).alias("p95"), F.round(F.max(F.lit(p50)), 9).alias("p50")
    )


# The forest by the operator's rules: subsamples by rank, nodes level by level, then every row
# walks down every tree.
CFG = ForestConfig()
_HEX = "('0x' || md5({})[1:7])::BIGINT"
_X = ", ".join(f"{c}::DOUBLE" for c in FEATURES)
_LEVELS = range(9)


def _level(k: int) -> str:
    """Nodes of depth k, and the rows that go on to depth k + 1."""
    size = len(FEATURES)
    ends = [f"list_value({', '.join(f'{f}(x[{i}])' for i in range(1, size + 1))})" for f in ("min", "max")]
    feature = _HEX.format(f"'{CFG.seed}|feature|' || tree || '|' || node")
    share = f"({_HEX.format(f"'{CFG.seed}|cut|' || tree || '|' || node")} / {float(HASHES)})"
    return f"""g{k} AS (
      SELECT tree, node, count(*) AS n, {ends[0]} AS low, {ends[1]} AS high FROM s{k} GROUP BY tree, node
    ), u{k} AS (
      SELECT *, list_filter(range(1, {size + 1}), lambda i: high[i] > low[i]) AS usable FROM g{k}
    ), f{k} AS (
      SELECT tree, node, n, CASE WHEN n <= 1 OR len(usable) = 0 OR {k} >= depth_limit THEN 0
        ELSE usable[{feature} % len(usable) + 1] END AS feature, low, high FROM u{k}, size_of
    ), n{k} AS (
      SELECT tree, node, feature, CASE WHEN low[feature] + (high[feature] - low[feature]) * {share} >= high[feature]
          THEN low[feature] ELSE low[feature] + (high[feature] - low[feature]) * {share} END AS cut,
        round({k} + CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1
          ELSE 2 * (ln(n - 1.0::DOUBLE) + {EULER}) - 2 * (n - 1.0::DOUBLE) / n END, {DEPTH_PLACES}) AS depth
      FROM f{k}
    ), s{k + 1} AS (
      SELECT tree, node * 2 + CASE WHEN x[feature] <= cut THEN 1 ELSE 2 END AS node, x
      FROM s{k} JOIN n{k} USING (tree, node) WHERE feature > 0
    )"""


_FEATURES_SQL = f"""feats AS (
  SELECT start, "DeviceId", "Sensor", CAST(count AS DOUBLE) AS count, round(sum, 6) AS sum,
    round(avg, 8) AS avg, min, max, round(max - min, 6) AS val_range,
    round((avg - min) / (max - min + 1e-6), 6) AS avg_ratio,
    CAST((start // 3600) % 24 AS DOUBLE) AS window_hour, CAST((start // 60) % 60 AS DOUBLE) AS window_minute,
    round(coalesce(avg - lag(avg) OVER (PARTITION BY "DeviceId", "Sensor" ORDER BY start), 0.0), 8)
      AS lag_avg_diff FROM rows)"""


def _scores(source: str) -> str:
    """CTEs that end in ``scored``: the features with anomaly_score and is_anomaly."""
    ranked = f"""(kh * a + b) % {PRIME}"""
    constants = ", ".join(
        f"{_HEX.format(f"'{CFG.seed}|{name}|' || tree")} + 1 AS {name}" for name in "ab"
    )
    return f"""{source}, kf AS (
      SELECT *, list_value({_X}) AS x, {_HEX.format("start || '|' || \"DeviceId\" || '|' || \"Sensor\"")} AS kh,
        row_number() OVER () AS rid FROM feats
    ), size_of AS (
      SELECT least(count(*), {CFG.sample}) AS sample,
        ceil(log2(greatest(least(count(*), {CFG.sample}), 2)))::BIGINT AS depth_limit FROM kf
    ), trees AS (SELECT tree, {constants} FROM (SELECT range AS tree FROM range({CFG.trees}))),
    s0 AS (
      SELECT tree, 0 AS node, x FROM (
        SELECT tree, x, row_number() OVER (PARTITION BY tree
          ORDER BY {ranked}, start, "DeviceId", "Sensor") AS place FROM kf, trees
      ) WHERE place <= {CFG.sample}
    ), {", ".join(_level(k) for k in _LEVELS)}, forest AS (
      {" UNION ALL ".join(f"SELECT * FROM n{k}" for k in _LEVELS)}
    ), w0 AS (SELECT rid, x, tree, 0 AS node FROM kf, trees),
    {", ".join(
        f"w{k + 1} AS (SELECT rid, x, tree, node * 2 + CASE WHEN x[feature] <= cut THEN 1 ELSE 2 END AS node"
        f" FROM w{k} JOIN n{k} USING (tree, node) WHERE feature > 0)" for k in _LEVELS
    )}, total AS (
      SELECT rid, sum(depth) AS depth FROM (
        {" UNION ALL ".join(f"SELECT rid, depth FROM w{k} JOIN n{k} USING (tree, node) WHERE feature = 0" for k in _LEVELS)}
      ) GROUP BY rid
    ), raw AS (
      SELECT kf.*, round(pow(2.0, -depth / {CFG.trees} / CASE WHEN sample = 2 THEN 1 ELSE
        2 * (ln(sample - 1.0::DOUBLE) + {EULER}) - 2 * (sample - 1.0::DOUBLE) / sample END), {SCORE_PLACES}) AS score
      FROM kf JOIN total USING (rid), size_of
    ), scored AS (
      SELECT * EXCLUDE (score, x, kh, rid),
        round(score - (SELECT quantile_cont(score, {1 - CFG.contamination}) FROM raw), {SCORE_PLACES}) AS anomaly_score
      FROM raw
    ), flagged AS (SELECT *, anomaly_score > 0 AS is_anomaly FROM scored)"""


SCORED = f"WITH {_scores(f'{ROWS}, {_FEATURES_SQL}')}"
_SUMMARY = f"""count(*) FILTER (is_anomaly) AS anomaly_count,
  round(count(*) FILTER (is_anomaly) / count(*) * 100, 2) AS anomaly_percentage,
  round(min(anomaly_score), 4) AS score_min, round(max(anomaly_score), 4) AS score_max,
  round(avg(anomaly_score), 4) AS score_mean, 'IsolationForest' AS algorithm,
  {CFG.contamination}::DOUBLE AS contamination, {CFG.seed} AS random_state, {CFG.trees} AS n_estimators"""


@query("anomaly_scores", f"{SCORED} SELECT * FROM flagged")
def anomaly_scores(spark, d):
    return Detection(rows(spark, d)).scored


@query(
    "anomaly_summary",
    f"{SCORED} SELECT 'success' AS status, count(*) AS observations_scored, {_SUMMARY} FROM flagged",
)
def anomaly_summary(spark, d):
    return Detection(rows(spark, d)).summary()


@query(
    "anomaly_histogram",
    f"""{SCORED}, ends AS (SELECT min(anomaly_score) AS lo, (max(anomaly_score) - min(anomaly_score)) / 10 AS w
      FROM flagged), placed AS (
      SELECT CAST(least(floor((anomaly_score - lo) / w), 9) AS INTEGER) AS bin FROM flagged, ends)
    SELECT r.bin, round(lo + w * r.bin, 3) AS bin_start, round(lo + w * (r.bin + 1), 3) AS bin_end,
    count(placed.bin) AS count FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) r
    CROSS JOIN ends LEFT JOIN placed ON placed.bin = r.bin GROUP BY r.bin, lo, w""",
)
def anomaly_histogram(spark, d):
    return Detection(rows(spark, d)).histogram()


@query(
    "top_anomalies",
    f"""{SCORED} SELECT * FROM flagged WHERE is_anomaly
    ORDER BY anomaly_score DESC, start, "DeviceId", "Sensor" LIMIT 50""",
)
def top_anomalies(spark, d):
    return Detection(rows(spark, d)).top()


@query("anomaly_preview", f"""{SCORED} SELECT * FROM flagged ORDER BY "DeviceId", "Sensor", start LIMIT 20""")
def anomaly_preview(spark, d):
    return Detection(rows(spark, d)).preview()


# The rows of one series and its first windows, fewer than a forest needs.
FEW = """few AS (SELECT * FROM rows WHERE "DeviceId" = (SELECT min("DeviceId") FROM rows)
  ORDER BY start, "Sensor" LIMIT 4)"""


@query(
    "anomaly_insufficient",
    f"""WITH {ROWS}, {FEW} SELECT 'insufficient_data' AS status, count(*) AS observations_scored,
    0::BIGINT AS anomaly_count, 0.0::DOUBLE AS anomaly_percentage, 0.0::DOUBLE AS score_min,
    0.0::DOUBLE AS score_max, 0.0::DOUBLE AS score_mean, 'IsolationForest' AS algorithm,
    {CFG.contamination}::DOUBLE AS contamination, {CFG.seed} AS random_state, {CFG.trees} AS n_estimators FROM few""",
)
def anomaly_insufficient(spark, d):
    """The guard against too few rows."""
    found = rows(spark, d)
    first = found.agg(F.min("DeviceId").alias("DeviceId"))
    few = found.join(first, "DeviceId").orderBy("start", "Sensor").limit(4)
    return Detection(few.select(found.columns)).summary()
