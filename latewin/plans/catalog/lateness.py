"""Adaptive lateness, budgets and watermarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from latewin.operators import lateness as lt
from latewin.plans import bindings as b
from latewin.plans.catalog import sql as s
from latewin.plans.catalog.registry import query
from latewin.plans.run import Run

BASE = f"{s.arr()}, {s.obs()}"
ADAPTIVE = f"{BASE}, {s.adaptive()}"
FIXED = f"{BASE}, {s.fixed(3600)}"


def _run(spark, d, name="aloa"):
    return Run(b.observed(spark, d), b.mechanisms()[name], b.WINDOW)


@query(
    "lateness_observations",
    f"""WITH {BASE} SELECT n, event_time, lateness, out_of_order,
    CAST(sum(CAST(out_of_order AS BIGINT)) OVER (ORDER BY n) AS BIGINT) AS ooo_seen,
    round(sum(CAST(out_of_order AS BIGINT)) OVER (ORDER BY n) / n, 9) AS ooo_ratio,
    max_event_time, round(arrival_rate, 9) AS arrival_rate, watermark_lag FROM obs""",
)
def lateness_observations(spark, d):
    obs = lt.with_disorder_counts(b.observed(spark, d))
    return obs.select(
        "n",
        "event_time",
        "lateness",
        "out_of_order",
        "ooo_seen",
        F.round("ooo_ratio", 9).alias("ooo_ratio"),
        "max_event_time",
        F.round("arrival_rate", 9).alias("arrival_rate"),
        "watermark_lag",
    )


@query(
    "rolling_lateness_p95",
    f"""WITH {BASE}, {s.points()} SELECT point,
    round(lateness_percentile, 6) AS lateness_percentile FROM points""",
)
def rolling_lateness_p95(spark, d):
    stats = lt.rolling_lateness(b.observed(spark, d), b.LATENESS)
    return stats.select("point", F.round("lateness_percentile", 6).alias("lateness_percentile"))


@query(
    "rolling_ooo_ratio",
    f"""WITH {BASE}, {s.points()} SELECT point, round(ooo_ratio, 6) AS ooo_ratio,
    round(arrival_rate, 9) AS arrival_rate, watermark_lag FROM points""",
)
def rolling_ooo_ratio(spark, d):
    stats = lt.rolling_lateness(b.observed(spark, d), b.LATENESS)
    return stats.select(
        "point",
        F.round("ooo_ratio", 6).alias("ooo_ratio"),
        F.round("arrival_rate", 9).alias("arrival_rate"),
        "watermark_lag",
    )


def _long_history_sql() -> str:
    cfg = b.LONG_HISTORY
    first, step = cfg.min_observations, cfg.interval
    return f"""WITH {BASE}, chosen AS (SELECT n AS point, arrival_rate, watermark_lag FROM obs
      WHERE n = {first} OR (n > {first} AND n % {step} = 0))
    SELECT point, round(quantile_cont(o.lateness, {cfg.cut}), 6) AS lateness_percentile,
    round(avg(CAST(o.out_of_order AS DOUBLE)), 6) AS ooo_ratio,
    round(any_value(c.arrival_rate), 9) AS arrival_rate,
    any_value(c.watermark_lag) AS watermark_lag
    FROM chosen c JOIN obs o ON o.n > c.point - {cfg.history} AND o.n <= c.point
    GROUP BY point"""


@query("rolling_lateness_history", _long_history_sql())
def rolling_lateness_history(spark, d):
    """Histories longer than the interval, from histograms of panes."""
    stats = lt.rolling_lateness(b.observed(spark, d), b.LONG_HISTORY)
    return stats.select(
        "point",
        F.round("lateness_percentile", 6).alias("lateness_percentile"),
        F.round("ooo_ratio", 6).alias("ooo_ratio"),
        F.round("arrival_rate", 9).alias("arrival_rate"),
        "watermark_lag",
    )


@query("adaptive_budget", f"WITH {ADAPTIVE} SELECT n, budget FROM timed")
def adaptive_budget(spark, d):
    return _run(spark, d).timed.select("n", "budget")


@query(
    "adaptive_watermark",
    f"""WITH {ADAPTIVE} SELECT n, event_time, max_event_time, budget, watermark,
    watermark_before FROM timed""",
)
def adaptive_watermark(spark, d):
    return _run(spark, d).timed.select(
        "n", "event_time", "max_event_time", "budget", "watermark", "watermark_before"
    )


@query(
    "fixed_watermark",
    f"WITH {FIXED} SELECT n, event_time, budget, watermark, watermark_before FROM timed",
)
def fixed_watermark(spark, d):
    obs = lt.arrival_lateness(b.arrivals(spark, d))
    return lt.fixed_watermark(obs, 3600).select(
        "n", "event_time", "budget", "watermark", "watermark_before"
    )


@query(
    "fixed_watermark_lagged",
    f"""WITH {BASE} SELECT n, coalesce(max_before, event_time) - 3600 AS watermark,
    lag(coalesce(max_before, event_time) - 3600) OVER (ORDER BY n) AS watermark_before
    FROM obs""",
)
def fixed_watermark_lagged(spark, d):
    obs = lt.arrival_lateness(b.arrivals(spark, d))
    return lt.fixed_watermark(obs, 3600, lagged=True).select(
        "n", "watermark", "watermark_before"
    )


@query(
    "watermark_updates",
    f"""WITH {ADAPTIVE} SELECT count(*) FILTER (watermark_before IS NULL
      OR watermark > watermark_before) AS watermark_updates,
    min(watermark) AS first_watermark, max(watermark) AS final_watermark,
    max(max_event_time) AS max_event_time FROM timed""",
)
def watermark_updates(spark, d):
    return lt.watermark_updates(_run(spark, d).timed)


REPORT = """SELECT '{source}' AS source, CAST({initial} AS BIGINT) AS configured_initial_seconds,
  arg_min(budget, n) AS first_calculated_seconds, arg_max(budget, n) AS final_seconds,
  min(budget) AS minimum_seconds, max(budget) AS maximum_seconds,
  count(*) FILTER (budget <> prev) AS changes,
  round(CAST(sum(budget) AS DOUBLE) / count(*), 3) AS mean_seconds
  FROM (SELECT *, lag(budget) OVER (ORDER BY n) AS prev FROM timed)"""


@query(
    "budget_report",
    f"WITH {ADAPTIVE} {REPORT.format(source='adaptive', initial=b.LATENESS.initial)}",
)
def budget_report(spark, d):
    return lt.budget_report(_run(spark, d).timed, b.LATENESS)


@query(
    "budget_report_fixed", f"WITH {FIXED} {REPORT.format(source='fixed', initial=3600)}"
)
def budget_report_fixed(spark, d):
    obs = lt.arrival_lateness(b.arrivals(spark, d))
    return lt.budget_report(lt.fixed_watermark(obs, 3600), b.LATENESS, source="fixed")


@query(
    "budget_split",
    f"""WITH {ADAPTIVE} SELECT count(*) FILTER (lateness <= budget) AS within_budget_events,
    count(*) FILTER (lateness > budget) AS over_budget_events,
    round(count(*) FILTER (lateness <= budget) / count(*), 6) AS within_budget_ratio,
    round(count(*) FILTER (lateness > budget) / count(*), 6) AS over_budget_ratio FROM timed""",
)
def budget_split(spark, d):
    return lt.budget_split(_run(spark, d).timed)


@query(
    "policy_replay",
    f"""WITH {s.scenarios_arr()}, {s.obs("scenario")}, {s.adaptive(by="scenario")}
    SELECT scenario, count(*) AS events, count(*) FILTER (out_of_order) AS ooo_events,
    round(count(*) FILTER (out_of_order) / count(*), 6) AS ooo_ratio,
    max(lateness) AS max_lateness_seconds, min(budget) AS minimum_budget_seconds,
    max(budget) AS maximum_budget_seconds, arg_max(budget, n) AS final_budget_seconds
    FROM timed GROUP BY scenario""",
)
def policy_replay(spark, d):
    """The policy over every scenario at once."""
    run = Run(b.observed_scenarios(spark, d), b.mechanisms()["aloa"], b.WINDOW, ["scenario"])
    return lt.policy_replay(run.timed, ["scenario"])


@query(
    "policy_snapshot",
    f"""WITH {ADAPTIVE}, tail AS (SELECT * FROM timed ORDER BY n DESC LIMIT 100)
    SELECT count(*) AS events_seen, count(*) FILTER (out_of_order) AS ooo_events,
    max(max_event_time) AS max_event_time, arg_max(budget, n) AS allowed_lateness_seconds,
    arg_max(lateness, n) AS last_lateness, arg_max(out_of_order, n) AS last_out_of_order,
    round(arg_max(arrival_rate, n), 9) AS last_arrival_rate,
    arg_max(watermark_lag, n) AS last_watermark_lag,
    (SELECT count(*) FROM tail) AS observations,
    (SELECT round(quantile_cont(lateness, 0.95), 6) FROM tail) AS lateness_percentile,
    (SELECT round(avg(CAST(out_of_order AS DOUBLE)), 6) FROM tail) AS recent_ooo_ratio
    FROM timed""",
)
def policy_snapshot(spark, d):
    run = _run(spark, d)
    return lt.policy_snapshot(run.timed, b.LATENESS)


@query(
    "ordering_metrics",
    f"""WITH {BASE} SELECT count(*) AS events, count(*) FILTER (out_of_order) AS ooo_events,
    round(count(*) FILTER (out_of_order) / count(*), 6) AS ooo_ratio,
    count(*) FILTER (inversion) AS inversions, max(lateness) AS max_lateness_seconds,
    round(CAST(sum(lateness) AS DOUBLE) / count(*), 4) AS avg_lateness_seconds FROM obs""",
)
def ordering_metrics(spark, d):
    return lt.ordering_metrics(b.observed(spark, d))


PRESSURE = f"""{BASE}, signalled AS (
  SELECT *, (n * 37) % 90000 AS state_size, (n % 1000) / 1000.0 AS memory_utilization FROM obs),
  {s.points()}, pressed AS (
  SELECT p.point, greatest({b.LATENESS.minimum}, least({b.LATENESS.maximum}, CAST(round_even(round(
    lateness_percentile + ooo_ratio * 0.20 * {b.LATENESS.maximum}
    + least(0.10 * {b.LATENESS.maximum}, p.watermark_lag * 0.10)
    + least(0.10 * {b.LATENESS.maximum}, p.arrival_rate / 1000.0)
    + least(0.10 * {b.LATENESS.maximum}, state_size / 10000.0)
    - greatest(0.0, memory_utilization - 0.70) * {b.LATENESS.maximum}, 9), 0) AS BIGINT)))
    AS budget FROM points p JOIN signalled g ON g.n = p.point)"""


@query("budget_under_pressure", f"WITH {PRESSURE} SELECT point, budget FROM pressed")
def budget_under_pressure(spark, d):
    """The budget with state and memory signals given as columns."""
    obs = b.observed(spark, d).withColumns(
        {
            "state_size": F.col("n") * 37 % 90000,
            "memory_utilization": (F.col("n") % 1000) / 1000.0,
        }
    )
    stats = lt.rolling_lateness(obs, b.LATENESS, (), "state_size", "memory_utilization")
    return stats.select("point", lt.budget_expression(b.LATENESS).alias("budget"))
