"""Scenario x mechanism matrix and its tables."""

from __future__ import annotations

from itertools import accumulate, count

from pyspark.sql import functions as F

from latewin.plans import bindings as b
from latewin.plans import matrix as mx
from latewin.plans.catalog import sql as s
from latewin.plans.catalog.registry import query
from latewin.session import scratch_dir
from latewin.sources.files import write_summary_csv

W = b.WINDOW
SOURCE = s.scenarios_arr()
BY = "scenario"


def _rows(name: str, chain: str) -> str:
    """SELECT of the summary rows of one mechanism; lossless unless category C occurs."""
    return f"""SELECT * FROM (WITH {chain}, {s.timeline(by=BY)},
  truth AS ({s.agg(W, BY, places=9)}),
  kept AS (SELECT * FROM categorized WHERE category <> 'C'),
  result AS ({s.agg(W, BY, "kept", places=9)}),
  totals AS (SELECT scenario, count(*) AS keys, count(*) FILTER (archived IS NULL) AS final_hot,
    count(*) FILTER (archived IS NOT NULL AND released IS NULL) AS final_archive,
    count(released) AS frozen FROM keys GROUP BY scenario),
  peaks AS (SELECT scenario, max(hot_peak) AS peak_hot FROM line GROUP BY scenario),
  lates AS (SELECT scenario, count(*) FILTER (category = 'B') AS reconciled,
    count(*) FILTER (category = 'C') AS late_after_eviction FROM categorized GROUP BY scenario),
  matched AS (SELECT t.scenario, count(*) AS matched_rows,
    CAST(sum({" + ".join(
        f"CASE WHEN abs(t.{f} - r.{f}) <= 1e-6 THEN 0 ELSE 1 END"
        for f in ("count", "sum", "avg", "min", "max")
    )}) AS BIGINT) AS field_mismatches
    FROM truth t JOIN result r USING (scenario, start, "DeviceId", "Sensor") GROUP BY t.scenario),
  sizes AS (SELECT t.scenario, t.c AS ground_truth_rows, r.c AS result_rows
    FROM (SELECT scenario, count(*) AS c FROM truth GROUP BY scenario) t
    JOIN (SELECT scenario, count(*) AS c FROM result GROUP BY scenario) r USING (scenario))
  SELECT scenario, '{name}' AS mechanism,
    ground_truth_rows = matched_rows AND result_rows = matched_rows AND field_mismatches = 0 AS exact,
    ground_truth_rows, result_rows, ground_truth_rows - matched_rows AS missing_in_result,
    result_rows - matched_rows AS extra_in_result, field_mismatches, peak_hot, final_hot, final_archive,
    frozen, reconciled, reconciled AS late_after_finalization, late_after_eviction,
    round((keys - peak_hot) / keys * 100, 4) AS peak_hot_reduction_percent
  FROM totals JOIN peaks USING (scenario) JOIN lates USING (scenario)
  JOIN matched USING (scenario) JOIN sizes USING (scenario))"""


_ADAPTIVE = s.lifecycle(policy=None, source=SOURCE, by=BY)
_FIXED = s.lifecycle(policy=None, fixed_seconds=3600, source=SOURCE, by=BY)
_FULL = s.lifecycle(source=SOURCE, by=BY)
_TIGHT = s.lifecycle(policy="fixed", seconds=600, source=SOURCE, by=BY)
# No watermark at all: a budget no event time can overcome.
_NONE = s.lifecycle(policy=None, fixed_seconds=10**12, source=SOURCE, by=BY)

_MECHANISMS = {
    "cmix": _NONE,
    "fixed": _FIXED,
    "aloa": _ADAPTIVE,
    "maso": _ADAPTIVE,
    "earm": _FULL,
    "full": _FULL,
    "earm_agg": _TIGHT,
}


def _all(names) -> str:
    return " UNION ALL ".join(_rows(n, _MECHANISMS[n]) for n in names)


ALL = f"all_rows AS ({_all(_MECHANISMS)})"
LADDER = f"all_rows AS ({_all(mx.LADDER)})"


def _matrix(spark, d, names=tuple(_MECHANISMS)) -> mx.Matrix:
    chosen = {n: m for n, m in b.mechanisms().items() if n in names}
    return mx.Matrix(b.observed_scenarios(spark, d), chosen, W)


@query("mechanism_matrix", f"WITH {ALL} SELECT * FROM all_rows")
def mechanism_matrix(spark, d):
    return _matrix(spark, d).summary().drop(
        "comparison_type", "events_per_second", "processing_seconds"
    )


@query(
    "mode_comparison",
    f"""WITH {LADDER} SELECT mechanism, peak_hot, final_hot, final_archive, frozen, reconciled,
    exact FROM all_rows WHERE scenario = 'heavy_ooo'""",
)
def mode_comparison(spark, d):
    """The four modes over one disorder profile."""
    events = b.observed_scenarios(spark, d).filter(F.col("scenario") == "heavy_ooo")
    chosen = {n: m for n, m in b.mechanisms().items() if n in mx.LADDER}
    return mx.Matrix(events, chosen, W).summary().select(
        "mechanism", "peak_hot", "final_hot", "final_archive", "frozen", "reconciled", "exact"
    )


@query(
    "matrix_correctness",
    f"""WITH {ALL} SELECT scenario, mechanism, exact, result_rows AS rows,
    missing_in_result AS missing, extra_in_result AS extra, field_mismatches AS field_mismatch
    FROM all_rows""",
)
def matrix_correctness(spark, d):
    return mx.correctness_table(_matrix(spark, d).summary())


@query(
    "matrix_state",
    f"""WITH {ALL} SELECT scenario, mechanism, peak_hot, final_hot, final_archive AS archive,
    frozen, reconciled, late_after_finalization, late_after_eviction,
    round(peak_hot_reduction_percent, 2) AS peak_reduction_pct FROM all_rows""",
)
def matrix_state(spark, d):
    return mx.state_table(_matrix(spark, d).summary())


def _budget_rows(name: str, chain: str) -> str:
    return f"""SELECT * FROM (WITH {chain}, b AS (
      SELECT *, lag(budget) OVER (PARTITION BY scenario ORDER BY n) AS prev FROM timed)
    SELECT scenario, '{name}' AS mechanism, count(*) AS events,
      count(*) FILTER (out_of_order) AS ooo_events,
      round(count(*) FILTER (out_of_order) / count(*), 6) AS ooo_ratio,
      count(*) FILTER (inversion) AS inversions, max(lateness) AS max_lateness_seconds,
      arg_max(budget, n) AS final_seconds, min(budget) AS minimum_seconds,
      max(budget) AS maximum_seconds, count(*) FILTER (budget <> prev) AS changes,
      round(CAST(sum(budget) AS DOUBLE) / count(*), 3) AS mean_seconds
    FROM b GROUP BY scenario)"""


_OBS = f"{SOURCE}, {s.obs(BY)}"


@query(
    "matrix_ordering",
    f"""{_budget_rows("fixed", f"{_OBS}, {s.fixed(3600, BY)}")} UNION ALL
    {_budget_rows("aloa", f"{_OBS}, {s.adaptive(by=BY)}")}""",
)
def matrix_ordering(spark, d):
    return _matrix(spark, d, ("fixed", "aloa")).ordering()


@query(
    "ablation_deltas",
    f"""WITH {LADDER}, rungs AS (SELECT *, CAST(list_position(
      ['cmix', 'aloa', 'maso', 'full'], mechanism) AS BIGINT) AS rung FROM all_rows)
    SELECT scenario, rung, mechanism, exact, peak_hot, final_archive, frozen, reconciled,
    peak_hot - lag(peak_hot) OVER w AS peak_hot_change,
    final_archive - lag(final_archive) OVER w AS final_archive_change,
    frozen - lag(frozen) OVER w AS frozen_change,
    reconciled - lag(reconciled) OVER w AS reconciled_change
    FROM rungs WINDOW w AS (PARTITION BY scenario ORDER BY rung)""",
)
def ablation_deltas(spark, d):
    return mx.ablation(_matrix(spark, d, mx.LADDER).summary())


# A clock whose steps are 1, 2, 3, ... seconds, so that SQL can repeat the times: the shared
# part takes 1 s, the first mechanism 3 s, the second 5 s.
def _scripted_clock():
    return accumulate(count()).__next__


def _timed_matrix(spark, d, names) -> mx.Matrix:
    chosen = {n: m for n, m in b.mechanisms().items() if n in names}
    return mx.Matrix(b.observed_scenarios(spark, d), chosen, W, clock=_scripted_clock())


_EVENTS = f"{SOURCE}, per AS (SELECT scenario, count(*) AS events FROM arr GROUP BY scenario)"


@query(
    "run_time_deltas",
    f"""WITH {_EVENTS}, t AS (SELECT scenario, round(events / 3.0, 2) AS old,
      round(events / 5.0, 2) AS new FROM per)
    SELECT scenario, round((6.0 - 4.0) / 4.0 * 100, 4) AS end_to_end_change_percent,
    round((5.0 - 3.0) / 3.0 * 100, 4) AS processing_change_percent,
    round((new - old) / old * 100, 4) AS throughput_change_percent FROM t""",
)
def run_time_deltas(spark, d):
    timed = _timed_matrix(spark, d, ("cmix", "full"))
    return mx.run_deltas(timed.summary(measure=True), "cmix", "full", timed.shared_seconds)


@query(
    "matrix_runtime",
    f"""SELECT r.scenario, r.mechanism, events_per_second, processing_seconds, events, ooo_events,
    ooo_ratio, inversions, max_lateness_seconds, final_seconds, minimum_seconds, maximum_seconds,
    changes, mean_seconds
    FROM (WITH {_EVENTS} SELECT scenario, mechanism, CAST(seconds AS DOUBLE) AS processing_seconds,
      round(events / seconds, 2) AS events_per_second
      FROM per, (VALUES ('cmix', 3.0), ('aloa', 5.0)) m(mechanism, seconds)) r
    LEFT JOIN ({_budget_rows("aloa", f"{_OBS}, {s.adaptive(by=BY)}")}) o
    ON r.scenario = o.scenario AND r.mechanism = o.mechanism""",
)
def matrix_runtime(spark, d):
    """One mechanism with a budget and one without."""
    timed = _timed_matrix(spark, d, ("cmix", "aloa"))
    return mx.runtime_table(timed.summary(measure=True), timed.ordering())


@query(
    "matrix_summary_csv",
    f"""WITH {ALL} SELECT scenario, 'result_vs_batch_aggregate' AS comparison_type, mechanism,
    exact, ground_truth_rows, result_rows, missing_in_result, extra_in_result, field_mismatches,
    peak_hot, final_hot, final_archive, frozen, reconciled, late_after_finalization,
    late_after_eviction, CAST(NULL AS DOUBLE) AS events_per_second,
    CAST(NULL AS DOUBLE) AS processing_seconds, peak_hot_reduction_percent FROM all_rows""",
)
def matrix_summary_csv(spark, d):
    """All 19 columns of the summary, written as CSV and read back."""
    path = scratch_dir(spark, "summary-csv")
    rows = _matrix(spark, d).summary()
    write_summary_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)
