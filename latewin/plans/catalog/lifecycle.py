"""Window keys, late events, release cycles, tiers and whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from latewin.operators import lifecycle as lc
from latewin.operators.windows import KEYS, window_aggregate
from latewin.plans import bindings as b
from latewin.plans import mechanisms as m
from latewin.plans.catalog import sql as s
from latewin.plans.catalog.registry import query
from latewin.plans.run import Run

W, CYCLE, GUARD = b.WINDOW, b.CYCLE, b.GUARD
HORIZON = 2 * GUARD
FULL = s.lifecycle()
HELD = s.lifecycle(horizon=HORIZON)
TIGHT = s.lifecycle(b.TIGHT, "fixed", 600)
FIXED = s.lifecycle(policy=None, fixed_seconds=3600)
ALOA = s.lifecycle(policy=None)


def full(spark, d, horizon=None) -> Run:
    return Run(b.observed(spark, d), b.mechanisms()["full"], W, horizon=horizon)


def tight(spark, d) -> Run:
    """Small budgets and a small fixed guard, so that every category occurs."""
    return Run(b.observed(spark, d), b.mechanisms(b.TIGHT)["earm_agg"], W)


KEY_COLUMNS = f'start, "end", device_id, sensor, count, round(sum, 6) AS sum, min, max, opened'


@query(
    "lifecycle_keys", f"WITH {FULL} SELECT {KEY_COLUMNS}, archived, released FROM keys"
)
def lifecycle_keys(spark, d):
    return full(spark, d).keys.withColumn("sum", F.round("sum", 6))


@query(
    "lifecycle_keys_tight", f"WITH {TIGHT} SELECT {KEY_COLUMNS}, archived, released FROM keys"
)
def lifecycle_keys_tight(spark, d):
    return tight(spark, d).keys.withColumn("sum", F.round("sum", 6))


TIGHT_ADAPTIVE = s.lifecycle(b.TIGHT, "adaptive", GUARD)


@query(
    "lifecycle_keys_adaptive_tight",
    f"WITH {TIGHT_ADAPTIVE} SELECT {KEY_COLUMNS}, archived, released FROM keys",
)
def lifecycle_keys_adaptive_tight(spark, d):
    """Small budgets under the adaptive guard: keys that open behind the frontier."""
    run = Run(b.observed(spark, d), b.mechanisms(b.TIGHT)["full"], W)
    return run.keys.withColumn("sum", F.round("sum", 6))


CATEGORY_COUNTS = """SELECT count(*) AS pairs, count(*) FILTER (category = 'A') AS on_time_pairs,
  count(*) FILTER (category = 'B') AS reconciled_events,
  count(*) FILTER (category = 'B') AS late_after_finalization,
  count(*) FILTER (category = 'C') AS late_after_eviction FROM categorized"""


@query("late_categories", f"WITH {TIGHT} {CATEGORY_COUNTS}")
def late_categories(spark, d):
    return tight(spark, d).late


@query(
    "late_pairs",
    f"""WITH {TIGHT} SELECT n, start, device_id, sensor, category FROM categorized
    WHERE category <> 'A'""",
)
def late_pairs(spark, d):
    run = tight(spark, d)
    pairs = lc.late_pairs(run.timed, run.keys, W).filter("category <> 'A'")
    return pairs.select("n", "start", *KEYS, "category")


@query(
    "classify_pairs",
    f"WITH {TIGHT} SELECT n, start, device_id, sensor, value, category FROM categorized",
)
def classify_pairs(spark, d):
    run = tight(spark, d)
    return lc.classify_pairs(run.timed, run.keys, W).select(
        "n", "start", *KEYS, "value", "category"
    )


@query(
    "finalization_audit",
    f"""WITH {FULL}, firsts AS (SELECT * FROM keys WHERE archived IS NOT NULL)
    SELECT start, "end", k.device_id, k.sensor, archived,
    watermark AS finalized_at_watermark, budget AS budget_seconds
    FROM firsts k JOIN timed t ON t.n = k.archived""",
)
def finalization_audit(spark, d):
    run = full(spark, d)
    return lc.finalization_audit(run.timed, run.keys)


@query(
    "evictable",
    f"""WITH {ALOA} SELECT start, "end", device_id, sensor, archived FROM keys
    WHERE archived IS NOT NULL AND "end" + {GUARD} <= (SELECT max(watermark) FROM timed)""",
)
def evictable(spark, d):
    run = Run(b.observed(spark, d), b.mechanisms()["aloa"], W)
    now = run.timed.agg(F.max("watermark")).scalar()
    return lc.evictable(run.keys, now, GUARD).select("start", "end", *KEYS, "archived")


@query(
    "frozen_rows",
    f"""WITH {TIGHT}, kept AS (SELECT c.* FROM categorized c JOIN keys k
      USING (start, device_id, sensor) WHERE category <> 'C' AND released IS NOT NULL)
    {s.agg(source="kept")}""",
)
def frozen_rows(spark, d):
    run = tight(spark, d)
    rows = lc.frozen_rows(run.timed, run.keys, W)
    return rows.withColumns({c: F.round(c, 6) for c in ("sum", "avg")})


@query(
    "guard_series",
    f"""WITH {FULL} SELECT position, events_seen, closing, watermark, budget, max_lateness,
    max_overflow, guard_seconds, frontier FROM cycles""",
)
def guard_series(spark, d):
    return full(spark, d).cycles.drop("ordinal")


EVICTED = """evicted AS (SELECT released AS position, count(*) AS evicted FROM keys
  WHERE released IS NOT NULL GROUP BY released)"""


@query(
    "eviction_cycles",
    f"""WITH {FULL}, {EVICTED} SELECT position, events_seen, closing, guard_seconds,
    coalesce(evicted, 0) AS evictable_candidates, coalesce(evicted, 0) AS evicted
    FROM cycles LEFT JOIN evicted USING (position)""",
)
def eviction_cycles(spark, d):
    run = full(spark, d)
    return lc.eviction_cycles(run.keys, run.cycles)


@query(
    "retention_snapshot",
    f"""WITH {FULL}, recent AS (SELECT * FROM cycles ORDER BY position DESC LIMIT 256)
    SELECT 'adaptive' AS guard_policy, CAST({GUARD} AS BIGINT) AS configured_guard_seconds,
    arg_max(guard_seconds, position) AS effective_guard_seconds,
    max(max_lateness) AS observed_max_lateness, max(max_overflow) AS observed_max_overflow,
    count(*) AS eviction_cycles,
    (SELECT round(CAST(sum(guard_seconds) AS DOUBLE) / count(*), 2) FROM recent)
      AS mean_guard_seconds,
    (SELECT count(released) FROM keys) AS evicted_entries FROM cycles""",
)
def retention_snapshot(spark, d):
    run = full(spark, d)
    return lc.retention_snapshot(run.keys, run.cycles, run.mech.guard)


@query(
    "tier_timeline",
    f"""WITH {FULL}, {s.timeline("SELECT n AS position FROM timed")}
    SELECT position AS n, hot, archive, frozen FROM line WHERE asked""",
)
def tier_timeline(spark, d):
    run = full(spark, d)
    asked = run.timed.select(F.col("n").alias("position"))
    return lc.tier_timeline(run.keys, asked).filter("asked").select(
        F.col("position").alias("n"), "hot", "archive", "frozen"
    )


@query(
    "peak_hot",
    f"""WITH {FULL}, {s.timeline()}
    SELECT max(hot_peak) AS peak_hot, max(hot) AS peak_active FROM line""",
)
def peak_hot(spark, d):
    return lc.peak_hot(full(spark, d).keys)


TOTALS = """totals AS (SELECT count(*) AS keys, count(*) FILTER (archived IS NULL) AS final_hot,
  count(*) FILTER (archived IS NOT NULL AND released IS NULL) AS final_archive,
  count(released) AS frozen, count(archived) AS finalized_windows,
  count(archived) AS evicted_state_entries FROM keys),
peaks AS (SELECT max(hot_peak) AS peak_hot, max(hot) AS peak_active FROM line)"""


@query(
    "tier_totals",
    f"""WITH {FULL}, {s.timeline()}, {TOTALS}
    SELECT *, final_hot + final_archive AS final_total,
    peak_active + final_archive AS peak_total FROM totals, peaks""",
)
def tier_totals(spark, d):
    return full(spark, d).totals


ACCOUNTING = f"""{HELD}, {s.timeline("SELECT position FROM ticks", offloadable=True)},
sized AS (
  SELECT t.*, row_number() OVER (ORDER BY position) AS k, l.hot AS hot_entries,
         l.archive_before AS archive_entries, l.hot + l.archive_before AS total_entries,
         l.offloadable
  FROM ticks t JOIN line l USING (position)),
accounting AS (
  SELECT *, last_value(CASE WHEN closing OR (k - 1) % 10 = 0 THEN offloadable END IGNORE NULLS)
           OVER (ORDER BY position) AS offloadable_entries FROM sized)"""


def _accounting(spark, d):
    run = full(spark, d, HORIZON)
    return lc.accounting_cycles(run.timed, run.keys, CYCLE)


@query(
    "accounting_cycles",
    f"""WITH {ACCOUNTING} SELECT position, events_seen, closing, hot_entries, archive_entries,
    total_entries, offloadable_entries FROM accounting""",
)
def accounting_cycles(spark, d):
    return _accounting(spark, d).drop("ordinal")


@query(
    "accounting_snapshot",
    f"""WITH {ACCOUNTING}, recent AS (SELECT * FROM accounting ORDER BY position DESC LIMIT 512)
    SELECT CAST({CYCLE} AS BIGINT) AS cycle_events,
    CAST({HORIZON} AS BIGINT) AS retention_horizon_seconds, count(*) AS compaction_cycles,
    max(hot_entries) AS peak_hot_entries, max(archive_entries) AS peak_archive_entries,
    max(total_entries) AS peak_total_entries,
    arg_max(offloadable_entries, position) AS final_offloadable_entries,
    arg_max(hot_entries, position) AS final_hot_entries,
    arg_max(archive_entries, position) AS final_archive_entries,
    (SELECT round(CAST(sum(hot_entries) AS DOUBLE) / count(*), 2) FROM recent) AS mean_hot_entries,
    (SELECT round(CAST(sum(archive_entries) AS DOUBLE) / count(*), 2) FROM recent)
      AS mean_archive_entries FROM accounting""",
)
def accounting_snapshot(spark, d):
    return lc.accounting_snapshot(_accounting(spark, d), CYCLE, HORIZON)


@query(
    "memory_signal",
    f"""WITH {ACCOUNTING}, p AS (SELECT *, max(total_entries) OVER (ORDER BY position) AS peak
      FROM accounting)
    SELECT position, total_entries, peak AS peak_total_entries,
    CASE WHEN total_entries <= 0 THEN 0.0
         ELSE round(least(1.0, total_entries / (peak * 1.5)), 9) END AS memory_utilization
    FROM p""",
)
def memory_signal(spark, d):
    return lc.memory_signal(_accounting(spark, d)).select(
        "position",
        "total_entries",
        "peak_total_entries",
        F.round("memory_utilization", 9).alias("memory_utilization"),
    )


@query(
    "offloadable",
    f"""WITH {HELD} SELECT start, "end", device_id, sensor, archived, released, offloadable
    FROM keys WHERE offloadable IS NOT NULL""",
)
def offloadable(spark, d):
    keys = full(spark, d, HORIZON).keys
    return keys.filter("offloadable is not null").select(
        "start", "end", *KEYS, "archived", "released", "offloadable"
    )


@query(
    "state_reduction",
    f"""WITH {FULL}, {s.timeline()}, {TOTALS}
    SELECT keys > 0 AS available, keys AS baseline_peak_hot, peak_hot AS adaptive_peak_hot,
    round((keys - peak_hot) / keys * 100, 4) AS peak_hot_reduction_percent,
    round((keys - final_hot) / keys * 100, 4) AS final_hot_reduction_percent
    FROM totals, peaks""",
)
def state_reduction(spark, d):
    """Against full retention, whose peak is the number of keys."""
    return lc.state_reduction(full(spark, d).totals, F.col("keys"))


CONTROL = f"""{FULL}, {s.timeline("SELECT n AS position FROM timed")},
control AS (
  SELECT n AS event_number, event_time, lateness AS lateness_seconds,
         budget AS allowed_lateness_seconds, lateness <= budget AS within_budget, watermark,
         newly_archived AS newly_finalized, hot - newly_opened + newly_archived
           AS state_size_before, hot AS state_size_after,
         newly_opened - newly_archived AS state_growth, out_of_order,
         archive AS archive_entries, frozen AS frozen_entries
  FROM timed JOIN line ON line.position = timed.n)"""


@query("control_log", f"WITH {CONTROL} SELECT * FROM control")
def control_log(spark, d):
    run = full(spark, d)
    return lc.control_log(run.timed, run.keys)


@query(
    "state_summary",
    f"""WITH {CONTROL} SELECT arg_min(state_size_after, event_number) AS initial_entries,
    max(state_size_after) AS maximum_entries,
    arg_max(state_size_after, event_number) AS final_entries,
    round(avg(state_size_after), 6) AS average_entries,
    CAST(sum(newly_finalized) AS BIGINT) AS finalized_windows FROM control""",
)
def state_summary(spark, d):
    run = full(spark, d)
    return lc.state_summary(lc.control_log(run.timed, run.keys))


@query(
    "trajectory",
    f"""WITH {CONTROL} SELECT * FROM control WHERE event_number % 500 = 0
    OR event_number = (SELECT max(event_number) FROM control)""",
)
def trajectory(spark, d):
    """Every 500th arrival and the last (the decimation is the feature)."""
    run = full(spark, d)
    return lc.trajectory(run.timed, run.keys, 500)


# -- whole runs ---------------------------------------------------------------------


def _kept(chain: str) -> str:
    return f"{chain}, kept AS (SELECT * FROM categorized WHERE category <> 'C')"


def _round(rows):
    return rows.withColumns({c: F.round(c, 6) for c in ("sum", "avg")})


def _result_query(name: str, sql: str, lateness=b.LATENESS):
    @query(f"mechanism_result_{name}", sql)
    def run(spark, d):
        mech = b.mechanisms(lateness)[name]
        events = b.arrivals(spark, d) if mech.guard is None else b.observed(spark, d)
        return _round(Run(events, mech, W).result)

    return run


PLAIN = f"WITH {s.arr()}, {s.pairs(W, 'arr')} {s.agg()}"
_result_query("cmix", PLAIN)


def _held_query(name: str, chain: str, lateness, extra: str = ""):
    """A mechanism that releases nothing, executed: every row with its state at the end."""

    @query(
        f"mechanism_result_{name}",
        f"""WITH {chain}, rows AS ({s.agg(source="categorized")})
        SELECT r.*, CASE WHEN archived IS NOT NULL THEN 'archive' ELSE 'hot' END AS tier,
          opened, archived{extra}
        FROM rows r JOIN keys k ON k.start = r.start AND k.device_id = r."DeviceId"
         AND k.sensor = r."Sensor" """,
    )
    def run(spark, d):
        return _round(Run(b.observed(spark, d), b.mechanisms(lateness)[name], W).held)

    return run


_held_query("fixed", FIXED, b.LATENESS)
_held_query("fixed_lagged", s.lifecycle(policy=None, fixed_seconds=3600, lag=True), b.LATENESS)
_held_query("aloa", ALOA, b.LATENESS)
_held_query(
    "maso",
    s.lifecycle(b.TIGHT, policy=None),
    b.TIGHT,
    ", (SELECT count(*) FROM ticks c WHERE c.position >= opened) AS accounted_cycles",
)
_result_query("earm", f"WITH {_kept(FULL)} {s.agg(source='kept')}")
_result_query("full", f"WITH {_kept(FULL)} {s.agg(source='kept')}")
_result_query("earm_agg", f"WITH {_kept(TIGHT)} {s.agg(source='kept')}", b.TIGHT)


@query(
    "tier_union",
    f"""WITH {_kept(FULL)}, rows AS ({s.agg(source="kept")})
    SELECT r.*, CASE WHEN released IS NOT NULL THEN 'frozen'
      WHEN archived IS NOT NULL THEN 'archive' ELSE 'hot' END AS tier
    FROM rows r JOIN keys k ON k.start = r.start AND k.device_id = r."DeviceId"
     AND k.sensor = r."Sensor" """,
)
def tier_union(spark, d):
    """Rows of the three tiers laid over each other, with the tier that won."""
    run = full(spark, d)
    return _round(m.union_of_tiers(m.result_by_tier(run.timed, run.keys, W)))


def _snapshot_sql(chain: str) -> str:
    return f"""WITH {chain}, {s.timeline()}, {TOTALS}
    SELECT final_hot AS state_entries,
    (SELECT max(max_event_time) FROM timed) AS max_event_time,
    (SELECT arg_max(budget, n) FROM timed) AS allowed_lateness_seconds,
    (SELECT max(watermark) FROM timed) AS watermark,
    (SELECT count(*) FILTER (watermark_before IS NULL OR watermark > watermark_before)
       FROM timed) AS watermark_updates,
    final_hot AS active_state_entries, final_archive AS finalized_state_entries,
    peak_hot AS peak_active_state_entries, peak_active AS peak_active_after_archiving,
    finalized_windows, evicted_state_entries,
    (SELECT count(*) FROM categorized WHERE category = 'B') AS reconciled_events,
    (SELECT count(*) FROM categorized WHERE category = 'B') AS late_after_finalization,
    (SELECT count(*) FROM timed WHERE lateness > budget) AS over_budget_events,
    frozen AS frozen_emissions,
    (SELECT count(*) FROM categorized WHERE category = 'C') AS late_after_eviction,
    frozen AS frozen_keys_size, finalized_windows AS finalization_audit_records,
    keys AS total_keys FROM totals, peaks"""


@query("run_snapshot", _snapshot_sql(FULL))
def run_snapshot(spark, d):
    return full(spark, d).snapshot


@query("run_snapshot_tight", _snapshot_sql(TIGHT))
def run_snapshot_tight(spark, d):
    return tight(spark, d).snapshot


@query("run_snapshot_fixed", _snapshot_sql(FIXED))
def run_snapshot_fixed(spark, d):
    return Run(b.observed(spark, d), b.mechanisms()["fixed"], W).snapshot
