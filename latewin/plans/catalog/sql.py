"""DuckDB common table expressions that restate the operators the plain way."""

from __future__ import annotations

from latewin.operators.disorder import SCENARIOS
from latewin.plans.bindings import CYCLE, GUARD, LATENESS, WINDOW
from latewin.schema import LatenessConfig, WindowConfig

EV = """ev AS (
  SELECT event_id AS i, CAST(floor(epoch(ts)) AS BIGINT) AS event_time,
         'D' || CAST(user_id % 3 AS VARCHAR) AS device_id, event_type AS sensor, value
  FROM events)"""


def arr(scenario: str = "heavy_ooo") -> str:
    percent = round(SCENARIOS[scenario].disorder_probability * 100)
    return f"""{EV},
hashed AS (SELECT *, (i * 1103515245 + 12345) % 2147483648 AS r FROM ev),
arr AS (
  SELECT i, event_time, device_id, sensor, value,
         row_number() OVER (
           ORDER BY i + CASE WHEN r % 100 < {percent} THEN (r // 100) % 20 ELSE 0 END, i) AS n
  FROM hashed)"""


def scenarios_arr() -> str:
    """Arrivals of every scenario, told apart by the scenario column."""
    rows = ", ".join(
        f"('{s.name}', {round(s.disorder_probability * 100)})" for s in SCENARIOS.values()
    )
    return f"""{EV},
profiles(scenario, percent) AS (VALUES {rows}),
hashed AS (SELECT *, (i * 1103515245 + 12345) % 2147483648 AS r FROM ev, profiles),
arr AS (
  SELECT scenario, i, event_time, device_id, sensor, value,
         row_number() OVER (
           PARTITION BY scenario
           ORDER BY i + CASE WHEN r % 100 < percent THEN (r // 100) % 20 ELSE 0 END, i) AS n
  FROM hashed)"""


def _part(by: str) -> str:
    return f"PARTITION BY {by} " if by else ""


def _lead(by: str) -> str:
    return f"{by}, " if by else ""


def _same(a: str, b: str, by: str) -> str:
    return f"{a}.{by} = {b}.{by} AND " if by else ""


def obs(by: str = "") -> str:
    p = _part(by)
    return f"""seen AS (
  SELECT *, max(event_time) OVER ({p}ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
              AS max_before,
         max(event_time) OVER ({p}ORDER BY n) AS max_event_time,
         first_value(event_time) OVER ({p}ORDER BY n) AS first_time,
         lag(event_time) OVER ({p}ORDER BY n) AS previous_time
  FROM arr),
obs AS (
  SELECT *, greatest(coalesce(max_before - event_time, 0), 0) AS lateness,
         coalesce(max_before > event_time, false) AS out_of_order,
         coalesce(event_time < previous_time, false) AS inversion,
         CASE WHEN n <= 1 THEN 0.0
              WHEN max_event_time - first_time <= 0 THEN CAST(n AS DOUBLE)
              ELSE n / CAST(max_event_time - first_time AS DOUBLE) END AS arrival_rate,
         CAST(max_event_time - event_time AS DOUBLE) AS watermark_lag
  FROM seen)"""


def points(cfg: LatenessConfig = LATENESS, by: str = "") -> str:
    """Valid for history = interval = min_observations, as in the bindings."""
    k, top, lead = cfg.interval, float(cfg.maximum), _lead(by)
    return f"""placed AS (SELECT *, ((n + {k - 1}) // {k}) * {k} AS point FROM obs),
points AS (
  SELECT {lead}point, quantile_cont(lateness, {cfg.cut}) AS lateness_percentile,
         avg(CAST(out_of_order AS DOUBLE)) AS ooo_ratio,
         max(CASE WHEN n = point THEN arrival_rate END) AS arrival_rate,
         max(CASE WHEN n = point THEN watermark_lag END) AS watermark_lag
  FROM placed GROUP BY {lead}point HAVING count(CASE WHEN n = point THEN 1 END) > 0),
budgets AS (
  SELECT {lead}point, greatest({cfg.minimum}, least({cfg.maximum}, CAST(round_even(round(
           lateness_percentile + ooo_ratio * 0.20 * {top}
           + least(0.10 * {top}, watermark_lag * 0.10)
           + least(0.10 * {top}, arrival_rate / 1000.0), 9), 0) AS BIGINT))) AS budget
  FROM points)"""


def adaptive(cfg: LatenessConfig = LATENESS, by: str = "") -> str:
    k = cfg.interval
    return f"""{points(cfg, by)},
budgeted AS (
  SELECT obs.*, coalesce(budgets.budget, {cfg.initial}) AS budget
  FROM obs LEFT JOIN budgets ON {_same("obs", "budgets", by)}budgets.point = (obs.n // {k}) * {k}),
{_marks(by)}"""


def fixed(seconds: int, by: str = "") -> str:
    return f"""budgeted AS (SELECT *, CAST({seconds} AS BIGINT) AS budget FROM obs),
{_marks(by)}"""


def lagged(seconds: int, by: str = "") -> str:
    """The watermark follows the maximum before each arrival."""
    p = _part(by)
    return f"""marked AS (
  SELECT *, CAST({seconds} AS BIGINT) AS budget,
    max(coalesce(max_before, event_time)) OVER ({p}ORDER BY n) - {seconds} AS watermark FROM obs),
timed AS (
  SELECT *, lag(watermark) OVER ({p}ORDER BY n) AS watermark_before FROM marked)"""


def _marks(by: str) -> str:
    p = _part(by)
    return f"""marked AS (
  SELECT *, max(max_event_time - budget) OVER ({p}ORDER BY n) AS watermark FROM budgeted),
timed AS (
  SELECT *, lag(watermark) OVER ({p}ORDER BY n) AS watermark_before FROM marked)"""


def pairs(cfg: WindowConfig = WINDOW, source: str = "timed") -> str:
    width, slide = cfg.window // cfg.slide, cfg.slide
    return f"""pairs AS (
  SELECT {source}.*, CAST(floor(event_time / {slide}.0) AS BIGINT) * {slide} - k * {slide} AS start
  FROM {source}, range({width}) AS r(k))"""


def agg(
    cfg: WindowConfig = WINDOW, by: str = "", source: str = "pairs", places: int | None = 6
) -> str:
    """SELECT of result rows over pairs."""

    def fixed(e: str) -> str:
        return e if places is None else f"round({e}, {places})"

    return f"""SELECT {_lead(by)}start, start + {cfg.window} AS "end", device_id AS "DeviceId",
  sensor AS "Sensor", count(*) AS count, {fixed("sum(value)")} AS sum,
  {fixed("sum(value) / count(*)")} AS avg, min(value) AS min, max(value) AS max
  FROM {source} GROUP BY {_lead(by)}start, device_id, sensor"""


def cycles(cycle: int = CYCLE, by: str = "") -> str:
    p, lead = _part(by), _lead(by)
    w = f"OVER ({p}ORDER BY n)"
    return f"""tracked AS (
  SELECT *, max(lateness) {w} AS max_lateness,
         greatest(0, max(CASE WHEN lateness > budget AND budget > 0 THEN lateness - budget
                              ELSE 0 END) {w}) AS max_overflow,
         max(n) OVER ({p.strip()}) AS last_n
  FROM timed),
ticks AS (
  SELECT {lead}n AS position, n AS events_seen, false AS closing,
         watermark, budget, max_lateness, max_overflow FROM tracked WHERE n % {cycle} = 0
  UNION ALL
  SELECT {lead}n + 1, n, true, watermark, budget, max_lateness, max_overflow
  FROM tracked WHERE n = last_n)"""


def guarded(policy: str, seconds: int) -> str:
    guard = (
        f"CAST({seconds} AS BIGINT)"
        if policy == "fixed"
        else "greatest(1, budget, max_lateness + 1, max_overflow + budget)"
    )
    return f"""cycles AS (SELECT *, {guard} AS guard_seconds, watermark - {guard} AS frontier
  FROM ticks)"""


def keys(
    cfg: WindowConfig = WINDOW, by: str = "", guard: bool = True, horizon: int | None = None
) -> str:
    """Key table by range joins; ``cycles`` must exist when there is a guard."""
    lead = _lead(by)
    group = f"{lead}start, device_id, sensor"
    release = (
        f"""released AS (
  SELECT {", ".join("a." + c.strip() for c in group.split(","))}, min(c.position) AS released
  FROM archived a JOIN cycles c
    ON {_same("a", "c", by)}c.position >= a.archived AND c.frontier >= a."end"
  GROUP BY ALL)"""
        if guard
        else f"released AS (SELECT {group}, CAST(NULL AS BIGINT) AS released FROM archived)"
    )
    far = ""
    pick = ""
    if horizon is not None:
        far = f""",
far AS (
  SELECT {", ".join("e." + c for c in ([by] if by else []) + ['"end"'])}, min(t.n) AS behind
  FROM ends e JOIN timed t ON {_same("e", "t", by)}t.watermark >= e."end" + {horizon}
  GROUP BY ALL)"""
        pick = """, CASE WHEN archived IS NOT NULL AND behind IS NOT NULL
         AND (released IS NULL OR greatest(archived, behind) <= released)
         THEN greatest(archived, behind) END AS offloadable"""
    using = f"({lead}start, device_id, sensor)"
    ending = f'({lead}"end")'
    return f"""opened AS (
  SELECT {group}, start + {cfg.window} AS "end", min(n) AS opened, count(*) AS count,
         round(sum(value), 6) AS sum, min(value) AS min, max(value) AS max
  FROM pairs GROUP BY {group}),
ends AS (SELECT DISTINCT {lead}"end" FROM opened),
reached AS (
  SELECT {", ".join("e." + c for c in ([by] if by else []) + ['"end"'])}, min(t.n) AS reached
  FROM ends e JOIN timed t ON {_same("e", "t", by)}t.watermark >= e."end" GROUP BY ALL),
archived AS (
  SELECT opened.*, CASE WHEN reached IS NOT NULL THEN greatest(opened, reached) END AS archived
  FROM opened LEFT JOIN reached USING {ending}),
{release}{far},
keys AS (
  SELECT archived.*, released{pick}
  FROM archived LEFT JOIN released USING {using}
  {f"LEFT JOIN far USING {ending}" if horizon is not None else ""})"""


def categories(by: str = "") -> str:
    return f"""categorized AS (
  SELECT p.*, CASE WHEN k.released IS NOT NULL AND p.n > k.released THEN 'C'
                   WHEN k.archived IS NOT NULL AND p.n > k.archived THEN 'B'
                   ELSE 'A' END AS category
  FROM pairs p JOIN keys k
    ON {_same("p", "k", by)}p.start = k.start AND p.device_id = k.device_id
   AND p.sensor = k.sensor)"""


def lifecycle(
    lateness: LatenessConfig = LATENESS,
    policy: str | None = "adaptive",
    seconds: int = GUARD,
    horizon: int | None = None,
    source: str | None = None,
    fixed_seconds: int | None = None,
    by: str = "",
    cycle: int = CYCLE,
    lag: bool = False,
) -> str:
    """Everything from the events table to keys and categorized pairs."""
    parts = [source or arr(), obs(by)]
    if fixed_seconds is not None:
        parts.append((lagged if lag else fixed)(fixed_seconds, by))
    else:
        parts.append(adaptive(lateness, by))
    parts.append(pairs())
    parts.append(cycles(cycle, by))
    if policy:
        parts.append(guarded(policy, seconds))
    parts.append(keys(by=by, guard=policy is not None, horizon=horizon))
    parts.append(categories(by))
    return ",\n".join(parts)


def timeline(asked: str | None = None, offloadable: bool = False, by: str = "") -> str:
    """``line``: tier sizes at every position where something happens or is asked."""
    lead, p = _lead(by), _part(by)
    moves = ["opened", "archived", "released"] + (["offloadable"] if offloadable else [])
    steps = [
        f"SELECT {lead}{m} AS position, '{m}' AS move FROM keys WHERE {m} IS NOT NULL"
        for m in moves
    ]
    if offloadable:
        steps.append(
            f"SELECT {lead}released, 'gone' FROM keys WHERE released IS NOT NULL "
            "AND offloadable IS NOT NULL"
        )
        moves.append("gone")
    if asked:
        steps.append(f"SELECT {lead}position, 'asked' FROM ({asked})")
    here = ", ".join(f"count(*) FILTER (move = '{m}') AS d_{m}" for m in moves)
    run = ", ".join(
        f"CAST(sum(d_{m}) OVER ({p}ORDER BY position) AS BIGINT) AS c_{m}" for m in moves
    )
    off = ", c_offloadable - c_gone + d_gone AS offloadable" if offloadable else ""
    return f"""steps AS ({" UNION ALL ".join(steps)}),
per AS (SELECT {lead}position, count(*) FILTER (move = 'asked') > 0 AS asked, {here}
  FROM steps GROUP BY {lead}position),
summed AS (SELECT *, {run} FROM per),
line AS (
  SELECT {lead}position, asked, d_opened AS newly_opened, d_archived AS newly_archived,
         d_released AS newly_released, c_opened - c_archived + d_archived AS hot_peak,
         c_opened - c_archived AS hot, c_archived - c_released + d_released AS archive_before,
         c_archived - c_released AS archive, c_released AS frozen{off}
  FROM summed)"""
