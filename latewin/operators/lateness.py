"""Lateness observations, the adaptive budget and the monotonic watermark."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latewin.operators.ordering import BLOCK_ROWS, POINT_BLOCK, running, with_run_value
from latewin.schema import LatenessConfig


def _blocked(events: DataFrame) -> DataFrame:
    if "block" in events.columns:
        return events
    return events.withColumn("block", F.floor((F.col("n") - 1) / BLOCK_ROWS))


def arrival_lateness(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``max_before``, ``max_event_time``, ``lateness`` and ``out_of_order``.

    Lateness is measured against the largest event time of earlier arrivals.
    """
    t = F.col("event_time")
    out = running(
        _blocked(events), "n", "block", {"max_before": (t, "max")}, by, inclusive=False
    )
    return _late(out)


def _late(out: DataFrame) -> DataFrame:
    t, before = F.col("event_time"), F.col("max_before")
    late = F.greatest(F.coalesce(before - t, F.lit(0)), F.lit(0)).cast("long")
    return out.withColumns(
        {"max_event_time": F.greatest(before, t), "lateness": late, "out_of_order": late > 0}
    )


def observe_lateness(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`arrival_lateness` plus ``first_time``, ``arrival_rate`` and ``watermark_lag``.

    The rate divides by the event-time span since the first *arrival*.
    """
    t = F.col("event_time")
    out = running(
        _blocked(events),
        "n",
        "block",
        {"max_before": (t, "max"), "_first": (t, "first")},
        by,
        inclusive=False,
    )
    return _observed(out)


def observe_arrivals(
    df: DataFrame, order: Sequence[str], block: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Arrival index, observations and ``previous_time`` in one scan, for rows not numbered yet.

    ``order`` is a total order and ``block`` a non-decreasing function of it, as
    for the arrival index; both come from the same block summaries.
    """
    t = F.col("event_time")
    out = running(
        df.withColumn("block", block),
        F.struct(*order),
        "block",
        {
            "_before": (F.lit(1).cast("long"), "sum"),
            "max_before": (t, "max"),
            "_first": (t, "first"),
            "previous_time": (t, "last"),
        },
        by,
        inclusive=False,
    )
    numbered = out.withColumn("n", F.coalesce("_before", F.lit(0)).cast("long") + 1)
    return _observed(numbered.drop("_before"))


def _observed(out: DataFrame) -> DataFrame:
    t, n = F.col("event_time"), F.col("n")
    out = _late(out).withColumn("first_time", F.coalesce(F.col("_first"), t)).drop("_first")
    span = F.col("max_event_time") - F.col("first_time")
    rate = (
        F.when(n <= 1, F.lit(0.0))
        .when(span <= 0, n.cast("double"))
        .otherwise(n / span.cast("double"))
    )
    lag = F.greatest(F.col("max_event_time") - t, F.lit(0)).cast("double")
    return out.withColumns({"arrival_rate": rate, "watermark_lag": lag})


def with_disorder_counts(obs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the running out-of-order count and ratio."""
    out = running(
        obs, "n", "block", {"ooo_seen": (F.col("out_of_order").cast("long"), "sum")}, by
    )
    return out.withColumn("ooo_ratio", F.col("ooo_seen") / F.col("n"))


def inversions(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``previous_time`` and ``inversion``: earlier than the arrival just before.

    A ``previous_time`` that is there already is used and costs no scan.
    """
    t = F.col("event_time")
    out = events
    if "previous_time" not in events.columns:
        out = running(
            _blocked(events), "n", "block", {"previous_time": (t, "last")}, by, inclusive=False
        )
    return out.withColumn("inversion", F.coalesce(t < F.col("previous_time"), F.lit(False)))


def observe_order(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`arrival_lateness` and :func:`inversions` in one scan.

    Observations made earlier, as by :func:`observe_arrivals`, are used as they are.
    """
    if {"lateness", "previous_time"} <= set(events.columns):
        return inversions(events, by)
    t = F.col("event_time")
    out = running(
        _blocked(events),
        "n",
        "block",
        {"max_before": (t, "max"), "previous_time": (t, "last")},
        by,
        inclusive=False,
    )
    return inversions(_late(out), by)


def budget_point(n: Column, cfg: LatenessConfig) -> Column:
    """The recalculation point in force at arrival n; 0 before the first one."""
    step = F.greatest(
        F.lit(cfg.min_observations), n - F.pmod(n, F.lit(cfg.interval))
    )
    return F.when(n < cfg.min_observations, F.lit(0)).otherwise(step).cast("long")


def _aligned(cfg: LatenessConfig) -> bool:
    """Every arrival is in the history of exactly one recalculation point."""
    return cfg.history == cfg.interval and cfg.min_observations % cfg.interval == 0


def _point_groups(
    obs: DataFrame,
    cfg: LatenessConfig,
    by: Sequence[str],
    state_size: str | None,
    memory_utilization: str | None,
) -> DataFrame:
    """One row per recalculation point over the arrivals of its history; the columns
    ``_reached_*`` only where histories do not overlap."""
    n = F.col("n")
    narrow = obs.select(
        *by,
        "n",
        "lateness",
        F.col("out_of_order").cast("double").alias("ooo"),
        "arrival_rate",
        "watermark_lag",
        "max_event_time",
        (F.col(state_size) if state_size else F.lit(0)).cast("double").alias("state_size"),
        (F.col(memory_utilization) if memory_utilization else F.lit(0.0))
        .cast("double")
        .alias("memory_utilization"),
    )
    if not _aligned(cfg):
        return _merged_histories(narrow, cfg, by)
    placed = narrow.withColumn("point", (F.ceil(n / cfg.interval) * cfg.interval).cast("long"))

    def at_point(c: str) -> Column:
        return F.max(F.when(n == F.col("point"), F.col(c))).alias(c)

    return placed.groupBy(*by, "point").agg(
        F.percentile("lateness", F.lit(cfg.cut)).alias("lateness_percentile"),
        F.avg("ooo").alias("ooo_ratio"),
        at_point("arrival_rate"),
        at_point("watermark_lag"),
        at_point("state_size"),
        at_point("memory_utilization"),
        F.max(F.when(n < F.col("point"), F.col("max_event_time"))).alias("_reached_before"),
        F.max(F.when(n == F.col("point"), F.col("max_event_time"))).alias("_reached_at"),
    )


def _histogram_percentile(entries: Column, total: Column, cut: float) -> Column:
    """Interpolated percentile of ``total`` values given as (lateness, count) entries."""
    position = F.lit(cut) * (total - 1)
    low, high = F.floor(position), F.ceil(position)

    def step(acc: Column, entry: Column) -> Column:
        seen = acc["seen"] + entry["count"]

        def at(rank: Column, name: str) -> Column:
            here = (acc["seen"] <= rank) & (rank < seen)
            return F.when(here, entry["lateness"]).otherwise(acc[name]).alias(name)

        return F.struct(seen.alias("seen"), at(low, "low"), at(high, "high"))

    none = F.lit(0).cast("long")
    start = F.struct(none.alias("seen"), none.alias("low"), none.alias("high"))
    found = F.aggregate(F.array_sort(entries), start, step)
    return found["low"] + (found["high"] - found["low"]) * (position - low)


def _merged_histories(narrow: DataFrame, cfg: LatenessConfig, by: Sequence[str]) -> DataFrame:
    """One row per recalculation point for any history: arrivals are counted by lateness once, in
    panes that no history cuts, and the panes' histograms are merged over each history.

    Panes are scanned in stretches; a stretch also gets the panes before it that its first
    histories reach into, so neither arrivals nor panes are copied to every point.
    """
    n = F.col("n")
    size = math.gcd(cfg.interval, cfg.history, cfg.min_observations)
    reach = cfg.history // size
    length = max(BLOCK_ROWS // size, reach)
    signals = ["arrival_rate", "watermark_lag", "state_size", "memory_utilization"]
    pane = F.floor((n - 1) / size)
    last = [F.max(F.when(n % size == 0, F.col(c))).alias(c) for c in signals]
    panes = (
        narrow.groupBy(*by, pane.alias("pane"), "lateness")
        .agg(F.count(F.lit(1)).alias("count"), F.sum("ooo").alias("ooo"), *last)
        .groupBy(*by, "pane")
        .agg(
            F.collect_list(F.struct("lateness", "count")).alias("entries"),
            F.sum("count").alias("count"),
            F.sum("ooo").alias("ooo"),
            *[F.max(c).alias(c) for c in signals],
        )
    )
    own = F.floor(F.col("pane") / length)
    touched = F.array_distinct(F.array(own, F.floor((F.col("pane") + (reach - 1)) / length)))
    history = (
        Window.partitionBy(*by, "_stretch").orderBy("pane").rangeBetween(-(reach - 1), 0)
    )
    point = ((F.col("pane") + 1) * size).cast("long")
    is_point = (point == cfg.min_observations) | (
        (point > cfg.min_observations) & (point % cfg.interval == 0)
    )
    merged = (
        panes.withColumn("_stretch", F.explode(touched))
        .select(
            *by,
            "pane",
            "_stretch",
            *signals,
            F.flatten(F.collect_list("entries").over(history)).alias("entries"),
            F.sum("count").over(history).alias("count"),
            F.sum("ooo").over(history).alias("ooo"),
        )
        .filter((own == F.col("_stretch")) & is_point)
    )
    return merged.select(
        *by,
        point.alias("point"),
        _histogram_percentile(F.col("entries"), F.col("count"), cfg.cut).alias(
            "lateness_percentile"
        ),
        (F.col("ooo") / F.col("count")).alias("ooo_ratio"),
        *signals,
    )


def rolling_lateness(
    obs: DataFrame,
    cfg: LatenessConfig = LatenessConfig(),
    by: Sequence[str] = (),
    state_size: str | None = None,
    memory_utilization: str | None = None,
) -> DataFrame:
    """Per recalculation point: lateness percentile and out-of-order ratio of the last
    ``history`` arrivals, and the signals seen by the arrival at the point itself."""
    groups = _point_groups(obs, cfg, by, state_size, memory_utilization)
    return groups.filter(
        F.col("arrival_rate").isNotNull() & (F.col("point") >= cfg.min_observations)
    ).drop("_reached_before", "_reached_at")


def budget_expression(cfg: LatenessConfig) -> Column:
    """Bounded budget in whole seconds from the rolling signals, half-even rounded.

    Rounded to 9 places first, so that last-bit noise cannot decide a tie.
    """
    top = float(cfg.maximum)
    cap = F.lit(0.10 * top)
    raw = (
        F.col("lateness_percentile")
        + F.col("ooo_ratio") * F.lit(0.20) * F.lit(top)
        + F.least(cap, F.greatest(F.col("watermark_lag"), F.lit(0.0)) * 0.10)
        + F.least(cap, F.greatest(F.col("arrival_rate"), F.lit(0.0)) / 1000.0)
        + F.least(cap, F.greatest(F.col("state_size"), F.lit(0.0)) / 10000.0)
        - F.greatest(
            F.least(F.col("memory_utilization"), F.lit(1.0)) - 0.70, F.lit(0.0)
        )
        * top
    )
    whole = F.bround(F.round(raw, 9), 0).cast("long")
    return F.greatest(F.lit(cfg.minimum), F.least(F.lit(cfg.maximum), whole)).cast("long")


def adaptive_budget(
    obs: DataFrame,
    cfg: LatenessConfig = LatenessConfig(),
    by: Sequence[str] = (),
    state_size: str | None = None,
    memory_utilization: str | None = None,
) -> DataFrame:
    """Budget table, one row per recalculation point in force (0 = the initial budget).

    ``watermark_before`` is the watermark reached before the point's first arrival.
    """
    by = list(by)
    decided = (
        F.col("arrival_rate").isNotNull() & (F.col("point") >= cfg.min_observations)
    )
    budget = F.when(decided, budget_expression(cfg))
    if _aligned(cfg):
        # The arrivals before a point belong to the period of the point before, so
        # one pass over the events gives both the budgets and how far each reached.
        groups = _point_groups(obs, cfg, by, state_size, memory_utilization)
        sides = F.explode(
            F.array(
                F.struct(
                    (F.col("point") - cfg.interval).alias("at"),
                    F.col("_reached_before").alias("reached"),
                    F.lit(None).cast("long").alias("budget"),
                ),
                F.struct(
                    F.col("point").alias("at"),
                    F.col("_reached_at").alias("reached"),
                    budget.alias("budget"),
                ),
            )
        )
        table = (
            groups.select(*by, sides.alias("s"))
            .select(*by, "s.*")
            .filter("reached is not null")
            .groupBy(*by, budget_point(F.col("at"), cfg).alias("point"))
            .agg(F.max("reached").alias("reached"), F.max("budget").alias("budget"))
        )
    else:
        stats = rolling_lateness(obs, cfg, by, state_size, memory_utilization)
        stats = stats.select(*by, "point", budget_expression(cfg).alias("budget"))
        in_force = obs.groupBy(*by, budget_point(F.col("n"), cfg).alias("point")).agg(
            F.max("max_event_time").alias("reached")
        )
        table = in_force.join(stats, [*by, "point"], "left")
    table = table.withColumn("budget", F.coalesce("budget", F.lit(cfg.initial)).cast("long"))
    return running(
        table,
        "point",
        F.floor(F.col("point") / (cfg.interval * POINT_BLOCK)),
        {"watermark_before": (F.col("reached") - F.col("budget"), "max")},
        by,
        inclusive=False,
    ).drop("reached")


def adaptive_watermark(
    obs: DataFrame,
    budgets: DataFrame,
    cfg: LatenessConfig = LatenessConfig(),
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``budget``, ``watermark`` and ``watermark_before`` (that of the arrival before).

    ``budgets`` is the table of :func:`adaptive_budget`. Inside one budget period
    the watermark follows the largest event time, so only the periods, not the
    events, need a running maximum.
    """
    by = list(by)
    joined = obs.withColumn("point", budget_point(F.col("n"), cfg)).join(
        budgets, [*by, "point"]
    )
    entering = F.col("watermark_before")
    return joined.withColumns(
        {
            "watermark": F.greatest(F.col("max_event_time") - F.col("budget"), entering),
            "watermark_before": F.when(F.col("n") == F.col("point"), entering).otherwise(
                F.greatest(F.col("max_before") - F.col("budget"), entering)
            ),
        }
    ).drop("point")


def fixed_watermark(
    obs: DataFrame, seconds: int, by: Sequence[str] = (), lagged: bool = False
) -> DataFrame:
    """The same columns for a constant budget.

    With ``lagged`` the watermark at n uses the maximum before arrival n.
    """
    if seconds < 0:
        raise ValueError("fixed lateness must not be negative")
    out = obs.withColumn("budget", F.lit(seconds).cast("long"))
    if not lagged:
        return out.withColumns(
            {
                "watermark": F.col("max_event_time") - F.col("budget"),
                "watermark_before": F.col("max_before") - F.col("budget"),
            }
        )
    out = out.withColumn(
        "watermark", F.coalesce("max_before", "event_time") - F.col("budget")
    )
    return running(
        out, "n", "block", {"watermark_before": (F.col("watermark"), "max")}, by, False
    )


def over_budget() -> Column:
    return F.col("lateness") > F.col("budget")


def budget_split(timed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Events within and over their budget."""
    over = F.sum(over_budget().cast("long"))
    total = F.count(F.lit(1))
    return timed.groupBy(*by).agg(
        (total - over).alias("within_budget_events"),
        over.alias("over_budget_events"),
        F.round((total - over) / total, 6).alias("within_budget_ratio"),
        F.round(over / total, 6).alias("over_budget_ratio"),
    )


def budget_report(
    timed: DataFrame,
    cfg: LatenessConfig = LatenessConfig(),
    by: Sequence[str] = (),
    source: str = "adaptive",
) -> DataFrame:
    """First, last, extreme and mean budget, and how often it changed.

    A budget only changes where the recalculation point does, so changes are
    counted over the points.
    """
    by = list(by)
    points = timed.groupBy(*by, budget_point(F.col("n"), cfg).alias("point")).agg(
        F.max("budget").alias("budget"), F.count(F.lit(1)).alias("events")
    )
    points = running(
        points,
        "point",
        F.floor(F.col("point") / (cfg.interval * POINT_BLOCK)),
        {"before": (F.col("budget"), "last")},
        by,
        inclusive=False,
    )
    changed = F.coalesce((F.col("budget") != F.col("before")).cast("long"), F.lit(0))
    initial = F.lit(cfg.initial).cast("long") if source == "adaptive" else F.min("budget")
    return points.groupBy(*by).agg(
        F.lit(source).alias("source"),
        initial.alias("configured_initial_seconds"),
        F.min_by("budget", "point").alias("first_calculated_seconds"),
        F.max_by("budget", "point").alias("final_seconds"),
        F.min("budget").alias("minimum_seconds"),
        F.max("budget").alias("maximum_seconds"),
        F.sum(changed).alias("changes"),
        F.round(F.sum(F.col("budget") * F.col("events")) / F.sum("events"), 3).alias(
            "mean_seconds"
        ),
    )


def watermark_updates(timed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How often the watermark was set or advanced, and its ends."""
    moved = F.col("watermark_before").isNull() | (
        F.col("watermark") > F.col("watermark_before")
    )
    return timed.groupBy(*by).agg(
        F.sum(moved.cast("long")).alias("watermark_updates"),
        F.min("watermark").alias("first_watermark"),
        F.max("watermark").alias("final_watermark"),
        F.max("max_event_time").alias("max_event_time"),
    )


def ordering_metrics(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Out-of-order, inversion and lateness totals of a run."""
    obs = observe_order(events, by)
    total = F.count(F.lit(1))
    ooo = F.sum(F.col("out_of_order").cast("long"))
    return obs.groupBy(*by).agg(
        total.alias("events"),
        ooo.alias("ooo_events"),
        F.round(ooo / total, 6).alias("ooo_ratio"),
        F.sum(F.col("inversion").cast("long")).alias("inversions"),
        F.max("lateness").alias("max_lateness_seconds"),
        F.round(F.sum("lateness") / total, 4).alias("avg_lateness_seconds"),
    )


def policy_replay(timed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What the budget policy alone does over a stream."""
    total = F.count(F.lit(1))
    ooo = F.sum(F.col("out_of_order").cast("long"))
    return timed.groupBy(*by).agg(
        total.alias("events"),
        ooo.alias("ooo_events"),
        F.round(ooo / total, 6).alias("ooo_ratio"),
        F.max("lateness").alias("max_lateness_seconds"),
        F.min("budget").alias("minimum_budget_seconds"),
        F.max("budget").alias("maximum_budget_seconds"),
        F.max_by("budget", "n").alias("final_budget_seconds"),
    )


def policy_snapshot(timed: DataFrame, cfg: LatenessConfig = LatenessConfig()) -> DataFrame:
    """State of controller and policy after the last arrival.

    The rolling figures cover the last ``history`` arrivals, which Spark finds as
    a distributed top-k.
    """
    last = timed.agg(
        F.count(F.lit(1)).alias("events_seen"),
        F.sum(F.col("out_of_order").cast("long")).alias("ooo_events"),
        F.max("max_event_time").alias("max_event_time"),
        F.max_by("budget", "n").alias("allowed_lateness_seconds"),
        F.max_by("lateness", "n").alias("last_lateness"),
        F.max_by("out_of_order", "n").alias("last_out_of_order"),
        F.round(F.max_by("arrival_rate", "n"), 9).alias("last_arrival_rate"),
        F.max_by("watermark_lag", "n").alias("last_watermark_lag"),
    )
    tail = timed.orderBy(F.col("n").desc()).limit(cfg.history)
    recent = tail.agg(
        F.count(F.lit(1)).alias("observations"),
        F.round(F.percentile("lateness", F.lit(cfg.cut)), 6).alias("lateness_percentile"),
        F.round(F.avg(F.col("out_of_order").cast("double")), 6).alias("recent_ooo_ratio"),
    )
    return with_run_value(last, recent, recent.columns, ())
