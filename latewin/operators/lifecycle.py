"""Life of every window key: opened, archived, released; and what late events meet.

Positions are arrival numbers. A cycle at the end of the stream has position
``last arrival + 1``, so it follows a regular cycle at the last arrival.

For a key whose window ends at E:
  ``opened``   first arrival that touches it;
  ``archived`` first arrival from ``opened`` on with watermark >= E;
  ``released`` first cycle from ``archived`` on with E + guard <= watermark.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latewin.operators.lateness import over_budget
from latewin.operators.ordering import BLOCK_ROWS, POINT_BLOCK, running, with_run_value
from latewin.operators.windows import (
    KEYS,
    PARTIALS,
    combine,
    finish,
    pane_of,
    partial_aggregates,
    sliding_windows,
    window_starts,
    windows_of_panes,
)
from latewin.schema import GuardConfig, WindowConfig
from latewin.session import stage

VALUE_BLOCK = 1 << 16
FANOUT = 1 << 10


# -- first position at which a series reaches a value --------------------------


def watermark_steps(timed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(value, position) of every rise of the watermark."""
    rose = F.col("watermark_before").isNull() | (
        F.col("watermark") > F.col("watermark_before")
    )
    return timed.filter(F.col("watermark").isNotNull() & rose).select(
        *by, F.col("watermark").alias("value"), F.col("n").alias("position")
    )


def first_reached(
    values: DataFrame,
    series: dict[str, DataFrame],
    by: Sequence[str] = (),
    value: str = "value",
) -> DataFrame:
    """For every value, the first position at which each series is at or above it.

    ``series`` holds tables (value, position); they need not rise. Values and steps
    are laid on one line and scanned from the top in value blocks; no pair of a
    value and a step is ever formed, and gaps between steps cost nothing.
    """
    by = list(by)
    names = list(series)
    line = values.select(
        *by,
        F.col(value).alias("value"),
        F.lit(True).alias("_asked"),
        *[F.lit(None).cast("long").alias(c) for c in names],
    ).distinct()
    for name, steps in series.items():
        line = line.unionByName(
            steps.select(
                *by,
                "value",
                F.lit(False).alias("_asked"),
                *[
                    (F.col("position") if c == name else F.lit(None)).cast("long").alias(c)
                    for c in names
                ],
            )
        )
    # Steps come before the question at the same value when scanning downwards.
    order = F.col("value") * 2 + F.when(F.col("_asked"), 0).otherwise(1)
    line = line.withColumnsRenamed({c: f"_at_{c}" for c in names})
    scanned = running(
        line,
        order,
        F.floor(F.col("value") / VALUE_BLOCK),
        {c: (F.col(f"_at_{c}"), "min") for c in names},
        by,
        descending=True,
    )
    return scanned.filter("_asked").select(*by, F.col("value").alias(value), *names)


# -- cycles --------------------------------------------------------------------


def cycle_table(
    timed: DataFrame, cycle_events: int, offset: int = 0, by: Sequence[str] = ()
) -> DataFrame:
    """One row per cycle with what the stream has seen by then.

    ``ordinal`` counts cycles densely, the closing one included.
    """
    by = list(by)
    n, budget = F.col("n"), F.col("budget")
    overflow = F.when(over_budget() & (budget > 0), F.col("lateness") - budget)
    groups = timed.groupBy(
        *by, F.ceil((n - offset) / cycle_events).cast("long").alias("ordinal")
    ).agg(
        F.max("n").alias("position"),
        F.max("watermark").alias("watermark"),
        F.max_by("budget", "n").alias("budget"),
        F.max("lateness").alias("group_lateness"),
        F.max(overflow).alias("group_overflow"),
    )
    groups = running(
        groups,
        "ordinal",
        F.floor(F.col("ordinal") / POINT_BLOCK),
        {
            "max_lateness": (F.col("group_lateness"), "max"),
            "max_overflow": (F.coalesce("group_overflow", F.lit(0)).cast("long"), "max"),
        },
        by,
    ).drop("group_lateness", "group_overflow")
    last = timed.groupBy(*by).agg(F.max("n").alias("_last"))
    groups = with_run_value(groups, last, ["_last"], by)
    position, ordinal = F.col("position"), F.col("ordinal")

    def cycle(shift: int, closing: bool) -> Column:
        return F.struct(
            (ordinal + shift).alias("ordinal"),
            (position + shift).alias("position"),
            F.lit(closing).alias("closing"),
        )

    fired = F.array_compact(
        F.array(
            F.when(F.pmod(position - offset, F.lit(cycle_events)) == 0, cycle(0, False)),
            F.when(position == F.col("_last"), cycle(1, True)),
        )
    )
    seen = ("watermark", "budget", "max_lateness", "max_overflow")
    cycles = groups.select(*by, F.explode(fired).alias("_c"), *seen)
    return cycles.select(*by, "_c.*", *seen).withColumn(
        "events_seen", F.col("position") - F.when(F.col("closing"), 1).otherwise(offset)
    )


def guard_expression(cfg: GuardConfig) -> Column:
    """Seconds a summary must lie behind the watermark before it may go."""
    if cfg.policy == "fixed":
        return F.lit(cfg.seconds).cast("long")
    return F.greatest(
        F.lit(1),
        F.col("budget"),
        F.col("max_lateness") + 1,
        F.col("max_overflow") + F.col("budget"),
    ).cast("long")


def guard_series(
    timed: DataFrame, cfg: GuardConfig, by: Sequence[str] = ()
) -> DataFrame:
    """Cycles with their guard and the frontier ``watermark - guard``."""
    cycles = cycle_table(timed, cfg.cycle_events, cfg.offset, by)
    cycles = cycles.withColumn("guard_seconds", guard_expression(cfg))
    return cycles.withColumn("frontier", F.col("watermark") - F.col("guard_seconds"))


def _first_cycle_reaching(asked: DataFrame, cycles: DataFrame, by: Sequence[str]) -> DataFrame:
    """For (ordinal, end) the first cycle from ``ordinal`` on whose frontier >= end.

    The frontier may dip, so a running maximum will not do. Cycles are packed
    into arrays of at most FANOUT with their maxima above them in two more
    levels; each question climbs and descends by equi-joins, at most one row each.
    """
    by = list(by)

    def pack(rows: DataFrame, position: str, height: str, parent: str | None):
        keyed = (
            rows.withColumn(parent, F.floor(F.col(position) / FANOUT)) if parent else rows
        )
        keys = [*by, parent] if parent else by
        return keyed.groupBy(*keys).agg(
            F.sort_array(
                F.collect_list(
                    F.struct(F.col(position).alias("p"), F.col(height).alias("h"))
                )
            ).alias("_line"),
            F.max(height).alias("_top"),
        )

    def hit(after: Column, strict: bool) -> Column:
        end = F.col("end")

        def fits(x):
            ahead = x["p"] > after if strict else x["p"] >= after
            return ahead & (x["h"] >= end)

        return F.get(F.filter("_line", fits), F.lit(0))["p"]

    one = pack(cycles.select(*by, "ordinal", "frontier"), "ordinal", "frontier", "p1")
    two = pack(one.select(*by, "p1", F.col("_top").alias("h")), "p1", "h", "p2")
    top = pack(two.select(*by, "p2", F.col("_top").alias("h")), "p2", "h", None)

    q = asked.withColumn("p1", F.floor(F.col("ordinal") / FANOUT))
    q = q.join(one.drop("_top"), [*by, "p1"], "left")
    q = q.withColumn("found", hit(F.col("ordinal"), False)).drop("_line")
    q = q.withColumn("p2", F.floor(F.col("p1") / FANOUT))
    q = q.join(two.drop("_top"), [*by, "p2"], "left")
    q = q.withColumn("b1", hit(F.col("p1"), True)).drop("_line")
    q = with_run_value(q, top, ["_line"], by)
    q = q.withColumn("b2", hit(F.col("p2"), True)).drop("_line", "p1", "p2")
    q = q.join(two.drop("_top").withColumnRenamed("p2", "b2"), [*by, "b2"], "left")
    q = q.withColumn("b1", F.coalesce("b1", hit(F.lit(-1), True))).drop("_line", "b2")
    q = q.join(one.drop("_top").withColumnRenamed("p1", "b1"), [*by, "b1"], "left")
    return q.withColumn("found", F.coalesce("found", hit(F.lit(-1), True))).drop("_line", "b1")


# -- panes -------------------------------------------------------------------------


def _placed(timed: DataFrame, cfg: WindowConfig, by: Sequence[str]) -> DataFrame:
    """Events with their pane ``start``, ``behind``, the number of windows that were behind the
    watermark (``late``) and, where a missing key meets no summary, the last end behind (``shut``)."""
    named = F.lit(True)
    for c in (*by, *KEYS):
        named = named & F.col(c).isNotNull()
    width = cfg.window // cfg.slide
    passed = F.floor((F.col("watermark_before") - _earliest_end(cfg)) / cfg.slide)
    behind = F.col("behind")
    return timed.select(
        *by,
        "n",
        *KEYS,
        "value",
        "watermark_before",
        pane_of(F.col("event_time"), cfg.slide).alias("start"),
        _behind(cfg).alias("behind"),
        F.least(F.lit(width), passed + 1).cast("long").alias("_ends"),
        (_earliest_end(cfg) + passed * cfg.slide).cast("long").alias("_last"),
        named.alias("_named"),
    ).select(
        *by,
        "n",
        *KEYS,
        "value",
        "watermark_before",
        "start",
        "behind",
        F.when(behind & F.col("_named"), F.col("_ends")).alias("late"),
        F.when(behind & ~F.col("_named"), F.col("_last")).alias("shut"),
    )


def _pane_aggregates() -> list[Column]:
    return [
        *partial_aggregates(),
        F.min("n").alias("f"),
        F.max("n").alias("last"),
        F.min_by("watermark_before", "n").alias("mark"),
        F.sum("late").alias("late"),
    ]


def arrival_panes(
    timed: DataFrame, cfg: WindowConfig = WindowConfig(), by: Sequence[str] = ()
) -> DataFrame:
    """Events reduced to panes, those behind the watermark apart.

    Besides the partials a row has the first and last arrival (``f``, ``last``), the watermark
    before the first (``mark``) and how many pairs were late. One pass over the events serves the
    key table, the window ends, the late pairs and the result.
    """
    return _placed(timed, cfg, by).groupBy(*by, "start", *KEYS, "behind", "shut").agg(
        *_pane_aggregates()
    )


def late_groups(
    timed: DataFrame,
    keys: DataFrame,
    cfg: WindowConfig = WindowConfig(),
    by: Sequence[str] = (),
    panes: DataFrame | None = None,
) -> DataFrame:
    """The panes behind the watermark, cut where one of their windows was released.

    ``met`` is the last release before a group's arrivals, null where there is none: a window was
    released before them exactly when that was at ``met`` or earlier. Only events of a pane that
    saw a release before its last arrival are read again; no (event, window) pair is formed.
    """
    by = list(by)
    pane = [*by, "start", *KEYS]
    panes = arrival_panes(timed, cfg, by) if panes is None else panes
    behind = panes.filter("behind")
    windows = (
        behind.select(*pane, "last")
        .withColumn("pane", F.col("start"))
        .withColumn("start", F.explode(window_starts(F.col("pane"), cfg)))
    )
    # Stored, so that the joins with it know how small it is.
    releases = stage(
        windows.join(keys.filter("released is not null").select(*pane, "released"), pane)
        .filter(F.col("released") < F.col("last"))
        .groupBy(*by, F.col("pane").alias("start"), *KEYS)
        .agg(
            F.collect_set("released").alias("_releases"),
            F.min("released").alias("_first"),
            F.max("released").alias("_end"),
        ),
        "releases",
    )
    n = F.col("n")
    # Most arrivals follow all releases or none; only those in between are compared with each.
    met = F.when(n > F.col("_end"), F.col("_end")).when(
        n > F.col("_first"), F.array_max(F.filter("_releases", lambda r: r < n))
    )
    cut = (
        _placed(timed.filter(_behind(cfg)), cfg, by)
        .join(releases, pane)
        .groupBy(*pane, met.alias("met"))
        .agg(*_pane_aggregates())
        .withColumn("shut", F.lit(None).cast("long"))
    )
    whole = behind.drop("behind").join(releases.select(*pane), pane, "left_anti")
    return whole.withColumn("met", F.lit(None).cast("long")).unionByName(cut)


def uncut(panes: DataFrame) -> DataFrame:
    """:func:`late_groups` of a run that releases nothing."""
    return panes.filter("behind").drop("behind").withColumn("met", F.lit(None).cast("long"))


# -- the key table ---------------------------------------------------------------


def window_ends(
    timed: DataFrame, cfg: WindowConfig, by: Sequence[str] = (), horizon: int | None = None
) -> DataFrame:
    """All distinct window ends, and the same moved up by ``horizon``."""
    return _ends_of(
        timed.select(*by, pane_of(F.col("event_time"), cfg.slide).alias("start")), cfg, by, horizon
    )


def _ends_of(
    panes: DataFrame, cfg: WindowConfig, by: Sequence[str], horizon: int | None
) -> DataFrame:
    panes = panes.select(*by, F.col("start").alias("p")).distinct()
    last = F.col("p") + cfg.window
    ends = F.sequence(F.col("p") + cfg.slide, last, F.lit(cfg.slide).cast("long"))
    if horizon is not None:
        ends = F.concat(ends, F.transform(ends, lambda e: e + horizon))
    return panes.select(*by, F.explode(ends).alias("value")).distinct()


def reach_table(
    timed: DataFrame,
    cfg: WindowConfig = WindowConfig(),
    cycles: DataFrame | None = None,
    by: Sequence[str] = (),
    horizon: int | None = None,
    panes: DataFrame | None = None,
) -> DataFrame:
    """When the watermark (``reached``) and the frontier (``cleared``) got to each window end.

    One row per distinct window end, however many keys end there. ``panes`` are those of
    :func:`arrival_panes`, if there already.
    """
    # Steps and cycles grow with the events, but all ends lie on one grid: what passes no end
    # of it is dropped by moving every value down to the grid and keeping its first position.
    grid = math.gcd(cfg.slide, horizon or 0)

    def steps(table: DataFrame) -> DataFrame:
        return table.groupBy(*by, pane_of(F.col("value"), grid).alias("value")).agg(
            F.min("position").alias("position")
        )

    series = {"reached": steps(watermark_steps(timed, by))}
    if cycles is not None:
        series["cleared"] = steps(
            cycles.select(*by, F.col("frontier").alias("value"), "position")
        )
    if panes is None:
        ends = window_ends(timed, cfg, by, horizon)
    else:
        ends = _ends_of(panes, cfg, by, horizon)
    table = first_reached(ends, series, by)
    return table if cycles is not None else table.withColumn(
        "cleared", F.lit(None).cast("long")
    )


def never_reached(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The reach table of a stream without a watermark: no end is ever reached."""
    kinds = ", ".join([*(f"{c} {dict(events.dtypes)[c]}" for c in by), "value long"])
    return events.sparkSession.createDataFrame(
        [], f"{kinds}, reached long, cleared long"
    )


def lifecycle_keys(
    timed: DataFrame,
    reach: DataFrame,
    cfg: WindowConfig = WindowConfig(),
    by: Sequence[str] = (),
    horizon: int | None = None,
    panes: DataFrame | None = None,
) -> DataFrame:
    """One row per window key with ``opened``, ``archived`` and ``cleared``.

    With ``horizon`` also ``behind``: when the watermark was that many seconds past
    the end. ``released`` follows from ``cleared``, see :func:`with_release`. ``panes`` are those
    of :func:`arrival_panes`, if there already.
    """
    by = list(by)
    panes = arrival_panes(timed, cfg, by) if panes is None else panes
    columns = [*PARTIALS, "f"]
    # A pane may have rows before and behind the watermark.
    whole = combine(panes, ["start", *by, *KEYS], columns)
    keys = windows_of_panes(whole, cfg, [*by, *KEYS], columns).withColumn(
        "end", F.col("start") + cfg.window
    )
    keys = keys.join(reach.withColumnRenamed("value", "end"), [*by, "end"], "left")
    extra = []
    if horizon is not None:
        behind = reach.select(
            *by,
            (F.col("value") - horizon).alias("end"),
            F.col("reached").alias("behind"),
        )
        keys = keys.join(behind, [*by, "end"], "left")
        extra = ["behind"]
    archived = F.when(F.col("reached").isNotNull(), F.greatest("f", "reached"))
    return keys.select(
        *by,
        "start",
        "end",
        *KEYS,
        *PARTIALS,
        F.col("f").alias("opened"),
        archived.alias("archived"),
        "cleared",
        *extra,
    )


def opened_behind() -> Column:
    """The key was archived only after the frontier had first cleared its end."""
    return F.coalesce(F.col("archived") > F.col("cleared"), F.lit(False))


def with_release(
    keys: DataFrame,
    guard: GuardConfig | None,
    cycles: DataFrame | None,
    by: Sequence[str] = (),
    search: bool = True,
) -> DataFrame:
    """Add ``released``, and ``offloadable`` where ``behind`` is known.

    ``search`` may be False when no key :func:`opened_behind` the frontier.
    """
    by = list(by)
    archived, cleared = F.col("archived"), F.col("cleared")
    if guard is None:
        out = keys.withColumn("released", F.lit(None).cast("long"))
    elif guard.policy == "fixed":
        # The frontier never dips: any cycle after the clearing one will do.
        last = cycles.filter("closing").select(*by, F.col("position").alias("_last"))
        out = with_run_value(keys, last, ["_last"], by)
        ordinal = F.ceil((archived - guard.offset) / guard.cycle_events).cast("long")
        following = F.least(ordinal * guard.cycle_events + guard.offset, F.col("_last"))
        both = archived.isNotNull() & cleared.isNotNull()
        out = out.withColumn(
            "released", F.when(both, F.greatest(cleared, following))
        ).drop("_last")
    else:
        out = keys.filter(~opened_behind()).withColumn(
            "released", F.when(archived.isNotNull(), cleared)
        )
        if search:
            out = out.unionByName(_searched(keys.filter(opened_behind()), guard, cycles, by))
    if "behind" in keys.columns:
        when = F.greatest("archived", "behind")
        held = F.col("released").isNull() | (when <= F.col("released"))
        counted = archived.isNotNull() & F.col("behind").isNotNull() & held
        out = out.withColumn("offloadable", F.when(counted, when)).drop("behind")
    return out.drop("cleared")


def _searched(
    keys: DataFrame, guard: GuardConfig, cycles: DataFrame, by: Sequence[str]
) -> DataFrame:
    """``released`` for keys that opened behind an adaptive frontier."""
    ordinal = F.ceil((F.col("archived") - guard.offset) / guard.cycle_events).cast("long")
    found = _first_cycle_reaching(keys.withColumn("ordinal", ordinal), cycles, by)
    positions = cycles.select(
        *by, F.col("ordinal").alias("found"), F.col("position").alias("released")
    )
    return found.join(positions, [*by, "found"], "left").select(*keys.columns, "released")


# -- late events ------------------------------------------------------------------


def _earliest_end(cfg: WindowConfig) -> Column:
    return pane_of(F.col("event_time"), cfg.slide) + cfg.slide


def _behind(cfg: WindowConfig) -> Column:
    """The event falls in at least one window that was already behind the watermark."""
    return F.coalesce(_earliest_end(cfg) <= F.col("watermark_before"), F.lit(False))


def late_pairs(
    timed: DataFrame, keys: DataFrame, cfg: WindowConfig = WindowConfig(), by: Sequence[str] = ()
) -> DataFrame:
    """(event, window) pairs whose window ended at or before the previous watermark.

    Category A opened the key itself, B met an archived summary, C a released one.
    A pair is behind exactly when its end is, so only those events are expanded.
    """
    by = list(by)
    pairs = sliding_windows(
        timed.filter(_behind(cfg)).select(
            *by, "n", "event_time", *KEYS, "value", "watermark_before"
        ),
        cfg,
    ).filter(F.col("end") <= F.col("watermark_before"))
    joined = pairs.drop("watermark_before", "end").join(
        keys.select(*by, "start", *KEYS, "end", "opened", "archived", "released"),
        [*by, "start", *KEYS],
    )
    n = F.col("n")
    category = (
        F.when(n == F.col("opened"), "A")
        .when(F.coalesce(n > F.col("released"), F.lit(False)), "C")
        .otherwise("B")
    )
    return joined.withColumn("category", category)


def classify_pairs(
    timed: DataFrame, keys: DataFrame, cfg: WindowConfig = WindowConfig(), by: Sequence[str] = ()
) -> DataFrame:
    """Every (event, window) pair with its category."""
    columns = [*by, "n", "event_time", *KEYS, "value", "start"]
    on_time = sliding_windows(
        timed.select(*by, "n", "event_time", *KEYS, "value", "watermark_before"), cfg
    ).filter(F.col("watermark_before").isNull() | (F.col("end") > F.col("watermark_before")))
    late = late_pairs(timed, keys, cfg, by)
    return (
        on_time.select(*columns)
        .withColumn("category", F.lit("A"))
        .unionByName(late.select(*columns, "category"))
    )


def _windows_met(
    groups: DataFrame, keys: DataFrame, cfg: WindowConfig, by: Sequence[str], how: str
) -> DataFrame:
    """Late groups once per window they cover, with ``opened`` and ``released`` of its key."""
    spread = groups.withColumn("start", F.explode(window_starts(F.col("start"), cfg)))
    found = keys.select(*by, "start", *KEYS, "opened", "released")
    return spread.join(found, [*by, "start", *KEYS], how).withColumn(
        "end", F.col("start") + cfg.window
    )


def late_categories(
    timed: DataFrame,
    keys: DataFrame,
    cfg: WindowConfig = WindowConfig(),
    by: Sequence[str] = (),
    panes: DataFrame | None = None,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Pair counts per category, from the panes; no pair is formed.

    ``panes`` and ``groups`` are those of :func:`arrival_panes` and :func:`late_groups`, if there
    already. A window was opened by a late event exactly when its first arrival is the first of
    a late group and its end lay at or below the watermark before it.
    """
    by = list(by)
    width = cfg.window // cfg.slide
    panes = arrival_panes(timed, cfg, by) if panes is None else panes
    groups = late_groups(timed, keys, cfg, by, panes) if groups is None else groups
    total = panes.groupBy(*by).agg(
        (F.sum("count") * width).alias("pairs"), F.coalesce(F.sum("late"), F.lit(0)).alias("_late")
    )
    met = _windows_met(groups, keys, cfg, by, "inner")
    opening = (F.col("f") == F.col("opened")) & (F.col("end") <= F.col("mark"))
    counts = met.groupBy(*by).agg(
        F.count(F.when(opening, 1)).alias("_a"),
        F.sum(F.when(F.col("released") <= F.col("met"), F.col("count"))).alias("_c"),
    )
    out = with_run_value(total, counts, ["_a", "_c"], by)
    c = F.coalesce("_c", F.lit(0))
    b = F.col("_late") - F.coalesce("_a", F.lit(0)) - c
    return out.select(
        *by,
        "pairs",
        (F.col("pairs") - b - c).alias("on_time_pairs"),
        b.alias("reconciled_events"),
        b.alias("late_after_finalization"),
        c.alias("late_after_eviction"),
    )


def enforce_no_late_after_eviction(categories: DataFrame) -> None:
    """Raise if any event reached a released window."""
    lost = categories.agg(F.sum("late_after_eviction")).first()[0] or 0
    if lost:
        raise RuntimeError(f"{lost} late events after eviction")


def surviving_partials(
    timed: DataFrame,
    keys: DataFrame,
    cfg: WindowConfig = WindowConfig(),
    by: Sequence[str] = (),
    panes: DataFrame | None = None,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Window partials of all pairs except those that met a released window.

    ``panes`` and ``groups`` are those of :func:`arrival_panes` and :func:`late_groups`, if there
    already.
    """
    by = list(by)
    grouping = [*by, *KEYS]
    order = ["start", *grouping, *PARTIALS]
    panes = arrival_panes(timed, cfg, by) if panes is None else panes
    groups = late_groups(timed, keys, cfg, by, panes) if groups is None else groups
    free = F.col("met").isNull() & F.col("shut").isNull()
    plain = panes.filter(~F.col("behind")).select(order).unionByName(
        groups.filter(free).select(order)
    )
    whole = windows_of_panes(combine(plain, order[:-4]), cfg, grouping)
    kept = ~F.coalesce(F.col("released") <= F.col("met"), F.lit(False)) & ~F.coalesce(
        F.col("end") <= F.col("shut"), F.lit(False)
    )
    rest = _windows_met(groups.filter(~free), keys, cfg, by, "left").filter(kept)
    return combine(whole.select(order).unionByName(rest.select(order)), order[:-4])


# -- tiers --------------------------------------------------------------------------


def finalization_audit(
    timed: DataFrame, keys: DataFrame, cap: int | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Watermark and budget at which keys were archived.

    All of them, or with ``cap`` the earliest ``cap`` of every ``by``.
    """
    by = list(by)
    moments = timed.select(
        *by,
        F.col("n").alias("archived"),
        F.col("watermark").alias("finalized_at_watermark"),
        F.col("budget").alias("budget_seconds"),
    )
    first = keys.filter("archived is not null")
    order = ["archived", "start", *KEYS]
    if cap is not None and by:
        ranked = Window.partitionBy(*by).orderBy(*order)
        first = first.withColumn("_nth", F.row_number().over(ranked)).filter(F.col("_nth") <= cap)
    elif cap is not None:
        first = first.orderBy(*order).limit(cap)
    return first.join(moments, [*by, "archived"]).select(
        *by,
        "start",
        "end",
        *KEYS,
        "archived",
        "finalized_at_watermark",
        "budget_seconds",
    )


def evictable(keys: DataFrame, watermark: Column, guard_seconds: int) -> DataFrame:
    """Archived keys that lie the guard behind a watermark."""
    return keys.filter(
        F.col("archived").isNotNull() & (F.col("end") + guard_seconds <= watermark)
    )


def tier_of() -> Column:
    return (
        F.when(F.col("released").isNotNull(), "frozen")
        .when(F.col("archived").isNotNull(), "archive")
        .otherwise("hot")
    )


def frozen_rows(
    timed: DataFrame, keys: DataFrame, cfg: WindowConfig = WindowConfig(), by: Sequence[str] = ()
) -> DataFrame:
    """Final rows of the released keys."""
    by = list(by)
    released = keys.filter("released is not null").select(*by, "start", *KEYS)
    rows = surviving_partials(timed, keys, cfg, by)
    return finish(rows.join(released, [*by, "start", *KEYS]), cfg, by=by)


def tier_timeline(
    keys: DataFrame, positions: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Tier sizes wherever they change and at the given positions (flagged ``asked``).

    Each key contributes one step per transition; steps are summed per position
    before the blocked scan. ``hot_before`` and ``hot`` are taken after opening
    and before archiving, and after archiving; ``archive_before`` and
    ``archive`` before and after the cycle at that position.
    """
    by = list(by)
    moves = ["opened", "archived", "released"]
    if "offloadable" in keys.columns:
        moves.append("offloadable")
    gone = (
        F.when(F.col("offloadable").isNotNull(), F.col("released"))
        if "offloadable" in moves
        else F.lit(None)
    )
    steps = keys.select(
        *by,
        F.explode(
            F.array(
                *[F.struct(F.col(m).alias("position"), F.lit(m).alias("move")) for m in moves],
                F.struct(gone.cast("long").alias("position"), F.lit("gone").alias("move")),
            )
        ).alias("s"),
    ).select(*by, "s.*")
    moves.append("gone")
    steps = steps.filter("position is not null").withColumn("asked", F.lit(False))
    line = steps
    if positions is not None:
        line = steps.unionByName(
            positions.select(
                *by,
                "position",
                F.lit(None).cast("string").alias("move"),
                F.lit(True).alias("asked"),
            )
        )
    per = line.groupBy(*by, "position").agg(
        F.max("asked").alias("asked"),
        *[F.count(F.when(F.col("move") == m, 1)).alias(f"_{m}") for m in moves],
    )
    summed = running(
        per,
        "position",
        F.floor(F.col("position") / BLOCK_ROWS),
        {m: (F.col(f"_{m}"), "sum") for m in moves},
        by,
    )
    hot = F.col("opened") - F.col("archived")
    columns = {
        "newly_opened": F.col("_opened"),
        "newly_archived": F.col("_archived"),
        "newly_released": F.col("_released"),
        "hot_peak": hot + F.col("_archived"),
        "hot": hot,
        "archive_before": F.col("archived") - F.col("released") + F.col("_released"),
        "archive": F.col("archived") - F.col("released"),
        "frozen": F.col("released"),
    }
    if "offloadable" in moves:
        columns["offloadable"] = F.col("offloadable") - F.col("gone") + F.col("_gone")
    return summed.select(
        *by, "position", "asked", *[e.cast("long").alias(c) for c, e in columns.items()]
    )


def peak_hot(keys: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest hot tier, before and after the archiving step of an arrival."""
    timeline = tier_timeline(keys, by=by)
    return timeline.groupBy(*by).agg(
        F.max("hot_peak").alias("peak_hot"), F.max("hot").alias("peak_active")
    )


def tier_totals(keys: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Final tier sizes and peaks of a run."""

    def held(tier: str) -> Column:
        return F.count(F.when(tier_of() == tier, 1))

    final = keys.groupBy(*by).agg(
        F.count(F.lit(1)).alias("keys"),
        held("hot").alias("final_hot"),
        held("archive").alias("final_archive"),
        held("frozen").alias("frozen"),
        F.count("archived").alias("finalized_windows"),
        F.count("archived").alias("evicted_state_entries"),
    )
    out = with_run_value(final, peak_hot(keys, by), ["peak_hot", "peak_active"], by)
    return out.withColumns(
        {
            "final_total": F.col("final_hot") + F.col("final_archive"),
            "peak_total": F.col("peak_active") + F.col("final_archive"),
        }
    )


def eviction_cycles(
    keys: DataFrame, cycles: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Per cycle: arrivals seen, guard, candidates and released keys."""
    by = list(by)
    released = (
        keys.filter("released is not null")
        .groupBy(*by, F.col("released").alias("position"))
        .agg(F.count(F.lit(1)).alias("evicted"))
    )
    evicted = F.coalesce("evicted", F.lit(0))
    return cycles.join(released, [*by, "position"], "left").select(
        *by,
        "position",
        "events_seen",
        "closing",
        "guard_seconds",
        evicted.alias("evictable_candidates"),
        evicted.alias("evicted"),
    )


def retention_snapshot(
    keys: DataFrame, cycles: DataFrame, guard: GuardConfig, history: int = 256
) -> DataFrame:
    """Guard policy, extremes, released keys and mean guard of the last cycles."""
    ends = cycles.agg(
        F.max_by("guard_seconds", "ordinal").alias("effective_guard_seconds"),
        F.max("max_lateness").alias("observed_max_lateness"),
        F.max("max_overflow").alias("observed_max_overflow"),
        F.count(F.lit(1)).alias("eviction_cycles"),
    )
    recent = (
        cycles.orderBy(F.col("ordinal").desc())
        .limit(history)
        .agg(F.round(F.avg("guard_seconds"), 2).alias("mean_guard_seconds"))
    )
    released = keys.agg(F.count("released").alias("evicted_entries"))
    out = with_run_value(ends, recent, ["mean_guard_seconds"], ())
    out = with_run_value(out, released, ["evicted_entries"], ())
    return out.select(
        F.lit(guard.policy).alias("guard_policy"),
        F.lit(guard.seconds).cast("long").alias("configured_guard_seconds"),
        *out.columns,
    )


def accounting_cycles(
    timed: DataFrame,
    keys: DataFrame,
    cycle_events: int,
    offset: int = 0,
    scan_every: int = 10,
    by: Sequence[str] = (),
) -> DataFrame:
    """Tier sizes at every accounting cycle.

    The offloadable count is taken at every ``scan_every``-th cycle and at the
    end, and holds in between.
    """
    by = list(by)
    cycles = cycle_table(timed, cycle_events, offset, by).select(
        *by, "ordinal", "position", "events_seen", "closing"
    )
    sizes = tier_timeline(keys, cycles, by).filter("asked")
    joined = cycles.join(sizes, [*by, "position"])
    start = 1 if offset == 0 else F.ceil((F.lit(1) - offset) / cycle_events)
    scanned = F.col("closing") | (F.pmod(F.col("ordinal") - start, F.lit(scan_every)) == 0)
    held = running(
        joined.withColumn("_seen", F.when(scanned, F.col("offloadable"))),
        "ordinal",
        F.floor(F.col("ordinal") / POINT_BLOCK),
        {"offloadable_entries": (F.col("_seen"), "last")},
        by,
    )
    return held.select(
        *by,
        "ordinal",
        "position",
        "events_seen",
        "closing",
        F.col("hot").alias("hot_entries"),
        F.col("archive_before").alias("archive_entries"),
        (F.col("hot") + F.col("archive_before")).alias("total_entries"),
        "offloadable_entries",
    )


def accounting_snapshot(
    cycles: DataFrame, cycle_events: int, horizon: int, history: int = 512
) -> DataFrame:
    """Peaks over all cycles, means over the last ``history``, and the final state."""
    totals = cycles.agg(
        F.count(F.lit(1)).alias("compaction_cycles"),
        F.max("hot_entries").alias("peak_hot_entries"),
        F.max("archive_entries").alias("peak_archive_entries"),
        F.max("total_entries").alias("peak_total_entries"),
        F.max_by("offloadable_entries", "ordinal").alias("final_offloadable_entries"),
        F.max_by("hot_entries", "ordinal").alias("final_hot_entries"),
        F.max_by("archive_entries", "ordinal").alias("final_archive_entries"),
    )
    recent = (
        cycles.orderBy(F.col("ordinal").desc())
        .limit(history)
        .agg(
            F.round(F.avg("hot_entries"), 2).alias("mean_hot_entries"),
            F.round(F.avg("archive_entries"), 2).alias("mean_archive_entries"),
        )
    )
    out = with_run_value(totals, recent, recent.columns, ())
    return out.select(
        F.lit(cycle_events).cast("long").alias("cycle_events"),
        F.lit(horizon).cast("long").alias("retention_horizon_seconds"),
        *out.columns,
    )


def memory_signal(cycles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pressure in [0, 1] after each accounting cycle: footprint over 1.5 times its peak."""
    scanned = running(
        cycles,
        "ordinal",
        F.floor(F.col("ordinal") / POINT_BLOCK),
        {"peak_total_entries": (F.col("total_entries"), "max")},
        by,
    )
    total, peak = F.col("total_entries"), F.col("peak_total_entries")
    signal = F.when(total <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), total / (peak * 1.5))
    )
    return scanned.withColumn("memory_utilization", signal)


def reduction_percent(baseline: Column, value: Column) -> Column:
    """Reduction against a baseline in percent; null when there is no baseline."""
    return F.when(baseline > 0, F.round((baseline - value) / baseline * 100, 4))


def state_reduction(totals: DataFrame, baseline_peak: Column) -> DataFrame:
    return totals.select(
        (baseline_peak > 0).alias("available"),
        baseline_peak.alias("baseline_peak_hot"),
        F.col("peak_hot").alias("adaptive_peak_hot"),
        reduction_percent(baseline_peak, F.col("peak_hot")).alias(
            "peak_hot_reduction_percent"
        ),
        reduction_percent(baseline_peak, F.col("final_hot")).alias(
            "final_hot_reduction_percent"
        ),
    )


def control_log(timed: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per arrival: lateness, budget, watermark and what happened to the hot tier."""
    timeline = tier_timeline(keys, timed.select(F.col("n").alias("position"))).filter("asked")
    joined = timed.join(timeline.withColumnRenamed("position", "n"), "n")
    before = F.col("hot") - F.col("newly_opened") + F.col("newly_archived")
    return joined.select(
        F.col("n").alias("event_number"),
        "event_time",
        F.col("lateness").alias("lateness_seconds"),
        F.col("budget").alias("allowed_lateness_seconds"),
        (~over_budget()).alias("within_budget"),
        "watermark",
        F.col("newly_archived").alias("newly_finalized"),
        before.alias("state_size_before"),
        F.col("hot").alias("state_size_after"),
        (F.col("hot") - before).alias("state_growth"),
        "out_of_order",
        F.col("archive").alias("archive_entries"),
        F.col("frozen").alias("frozen_entries"),
    )


def state_summary(log: DataFrame) -> DataFrame:
    """Initial, largest, final and mean hot size over a control log."""
    return log.agg(
        F.min_by("state_size_after", "event_number").alias("initial_entries"),
        F.max("state_size_after").alias("maximum_entries"),
        F.max_by("state_size_after", "event_number").alias("final_entries"),
        F.round(F.avg("state_size_after"), 6).alias("average_entries"),
        F.sum("newly_finalized").alias("finalized_windows"),
    )


def trajectory(timed: DataFrame, keys: DataFrame, every: int) -> DataFrame:
    """The control log at every ``every``-th arrival and at the last.

    Only those arrivals are asked of the timeline.
    """
    last = timed.agg(F.max("n")).scalar()
    n = F.col("n")
    return control_log(timed.filter((n % every == 0) | (n == last)), keys)
