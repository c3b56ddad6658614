"""Sliding and tumbling event-time windows over epoch seconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewin.schema import RESULT_KEYS, WindowConfig

KEYS = ("device_id", "sensor")
PARTIALS = ("count", "sum", "min", "max")
# Panes per stretch of time, at least those of one window.
STRETCH_PANES = 4096

_COMBINE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "f": F.min}


def pane_of(ts: Column, slide: int) -> Column:
    """Start of the slide-long pane holding ``ts``; floors for negative times too."""
    return ts - F.pmod(ts, F.lit(slide).cast("long"))


def window_starts(pane: Column, cfg: WindowConfig) -> Column:
    """Array of the starts of all windows covering a pane."""
    if cfg.window == cfg.slide:
        return F.array(pane)
    return F.sequence(pane - (cfg.window - cfg.slide), pane, F.lit(cfg.slide).cast("long"))


def sliding_windows(
    df: DataFrame, cfg: WindowConfig = WindowConfig(), ts: str = "event_time"
) -> DataFrame:
    """One row per (row, covering window), with ``start`` and ``end``."""
    return df.withColumn(
        "start", F.explode(window_starts(pane_of(F.col(ts), cfg.slide), cfg))
    ).withColumn("end", F.col("start") + cfg.window)


def partial_aggregates(value: str = "value") -> list[Column]:
    return [
        F.count(F.lit(1)).alias("count"),
        F.sum(value).alias("sum"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]


def combine(df: DataFrame, keys: Sequence[str], columns: Sequence[str] = PARTIALS) -> DataFrame:
    return df.groupBy(*keys).agg(*[_COMBINE[c](c).alias(c) for c in columns])


def window_partials(
    df: DataFrame,
    cfg: WindowConfig = WindowConfig(),
    keys: Sequence[str] = KEYS,
    ts: str = "event_time",
    value: str = "value",
    first: str | None = None,
) -> DataFrame:
    """Mergeable count/sum/min/max per (start, *keys).

    Events are first reduced to panes, so a hot series shrinks to one row per
    pane before it meets the window expansion. The panes are then spread by
    series and stretch of time, which puts all panes of a window in one place and
    makes the second aggregation shuffle-free. A pane whose windows reach into
    the stretch before is sent to both, so a stretch never holds more than
    STRETCH_PANES panes and one window's worth of a series, however many events.

    ``first`` names an arrival index whose minimum per window is kept as ``f``.
    """
    keys = list(keys)
    columns = [*PARTIALS, *(["f"] if first else [])]
    aggregates = partial_aggregates(value) + ([F.min(first).alias("f")] if first else [])
    panes = df.groupBy(pane_of(F.col(ts), cfg.slide).alias("start"), *keys).agg(*aggregates)
    return windows_of_panes(panes, cfg, keys, columns)


def windows_of_panes(
    panes: DataFrame,
    cfg: WindowConfig,
    keys: Sequence[str] = KEYS,
    columns: Sequence[str] = PARTIALS,
) -> DataFrame:
    """Partials per (start, *keys) of all windows over slide-long panes, one row a pane."""
    if cfg.window == cfg.slide:
        return panes.select("start", *keys, *columns)
    length = cfg.slide * max(STRETCH_PANES, cfg.window // cfg.slide)
    pane = F.col("start")
    touched = F.array_distinct(
        F.array(
            F.floor((pane - (cfg.window - cfg.slide)) / length), F.floor(pane / length)
        )
    )
    spread = (
        panes.withColumn("_stretch", F.explode(touched))
        .repartition(*keys, "_stretch")
        .withColumn("start", F.explode(window_starts(pane, cfg)))
        .filter(F.floor(F.col("start") / length) == F.col("_stretch"))
    )
    return combine(spread, ["_stretch", "start", *keys], columns).drop("_stretch")


def merge_partials(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = ("start", *KEYS)
) -> DataFrame:
    """Merge two tables of partials that may share keys."""
    columns = [*keys, *PARTIALS]
    return combine(left.select(*columns).unionByName(right.select(*columns)), keys)


def finish(
    partials: DataFrame,
    cfg: WindowConfig = WindowConfig(),
    round_to: int | None = None,
    by: Sequence[str] = (),
    extra: Sequence[str | Column] = (),
) -> DataFrame:
    """Result rows from partials, with ``extra`` columns of theirs at the end."""

    def fixed(c: Column) -> Column:
        return F.round(c, round_to) if round_to is not None else c

    return partials.select(
        *by,
        "start",
        (F.col("start") + cfg.window).alias("end"),
        F.col("device_id").alias("DeviceId"),
        F.col("sensor").alias("Sensor"),
        "count",
        fixed(F.col("sum")).alias("sum"),
        fixed(F.col("sum") / F.col("count")).alias("avg"),
        fixed(F.col("min")).alias("min"),
        fixed(F.col("max")).alias("max"),
        *extra,
    )


def window_aggregate(
    df: DataFrame,
    cfg: WindowConfig = WindowConfig(),
    ts: str = "event_time",
    value: str = "value",
    round_to: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """count, sum, avg, min and max per window, device and sensor."""
    partials = window_partials(df, cfg, [*by, *KEYS], ts, value)
    return finish(partials, cfg, round_to, by)


def native_window_aggregate(
    df: DataFrame, cfg: WindowConfig = WindowConfig(), ts: str = "event_time"
) -> DataFrame:
    """The same result through the built-in ``window`` function (works on streams)."""
    window = F.window(
        F.timestamp_seconds(F.col(ts)), f"{cfg.window} seconds", f"{cfg.slide} seconds"
    )
    return (
        df.groupBy(window.alias("w"), *KEYS)
        .agg(*partial_aggregates())
        .select(
            F.col("w.start").cast("long").alias("start"),
            F.col("w.end").cast("long").alias("end"),
            F.col("device_id").alias("DeviceId"),
            F.col("sensor").alias("Sensor"),
            "count",
            "sum",
            (F.col("sum") / F.col("count")).alias("avg"),
            "min",
            "max",
        )
    )


def tier_union(tiers: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """One row per window key; on a clash the tier listed later wins."""
    keys = [*by, *RESULT_KEYS]
    rest = [c for c in tiers[0].columns if c not in keys]
    tagged = None
    for rank, tier in enumerate(tiers):
        part = tier.withColumn("_rank", F.lit(rank))
        tagged = part if tagged is None else tagged.unionByName(part)
    return (
        tagged.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "_rank").alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*tiers[0].columns)
    )
