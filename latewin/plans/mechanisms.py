"""Mechanisms: budget source, guard and accounting combined into one run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewin.operators import lifecycle as lc
from latewin.operators.lateness import (
    fixed_watermark,
    over_budget,
    watermark_updates,
)
from latewin.operators.ordering import with_run_value
from latewin.operators.windows import finish, tier_union
from latewin.schema import GuardConfig, LatenessConfig, Mechanism, WindowConfig


def presets(
    fixed_seconds: int = 10,
    guard_seconds: int = 12,
    cycle_events: int = 100,
    guard_policy: str = "adaptive",
    aggressive_seconds: int = 4,
    lateness: LatenessConfig = LatenessConfig(),
    offset: int = 0,
) -> dict[str, Mechanism]:
    """The named mechanisms.

    ``cmix`` keeps everything; ``fixed`` has a constant budget, ``fixed_lagged`` the same
    below the maximum before each arrival; ``aloa`` the adaptive one; ``maso`` adds accounting; ``earm`` and ``full`` also release
    archived summaries; ``earm_agg`` does so with a small fixed guard.
    """
    guard = GuardConfig(guard_policy, guard_seconds, cycle_events, offset)
    tight = GuardConfig(
        "fixed", min(guard_seconds, aggressive_seconds), cycle_events, offset
    )
    adaptive = {"budget": "adaptive", "lateness": lateness}
    return {
        "cmix": Mechanism("cmix"),
        "fixed": Mechanism("fixed", "fixed", fixed_seconds),
        "fixed_lagged": Mechanism("fixed_lagged", "fixed", fixed_seconds, lagged=True),
        "aloa": Mechanism("aloa", **adaptive),
        "maso": Mechanism("maso", accounting=True, cycle_events=cycle_events, **adaptive),
        "earm": Mechanism("earm", guard=guard, accounting=True, **adaptive),
        "full": Mechanism("full", guard=guard, accounting=True, **adaptive),
        "earm_agg": Mechanism("earm_agg", guard=tight, accounting=True, **adaptive),
    }


def with_watermark(obs: DataFrame, mech: Mechanism, by: Sequence[str] = ()) -> DataFrame:
    """Budget and watermark of a mechanism without adaptation; null where it has none."""
    if mech.budget == "fixed":
        return fixed_watermark(obs, mech.fixed_seconds, by, mech.lagged)
    none = F.lit(None).cast("long")
    return obs.withColumns({"budget": none, "watermark": none, "watermark_before": none})


def result_by_tier(
    timed: DataFrame, keys: DataFrame, cfg: WindowConfig = WindowConfig()
) -> DataFrame:
    """Result rows with the tier that holds each at the end."""
    rows = finish(lc.surviving_partials(timed, keys, cfg), cfg)
    tiers = keys.select(
        "start",
        F.col("device_id").alias("DeviceId"),
        F.col("sensor").alias("Sensor"),
        lc.tier_of().alias("tier"),
    )
    return rows.join(tiers, ["start", "DeviceId", "Sensor"])


def held_result(keys: DataFrame, cfg: WindowConfig = WindowConfig(), by: Sequence[str] = ()) -> DataFrame:
    """Result rows of a mechanism that releases nothing, each with its tier at the end and the
    arrivals that opened and archived it.

    Late events are merged into archived summaries, so the key table's aggregates are whole.
    """
    return finish(keys, cfg, by=by, extra=[lc.tier_of().alias("tier"), "opened", "archived"])


def with_accounted_cycles(
    rows: DataFrame, last_n: DataFrame, cycle: int, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``accounted_cycles``: the accounting cycles that find a row's summary held.

    Cycles fire at every ``cycle``-th arrival and once more after the last one. ``last_n`` has
    one row (per ``by``) with that arrival.
    """
    placed = with_run_value(rows, last_n, ["last_n"], by)
    found = F.floor(F.col("last_n") / cycle) - F.floor((F.col("opened") - 1) / cycle) + 1
    return placed.withColumn("accounted_cycles", found.cast("long")).drop("last_n")


def union_of_tiers(by_tier: DataFrame) -> DataFrame:
    """Frozen rows overlaid by archive overlaid by hot, one row per key."""
    return tier_union(
        [by_tier.filter(F.col("tier") == t) for t in ("frozen", "archive", "hot")]
    )


def run_snapshot(
    timed: DataFrame,
    keys: DataFrame,
    cfg: WindowConfig = WindowConfig(),
    by: Sequence[str] = (),
    late: DataFrame | None = None,
) -> DataFrame:
    """The counters of a run as one row per ``by``; ``late`` are its late categories, if there."""
    by = list(by)
    stream = timed.groupBy(*by).agg(
        F.max("max_event_time").alias("max_event_time"),
        F.max_by("budget", "n").alias("allowed_lateness_seconds"),
        F.count(F.when(over_budget(), 1)).alias("over_budget_events"),
    )
    out = stream
    marks = watermark_updates(timed, by).withColumnRenamed("final_watermark", "watermark")
    totals = lc.tier_totals(keys, by)
    late = lc.late_categories(timed, keys, cfg, by) if late is None else late
    for table, names in (
        (marks, ["watermark", "watermark_updates"]),
        (
            totals,
            [
                "keys",
                "final_hot",
                "final_archive",
                "frozen",
                "finalized_windows",
                "evicted_state_entries",
                "peak_hot",
                "peak_active",
            ],
        ),
        (late, ["reconciled_events", "late_after_finalization", "late_after_eviction"]),
    ):
        out = with_run_value(out, table, names, by)
    return out.select(
        *by,
        (F.col("final_hot")).alias("state_entries"),
        "max_event_time",
        "allowed_lateness_seconds",
        "watermark",
        "watermark_updates",
        F.col("final_hot").alias("active_state_entries"),
        F.col("final_archive").alias("finalized_state_entries"),
        F.col("peak_hot").alias("peak_active_state_entries"),
        F.col("peak_active").alias("peak_active_after_archiving"),
        "finalized_windows",
        "evicted_state_entries",
        "reconciled_events",
        "late_after_finalization",
        "over_budget_events",
        F.col("frozen").alias("frozen_emissions"),
        "late_after_eviction",
        F.col("frozen").alias("frozen_keys_size"),
        F.col("finalized_windows").alias("finalization_audit_records"),
        F.col("keys").alias("total_keys"),
    )
