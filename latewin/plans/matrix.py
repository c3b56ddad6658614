"""Scenario x mechanism matrix and the tables drawn from it.

All scenarios of a mechanism are one run, told apart by a column, and the
lateness observations are shared by all mechanisms.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewin.operators import compare as cmp
from latewin.operators import lifecycle as lc
from latewin.operators.lateness import budget_report, inversions, observe_lateness
from latewin.operators.windows import window_aggregate
from latewin.plans.run import Run
from latewin.schema import Mechanism, WindowConfig
from latewin.session import stage

BASELINE = "cmix"
LADDER = ("cmix", "aloa", "maso", "full")
SUMMARY = (
    "scenario",
    "comparison_type",
    "mechanism",
    "exact",
    "ground_truth_rows",
    "result_rows",
    "missing_in_result",
    "extra_in_result",
    "field_mismatches",
    "peak_hot",
    "final_hot",
    "final_archive",
    "frozen",
    "reconciled",
    "late_after_finalization",
    "late_after_eviction",
    "events_per_second",
    "processing_seconds",
    "peak_hot_reduction_percent",
)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Matrix:
    """Reports of several mechanisms over a table of events with a ``scenario`` column."""

    def __init__(
        self,
        events: DataFrame,
        mechanisms: dict[str, Mechanism],
        cfg: WindowConfig = WindowConfig(),
        clock: Callable[[], float] = time.monotonic,
    ):
        by = ["scenario"]
        start = clock()
        if "arrival_rate" not in events.columns:
            events = observe_lateness(events, by)
        obs = stage(events, "matrix-observations")
        self.by, self.cfg, self.obs, self.clock = by, cfg, obs, clock
        #: Time of what all mechanisms share: reading, ordering and storing the arrivals.
        self.shared_seconds = clock() - start
        self.runs = {
            name: Run(obs, mech, cfg, by, observed=True, lean=True)
            for name, mech in mechanisms.items()
        }
        # The same mechanism under two names is run once.
        seen: dict[tuple, Run] = {}
        for name, run in self.runs.items():
            m = run.mech
            same = (m.budget, m.fixed_seconds, m.guard, m.lateness)
            self.runs[name] = seen.setdefault(same, run)
        budgets: dict[tuple, Run] = {}
        for run in seen.values():
            if run.mech.budget == "adaptive":
                first = budgets.setdefault(run.mech.lateness, run)
                if first is not run:
                    run.timed = first.timed

    def summary(self, measure: bool = False) -> DataFrame:
        """One row per scenario and mechanism, every result compared with the truth.

        With ``measure`` each mechanism's result is written once and timed; the
        two run-time columns are null otherwise.
        """
        truth = stage(window_aggregate(self.obs, self.cfg, by=self.by), "truth")
        counts = self.obs.groupBy("scenario").agg(F.count(F.lit(1)).alias("events"))
        named: dict[int, list[str]] = {}
        for name, run in self.runs.items():
            named.setdefault(id(run), []).append(name)

        def rows_of(names: list[str]) -> DataFrame:
            run = self.runs[names[0]]
            seconds = F.lit(None).cast("double")
            if measure:
                start = self.clock()
                result = stage(run.result, "result")
                seconds = F.lit(float(self.clock() - start))
            state = run.totals.join(run.late, self.by)
            if not measure:
                # Untimed, it may share the panes that the state was derived from.
                result = run.result
            verdict = cmp.verdict(truth, result, by=self.by)
            rows = verdict.join(state, self.by).join(counts, self.by).select(
                "scenario",
                F.lit("result_vs_batch_aggregate").alias("comparison_type"),
                F.explode(F.array(*[F.lit(n) for n in names])).alias("mechanism"),
                "exact",
                "ground_truth_rows",
                "result_rows",
                "missing_in_result",
                "extra_in_result",
                "field_mismatches",
                "peak_hot",
                "final_hot",
                "final_archive",
                "frozen",
                F.col("reconciled_events").alias("reconciled"),
                "late_after_finalization",
                "late_after_eviction",
                F.round(F.col("events") / seconds, 2).alias("events_per_second"),
                F.round(seconds, 6).alias("processing_seconds"),
                lc.reduction_percent(F.col("keys"), F.col("peak_hot")).alias(
                    "peak_hot_reduction_percent"
                ),
            )
            # A handful of rows; stored so that the union stays a scan of small files.
            return stage(rows.coalesce(1), "summary")

        # The runs are independent jobs; only timed ones have the cluster to themselves.
        with ThreadPoolExecutor(1 if measure else 4) as pool:
            parts = list(pool.map(rows_of, named.values()))
        return _union(parts).select(*SUMMARY)

    def ordering(self) -> DataFrame:
        """Disorder and budget per scenario and mechanism."""
        total = F.count(F.lit(1))
        ooo = F.sum(F.col("out_of_order").cast("long"))
        disorder = inversions(self.obs, self.by).groupBy("scenario").agg(
            total.alias("events"),
            ooo.alias("ooo_events"),
            F.round(ooo / total, 6).alias("ooo_ratio"),
            F.sum(F.col("inversion").cast("long")).alias("inversions"),
            F.max("lateness").alias("max_lateness_seconds"),
        )
        parts = []
        for name, run in self.runs.items():
            if run.mech.budget == "none":
                continue
            report = budget_report(run.timed, run.mech.lateness, self.by, run.mech.budget)
            parts.append(
                disorder.join(report, "scenario").select(
                    F.lit(name).alias("mechanism"),
                    *disorder.columns,
                    "final_seconds",
                    "minimum_seconds",
                    "maximum_seconds",
                    "changes",
                    "mean_seconds",
                )
            )
        return _union(parts)


def correctness_table(summary: DataFrame) -> DataFrame:
    return summary.select(
        "scenario",
        "mechanism",
        "exact",
        F.col("result_rows").alias("rows"),
        F.col("missing_in_result").alias("missing"),
        F.col("extra_in_result").alias("extra"),
        F.col("field_mismatches").alias("field_mismatch"),
    )


def state_table(summary: DataFrame) -> DataFrame:
    return summary.select(
        "scenario",
        "mechanism",
        "peak_hot",
        "final_hot",
        F.col("final_archive").alias("archive"),
        "frozen",
        "reconciled",
        "late_after_finalization",
        "late_after_eviction",
        F.round("peak_hot_reduction_percent", 2).alias("peak_reduction_pct"),
    )


def runtime_table(summary: DataFrame, ordering: DataFrame) -> DataFrame:
    """Run time and budget side by side; mechanisms without a budget have nulls."""
    return summary.select(
        "scenario", "mechanism", "events_per_second", "processing_seconds"
    ).join(ordering, ["scenario", "mechanism"], "left")


def ablation(summary: DataFrame, ladder: Sequence[str] = LADDER) -> DataFrame:
    """What each rung of the ladder changes against the rung before.

    A rung has at most one row per scenario, so the step is an equi-join of the
    small summary with itself.
    """
    place = F.array_position(F.array(*[F.lit(x) for x in ladder]), F.col("mechanism"))
    rungs = summary.filter(F.col("mechanism").isin(*ladder)).withColumn("rung", place)
    fields = ("peak_hot", "final_archive", "frozen", "reconciled")
    earlier = rungs.select(
        "scenario",
        (F.col("rung") + 1).alias("rung"),
        *[F.col(c).alias(f"_{c}") for c in fields],
    )
    return rungs.join(earlier, ["scenario", "rung"], "left").select(
        "scenario",
        "rung",
        "mechanism",
        "exact",
        *fields,
        *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_change") for c in fields],
    )


def run_deltas(
    summary: DataFrame, base: str, other: str, shared_seconds: float = 0.0
) -> DataFrame:
    """Change of run times and throughput between two mechanisms, in percent of the first.

    End to end, both also take ``shared_seconds``; a change against 0 is null.
    """
    measures = {
        "end_to_end": F.col("processing_seconds") + shared_seconds,
        "processing": F.col("processing_seconds"),
        "throughput": F.col("events_per_second"),
    }

    def of(mechanism: str, prefix: str) -> DataFrame:
        return summary.filter(F.col("mechanism") == mechanism).select(
            "scenario", *[m.alias(f"{prefix}{name}") for name, m in measures.items()]
        )

    def change(name: str):
        old, new = F.col(f"old_{name}"), F.col(f"new_{name}")
        return F.when(old > 0, F.round((new - old) / old * 100, 4)).alias(f"{name}_change_percent")

    pairs = of(other, "new_").join(of(base, "old_"), "scenario")
    return pairs.select("scenario", *[change(name) for name in measures])
