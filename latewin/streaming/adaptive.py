"""Adaptive lateness, reconciliation and guarded release on a stream.

The summaries lie in a store of buckets by window end:

    root/store/version=b/bucket=K    all summaries of bucket K as of micro-batch b
    root/control/version=b/control.json    the scalars and the live buckets, written last

A micro-batch reads and writes only the buckets its events fall into; a bucket it does not hit
keeps the version that last wrote it, however many batches ago. Nothing is moved when windows
are archived or released: a summary's tier follows from its end, the version that opened it and
the control file. It is archived once the watermark has reached its end, and released once a
cycle from its opening on had its frontier there. The counts of the tiers are kept by window
end, for ends that are not released only, so they are as many as fit between the release
frontier and the newest window.

A version counts once its control file exists. A batch that is run again either finds its
control file and does nothing, or overwrites its unfinished version. A batch that carries a
committed number but other rows raises. A bucket's old version is deleted one batch after the
one that replaced it.

The last release cycle of a run changes counters only; it takes no version, so the stream can be
resumed with the next batch.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latewin.operators.lateness import arrival_lateness, budget_expression
from latewin.operators.windows import KEYS, PARTIALS, finish, window_partials
from latewin.schema import GuardConfig, LatenessConfig, WindowConfig
from latewin.session import scratch_dir
from latewin.sources.replay import (
    child_names,
    delete_path,
    path_exists,
    read_text,
    write_text,
)

#: Slides a bucket of the store covers, but never less than a window.
BUCKET_SLIDES = 64
_STORED = (
    "start long, device_id string, sensor string, count long, sum double, min double, "
    "max double, end long, opened long, added long, lost long"
)


@dataclass
class Control:
    """Scalars of the stream after a version; lists and maps are bounded as said above."""

    version: int = -1
    events: int = 0
    max_time: int | None = None
    first_time: int | None = None
    budget: int | None = None
    watermark: int | None = None
    max_lateness: int = 0
    max_overflow: int = 0
    ooo_events: int = 0
    over_budget_events: int = 0
    reconciled_events: int = 0
    late_after_eviction: int = 0
    hot: int = 0
    archive: int = 0
    frozen: int = 0
    peak_hot: int = 0
    peak_total: int = 0
    lateness: list = field(default_factory=list)
    out_of_order: list = field(default_factory=list)
    #: Rows, least and greatest arrival number, and sum of times of the batch itself.
    batch: list = field(default_factory=list)
    #: Summaries that are not released, by window end.
    held: dict = field(default_factory=dict)
    #: (version, frontier) of the cycles that no later one reaches beyond.
    releases: list = field(default_factory=list)
    #: The version that holds a bucket; one entry for BUCKET_SLIDES slides of event time.
    buckets: dict = field(default_factory=dict)
    #: (bucket, version) that this version replaced.
    replaced: list = field(default_factory=list)


class AdaptiveStream:
    """The controller of one stream, to be used as a ``foreachBatch`` function."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        cfg: WindowConfig = WindowConfig(),
        lateness: LatenessConfig = LatenessConfig(),
        guard: GuardConfig | None = None,
        cycle_batches: int = 1,
        drop_late_after_eviction: bool = True,
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.cfg, self.lateness, self.guard = cfg, lateness, guard
        self.cycle_batches = cycle_batches
        self.drop_late = drop_late_after_eviction
        self.closing: Control | None = None
        self.span = cfg.slide * max(BUCKET_SLIDES, cfg.window // cfg.slide)

    # -- versions -------------------------------------------------------------

    def _control_path(self, version: int) -> str:
        return f"{self.root}/control/version={version}/control.json"

    def _version_path(self, version: int) -> str:
        return f"{self.root}/store/version={version}"

    def control(self, version: int) -> Control:
        if version < 0:
            return Control()
        path = self._control_path(version)
        if not path_exists(self.spark, path):
            raise RuntimeError(f"state version {version} is missing below {self.root}")
        return Control(**json.loads(read_text(self.spark, path)))

    def last_version(self) -> int:
        names = child_names(self.spark, f"{self.root}/control")
        # Only the newest folders can lack their file, so few are asked for.
        for version in sorted((int(n.split("=")[1]) for n in names), reverse=True):
            if path_exists(self.spark, self._control_path(version)):
                return version
        return -1

    def _commit(self, control: Control) -> None:
        text = json.dumps(asdict(control))
        write_text(self.spark, self._control_path(control.version), text)

    # -- the store --------------------------------------------------------------

    def bucket_path(self, control: Control, bucket: str) -> str:
        return f"{self._version_path(control.buckets[bucket])}/bucket={bucket}"

    def stored(self, control: Control, buckets: list[str] | None = None) -> DataFrame:
        """Summaries of the live buckets, or of those among ``buckets``."""
        wanted = control.buckets if buckets is None else buckets
        paths = [self.bucket_path(control, k) for k in wanted if k in control.buckets]
        if not paths:
            return self.spark.createDataFrame([], _STORED)
        return self.spark.read.schema(_STORED).parquet(*paths)

    @staticmethod
    def _released(control: Control, opened: Column) -> Column:
        """Whether a cycle from the opening on had its frontier at the window's end."""
        free = F.lit(False)
        for version, frontier in control.releases:
            free = free | ((opened <= version) & (F.col("end") <= frontier))
        return free

    def state(self, version: int) -> DataFrame:
        """Hot and archived summaries of a version, with their tier."""
        now = self.control(version)
        tier = F.when(F.col("end") <= F.lit(now.watermark).cast("long"), "archive").otherwise("hot")
        held = self.stored(now).filter(~self._released(now, F.col("opened")))
        return held.select("start", *KEYS, *PARTIALS, "end", tier.alias("tier"))

    def final(self, version: int) -> DataFrame:
        """Released summaries as of a version."""
        now = self.control(version)
        gone = self.stored(now).filter(self._released(now, F.col("opened")))
        return gone.select("start", *KEYS, *PARTIALS, "end", F.lit("final").alias("tier"))

    # -- one micro-batch --------------------------------------------------------

    @staticmethod
    def _signature() -> list[Column]:
        return [
            F.count(F.lit(1)),
            F.min("n"),
            F.max("n"),
            F.sum(F.col("event_time").cast("long")),
        ]

    def __call__(self, batch: DataFrame, version: int) -> None:
        self.spark = batch.sparkSession
        if path_exists(self.spark, self._control_path(version)):
            committed = self.control(version).batch
            signature = list(batch.agg(*self._signature()).first())
            if committed != signature:
                raise RuntimeError(
                    f"batch {version} is committed with {committed} and came again as {signature}"
                )
            return
        before = self.control(version - 1)
        now = Control(**{**asdict(before), "version": version, "replaced": []})
        # Recomputed from the source if an executor is lost with its part of it.
        obs = arrival_lateness(batch).persist()
        try:
            touched = self._observe(obs, before, now)
            if now.watermark is not None:
                if touched:
                    self._merge(window_partials(obs, self.cfg), touched, before, now)
                self._archive_and_release(now, (version + 1) % self.cycle_batches == 0)
            self._commit(now)
        finally:
            obs.unpersist()
        for bucket, old in before.replaced:
            delete_path(self.spark, f"{self._version_path(old)}/bucket={bucket}")

    def _observe(self, obs: DataFrame, before: Control, now: Control) -> list[str]:
        """Batch statistics, the new budget and watermark; the buckets that the batch hits."""
        policy = self.lateness
        carried = F.lit(before.max_time).cast("long")
        top = F.greatest("max_before", carried)
        obs = obs.withColumn(
            "lateness",
            F.greatest(F.coalesce(top - F.col("event_time"), F.lit(0)), F.lit(0)),
        )
        # Events were admitted under the budget in force before this batch.
        admitted = policy.initial if before.budget is None else before.budget
        pane = F.floor(F.col("event_time") / self.cfg.slide) * self.cfg.slide
        ends = (pane + self.cfg.slide, pane + self.cfg.window)
        stats = obs.agg(
            *self._signature(),
            F.max("event_time").alias("max_time"),
            F.min_by("event_time", "n").alias("first_time"),
            F.max_by("event_time", "n").alias("last_time"),
            F.max("lateness").alias("max_lateness"),
            F.count(F.when(F.col("lateness") > 0, 1)).alias("ooo"),
            F.count(F.when(F.col("lateness") > admitted, 1)).alias("over"),
            # A bucket covers a window at least, so an event's ends are in two at most.
            *[F.collect_set(F.floor(e / self.span)).alias(f"hit{i}") for i, e in enumerate(ends)],
        ).first()
        now.batch = list(stats[:4])
        if not stats[0]:
            return []
        tail = obs.orderBy(F.col("n").desc()).limit(policy.history).select("lateness").collect()
        recent = [r.lateness for r in reversed(tail)]
        now.events += stats[0]
        now.ooo_events += stats.ooo
        now.max_time = max(stats.max_time, before.max_time or stats.max_time)
        now.first_time = stats.first_time if before.first_time is None else before.first_time
        now.lateness = (before.lateness + recent)[-policy.history :]
        now.out_of_order = [x > 0 for x in now.lateness]
        if before.budget is None:
            now.budget = policy.initial
        if now.events >= policy.min_observations:
            now.budget = self._budget(now, stats.last_time)
        reach = now.max_time - now.budget
        now.watermark = reach if before.watermark is None else max(before.watermark, reach)
        now.over_budget_events += stats.over
        now.max_lateness = max(before.max_lateness, stats.max_lateness)
        if now.budget > 0:
            now.max_overflow = max(before.max_overflow, stats.max_lateness - now.budget)
        return [str(k) for k in sorted({*stats.hit0, *stats.hit1})]

    def _budget(self, now: Control, last_time: int) -> int:
        """The batch operator's expression over one row of signals.

        Hot-state size and memory pressure are those of the previous version,
        which is how the state feeds back into the budget.
        """
        span = now.max_time - now.first_time
        pressure = (
            min(1.0, (now.hot + now.archive) / (now.peak_total * 1.5)) if now.peak_total else 0.0
        )
        signals = self.spark.createDataFrame(
            [
                (
                    float(np.percentile(now.lateness, self.lateness.cut * 100)),
                    float(np.mean(now.out_of_order)),
                    float(now.max_time - last_time),
                    now.events / span if span > 0 else float(now.events),
                    float(now.hot),
                    pressure,
                )
            ],
            "lateness_percentile double, ooo_ratio double, watermark_lag double, "
            "arrival_rate double, state_size double, memory_utilization double",
        )
        return signals.select(budget_expression(self.lateness)).first()[0]

    def guard_seconds(self, control: Control) -> int:
        if self.guard.policy == "fixed":
            return self.guard.seconds
        budget = control.budget or 0
        return max(1, budget, control.max_lateness + 1, control.max_overflow + budget)

    def _merge(
        self, partials: DataFrame, touched: list[str], before: Control, now: Control
    ) -> None:
        """Merge the batch into the buckets it hits and write those as a new version.

        A key that was released takes nothing more; what it would have taken is ``lost``.
        """
        old = self.stored(before, touched).select(
            "start", "end", *KEYS, *PARTIALS, "opened", F.lit(0).cast("long").alias("added")
        )
        new = partials.select(
            "start",
            (F.col("start") + self.cfg.window).alias("end"),
            *KEYS,
            *PARTIALS,
            F.lit(None).cast("long").alias("opened"),
            F.col("count").alias("added"),
        )
        kinds = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
        held = F.col("opened").isNotNull()
        both = (
            old.unionByName(new)
            .groupBy("start", "end", *KEYS)
            .agg(
                *[f(c).alias(f"{c}_all") for c, f in kinds.items()],
                *[f(F.when(held, F.col(c))).alias(f"{c}_old") for c, f in kinds.items()],
                F.max("opened").alias("opened"),
                F.sum("added").alias("added"),
            )
        )
        gone = F.coalesce(self._released(before, F.col("opened")), F.lit(False))
        path = self._version_path(now.version)
        (
            both.select(
                "start",
                *KEYS,
                *[F.when(gone, F.col(f"{c}_old")).otherwise(F.col(f"{c}_all")).alias(c) for c in PARTIALS],
                "end",
                F.coalesce("opened", F.lit(now.version)).cast("long").alias("opened"),
                F.when(gone, F.lit(0)).otherwise(F.col("added")).cast("long").alias("added"),
                F.when(gone, F.col("added")).otherwise(F.lit(0)).cast("long").alias("lost"),
                F.floor(F.col("end") / self.span).alias("bucket"),
            )
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(path)
        )
        now.replaced = [[k, before.buckets[k]] for k in touched if k in before.buckets]
        now.buckets = {**before.buckets, **dict.fromkeys(touched, now.version)}
        reached = F.lit(before.watermark).cast("long")
        late = (F.col("opened") < now.version) & (F.col("end") <= reached)
        # One row for every window end of the buckets hit.
        ends = (
            self.stored(now, touched)
            .groupBy("end")
            .agg(
                F.count(F.when(F.col("opened") == now.version, 1)).alias("fresh"),
                F.sum(F.when(late, F.col("added")).otherwise(0)).alias("reconciled"),
                F.sum("lost").alias("lost"),
            )
            .collect()
        )
        lost = sum(r.lost for r in ends)
        if lost and not self.drop_late:
            raise RuntimeError(f"{lost} late events after eviction")
        now.late_after_eviction += lost
        now.reconciled_events += sum(r.reconciled for r in ends)
        now.held = dict(before.held)
        for r in ends:
            if r.fresh:
                now.held[str(r.end)] = now.held.get(str(r.end), 0) + r.fresh

    def _archive_and_release(self, now: Control, release: bool) -> None:
        """The tiers' counts under the new watermark and, in a cycle, the new frontier."""
        if release and self.guard is not None:
            frontier = now.watermark - self.guard_seconds(now)
            out = {end: n for end, n in now.held.items() if int(end) <= frontier}
            now.frozen += sum(out.values())
            now.held = {end: n for end, n in now.held.items() if end not in out}
            # A frontier that a later cycle reaches or passes says nothing more.
            now.releases = [r for r in now.releases if r[1] > frontier] + [[now.version, frontier]]
        now.archive = sum(n for end, n in now.held.items() if int(end) <= now.watermark)
        now.hot = sum(now.held.values()) - now.archive
        now.peak_hot = max(now.peak_hot, now.hot)
        now.peak_total = max(now.peak_total, now.hot + now.archive)

    # -- end of stream ------------------------------------------------------------

    def finish(self) -> DataFrame:
        """All window rows of the stream after a last release cycle.

        The cycle's counters are in ``closing``. Nothing is committed: more batches may
        follow and another finish after them.
        """
        last = self.last_version()
        self.closing = self.control(last)
        if last >= 0 and self.guard is not None and self.closing.watermark is not None:
            self.closing.batch = []
            self._archive_and_release(self.closing, release=True)
        return self.rows(last)

    def rows(self, version: int) -> DataFrame:
        """Window rows of all tiers of a version; a key is in exactly one of them."""
        return finish(self.stored(self.control(version)), self.cfg)

    def report(self) -> DataFrame:
        """Counters of every version as a table."""
        lines = self.spark.read.text(f"{self.root}/control")
        schema = (
            "version long, events long, max_time long, budget long, watermark long, "
            "max_lateness long, ooo_events long, over_budget_events long, "
            "reconciled_events long, late_after_eviction long, hot long, archive long, "
            "frozen long, peak_hot long"
        )
        return lines.select(F.from_json("value", schema).alias("c")).select("c.*")


def run_adaptive(
    events: DataFrame, controller: AdaptiveStream, checkpoint: str | None = None
) -> DataFrame:
    """Drain a stream of events (with ``n``) through the controller; all window rows."""
    spark = events.sparkSession
    query = (
        events.writeStream.foreachBatch(controller)
        .option("checkpointLocation", checkpoint or scratch_dir(spark, "adaptive-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return controller.finish()
