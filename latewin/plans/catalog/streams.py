"""Streaming forms, replayed from the events table in arrival order."""

from __future__ import annotations

from pyspark.sql import functions as F

from latewin.plans import bindings as b
from latewin.plans.catalog import sql as s
from latewin.plans.catalog.registry import query
from latewin.schema import GuardConfig
from latewin.session import scratch_dir
from latewin.sources.replay import read_replay, write_replay
from latewin.streaming.adaptive import AdaptiveStream, run_adaptive
from latewin.streaming.windows import (
    IDENTITY,
    run_deduplicated,
    run_fixed_lateness,
    run_full_retention,
    run_keyed_state,
)

W = b.WINDOW
PLAIN = f"WITH {s.arr()}, {s.pairs(W, 'arr')} {s.agg()}"
BLOCKS = 4
# Above the largest lateness of the disordered table at every scale factor.
DELAY = 5 * 86400


def _stream(spark, d):
    """The arrivals cut into a few blocks and replayed one per micro-batch."""
    path = scratch_dir(spark, "replay")
    events = b.arrivals(spark, d).select("n", "event_time", "device_id", "sensor", "value")
    write_replay(events, path, -(-b.canonical(spark, d).count() // BLOCKS))
    return read_replay(spark, path, events.schema)


def _round(rows):
    return rows.withColumns({c: F.round(c, 6) for c in ("sum", "avg")})


@query("stream_window_full", PLAIN)
def stream_window_full(spark, d):
    return _round(run_full_retention(_stream(spark, d), W))


@query("stream_window_fixed", PLAIN)
def stream_window_fixed(spark, d):
    return _round(run_fixed_lateness(_stream(spark, d), DELAY, W))


@query("stream_keyed_state", PLAIN)
def stream_keyed_state(spark, d):
    return _round(run_keyed_state(_stream(spark, d), DELAY, W))


@query("stream_distinct", f"WITH {s.EV} SELECT DISTINCT {', '.join(IDENTITY)} FROM ev")
def stream_distinct(spark, d):
    """Every third reading arrives twice more, some in a later micro-batch."""
    path = scratch_dir(spark, "replay")
    events = b.arrivals(spark, d).select("n", *IDENTITY)
    again = events.filter("n % 3 = 0").withColumn("n", F.explode(F.array(F.col("n") + 1, F.col("n") + 500)))
    write_replay(events.unionByName(again), path, -(-b.canonical(spark, d).count() // BLOCKS))
    return run_deduplicated(read_replay(spark, path, events.schema), DELAY)


@query("stream_adaptive_union", PLAIN)
def stream_adaptive_union(spark, d):
    """Adaptive budget, reconciliation and guarded release; nothing may be lost."""
    controller = AdaptiveStream(
        spark,
        scratch_dir(spark, "adaptive"),
        W,
        b.LATENESS,
        GuardConfig("fixed", DELAY),
        drop_late_after_eviction=False,
    )
    return _round(run_adaptive(_stream(spark, d), controller))


@query("stream_adaptive_resume", PLAIN)
def stream_adaptive_resume(spark, d):
    """The same in two runs from one checkpoint, each finished; the second goes on."""
    path, checkpoint = scratch_dir(spark, "replay"), scratch_dir(spark, "adaptive-checkpoint")
    controller = AdaptiveStream(
        spark,
        scratch_dir(spark, "adaptive"),
        W,
        b.LATENESS,
        GuardConfig("fixed", DELAY),
        drop_late_after_eviction=False,
    )
    events = b.arrivals(spark, d).select("n", "event_time", "device_id", "sensor", "value")
    half = events.count() // 2
    for part in (F.col("n") <= half, F.col("n") > half):
        events.filter(part).write.mode("append").parquet(path)
        source = spark.readStream.schema(events.schema).parquet(path)
        rows = run_adaptive(source, controller, checkpoint)
    return _round(rows)


@query("stream_adaptive_report")
def stream_adaptive_report(spark, d):
    """Counters per state version; they depend on how the stream is cut into batches."""
    controller = AdaptiveStream(
        spark, scratch_dir(spark, "adaptive"), W, b.LATENESS, GuardConfig("adaptive", b.GUARD)
    )
    run_adaptive(_stream(spark, d), controller)
    return controller.report()
