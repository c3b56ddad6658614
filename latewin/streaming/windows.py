"""Plain streaming window aggregates: full retention, fixed lateness, keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from latewin.operators.windows import (
    KEYS,
    PARTIALS,
    finish,
    pane_of,
    partial_aggregates,
    windows_of_panes,
)
from latewin.schema import WindowConfig
from latewin.session import scratch_dir


def _drain(writer, checkpoint: str) -> None:
    query = (
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of every key over all batches written below ``path``."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in keys and c != "batch_id"]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "batch_id").alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def run_full_retention(events: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """Window rows of a stream that never finalises; changed panes are written per batch.

    The state holds slide-long panes, so an event meets one row of state however many windows
    cover it; the windows are put together when the result is read. A repeated batch
    overwrites its own folder, so the output is exactly-once.
    """
    spark = events.sparkSession
    out, checkpoint = scratch_dir(spark, "full-rows"), scratch_dir(spark, "full-checkpoint")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    pane = F.window(F.timestamp_seconds("event_time"), f"{cfg.slide} seconds")
    panes = (
        events.groupBy(pane.alias("w"), *KEYS)
        .agg(*partial_aggregates())
        .select(F.col("w.start").cast("long").alias("start"), *KEYS, *PARTIALS)
    )
    _drain(panes.writeStream.outputMode("update").foreachBatch(sink), checkpoint)
    return finish(windows_of_panes(_latest(spark, out, ["start", *KEYS]), cfg), cfg)


def run_fixed_lateness(
    events: DataFrame, delay_seconds: int, cfg: WindowConfig = WindowConfig()
) -> DataFrame:
    """Window rows under Spark's own watermark; later events are dropped.

    Windows the watermark has passed are emitted as they close. Those still open when
    the data ends are read from the query's state, so the result is whole.
    """
    spark = events.sparkSession
    out, checkpoint = scratch_dir(spark, "fixed-rows"), scratch_dir(spark, "fixed-checkpoint")
    stamped = events.withColumn("ts", F.timestamp_seconds("event_time")).withWatermark(
        "ts", f"{delay_seconds} seconds"
    )
    window = F.window("ts", f"{cfg.window} seconds", f"{cfg.slide} seconds")
    rows = (
        stamped.groupBy(window.alias("w"), *KEYS)
        .agg(*partial_aggregates())
        .select(F.col("w.start").cast("long").alias("start"), *KEYS, *PARTIALS)
    )
    _drain(
        rows.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint
    )
    closed = spark.read.schema(rows.schema).parquet(out)
    held = spark.read.format("statestore").load(checkpoint)
    window_key, *series = held.schema["key"].dataType.names
    buffers = held.schema["value"].dataType.names[-len(PARTIALS) :]
    still_open = held.select(
        F.col(f"key.`{window_key}`.start").cast("long").alias("start"),
        *[F.col(f"key.`{k}`").alias(c) for k, c in zip(series, KEYS, strict=True)],
        *[F.col(f"value.`{v}`").alias(c) for v, c in zip(buffers, PARTIALS, strict=True)],
    )
    return finish(closed.unionByName(still_open), cfg)


IDENTITY = ("event_time", "device_id", "sensor", "value")


def run_deduplicated(events: DataFrame, delay_seconds: int) -> DataFrame:
    """Distinct readings of a stream, by all four columns of their identity.

    A repeat has the time of its first, so the state forgets a reading once the watermark is
    ``delay_seconds`` past it: repeats are found as long as they are no later than that.
    """
    spark = events.sparkSession
    out, checkpoint = scratch_dir(spark, "distinct-rows"), scratch_dir(spark, "distinct-checkpoint")
    rows = (
        events.select(*IDENTITY, F.timestamp_seconds("event_time").alias("ts"))
        .withWatermark("ts", f"{delay_seconds} seconds")
        .dropDuplicatesWithinWatermark(list(IDENTITY))
        .select(*IDENTITY)
    )
    _drain(rows.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint)
    return spark.read.schema(rows.schema).parquet(out)


_PANE = ("start", *PARTIALS)
_SERIES_PANES = (
    "device_id string, sensor string, start long, count long, sum double, min double, max double"
)
# A series' panes as one value, a list a column: one message to the store and one back.
_SERIES_STATE = (
    "start array<long>, count array<long>, sum array<double>, min array<double>, max array<double>,"
    " closed long, timer long"
)
# Panes a task holds back to combine them with those of its next batches.
HELD_PANES = 65_536


def _merge_panes(rows: pa.Table) -> pa.Table:
    merged = rows.group_by([*KEYS, "start"]).aggregate(
        [("count", "sum"), ("sum", "sum"), ("min", "min"), ("max", "max")]
    )
    return merged.select([*KEYS, "start", "count_sum", "sum_sum", "min_min", "max_max"]).rename_columns(
        [*KEYS, *_PANE]
    )


def _panes_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Combine a task's readings by series and pane, so that a hot series leaves it as one
    row a pane; more than HELD_PANES different panes are passed on."""
    held: list[pa.Table] = []
    for batch in batches:
        value = batch.column("value")
        one = pa.array(np.ones(batch.num_rows, np.int64))
        columns = [batch.column(c) for c in (*KEYS, "start")]
        rows = pa.table([*columns, one, value, value, value], names=[*KEYS, *_PANE])
        held.append(_merge_panes(rows))
        if sum(t.num_rows for t in held) > HELD_PANES:
            held = [_merge_panes(pa.concat_tables(held))]
            if held[0].num_rows > HELD_PANES // 2:
                yield from held.pop().to_batches()
    if held:
        yield from _merge_panes(pa.concat_tables(held)).to_batches()


class OpenPanes(StatefulProcessor):
    """The panes of a series that a window still open needs.

    State is the panes, the time up to which windows are closed, and the one timer of
    the series, set to the next end of a window with readings. When the watermark passes
    it, all windows that end at or before the watermark are emitted, once each, and panes
    that no later window covers are forgotten; with the last pane the rest goes too.
    """

    def __init__(self, cfg: WindowConfig):
        self._window, self._slide = cfg.window, cfg.slide

    def init(self, handle) -> None:
        self._handle = handle
        self._series = handle.getValueState("series", _SERIES_STATE)

    def handleInputRows(self, key, rows, timerValues):
        state = self._series.get()
        *columns, closed, timer = state or ([],) * len(_PANE) + (self._passed(timerValues), None)
        arrived = [batch[list(_PANE)] for batch in rows]
        self._keep(self._combine(pd.concat([self._frame(columns), *arrived])), closed, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        *columns, closed, _ = self._series.get()
        passed = max(closed, self._passed(timerValues))
        held = self._frame(columns)
        covering = np.arange(0, self._window, self._slide)
        windows = held.loc[held.index.repeat(len(covering))]
        windows["start"] -= np.tile(covering, len(held))
        end = windows["start"] + self._window
        ended = self._combine(windows[(end > closed) & (end <= passed)])
        self._keep(held, passed, None)
        for i, name in enumerate(KEYS):
            ended.insert(i, name, key[i])
        yield ended

    def close(self) -> None:
        pass

    def _passed(self, timerValues) -> int:
        """The last possible end of a window at or before the watermark."""
        return timerValues.getCurrentWatermarkInMs() // 1000 // self._slide * self._slide

    def _frame(self, columns) -> pd.DataFrame:
        kinds = dict.fromkeys(_PANE, "float64") | {"start": "int64", "count": "int64"}
        return pd.DataFrame(dict(zip(_PANE, columns, strict=True))).astype(kinds)

    def _combine(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.groupby("start", as_index=False).agg(
            {"count": "sum", "sum": "sum", "min": "min", "max": "max"}
        )

    def _keep(self, panes: pd.DataFrame, closed: int, timer: int | None) -> None:
        """Store the panes that a window ending after ``closed`` covers, and set the timer."""
        panes = panes[panes["start"] + self._window > closed]
        due = None
        if len(panes):
            due = int(max(panes["start"].min(), closed)) + self._slide
            self._series.update((*[panes[c].tolist() for c in _PANE], closed, due))
        else:
            self._series.clear()
        if timer != due:
            if timer is not None:
                self._handle.deleteTimer(timer * 1000)
            if due is not None:
                self._handle.registerTimer(due * 1000)


def run_keyed_state(
    events: DataFrame, delay_seconds: int, cfg: WindowConfig = WindowConfig()
) -> DataFrame:
    """Window rows from per-series panes whose windows close by event-time timers.

    Tasks combine their readings to panes before the exchange, so a series with a third of all
    events sends a row a pane and task. The watermark is ``delay_seconds`` behind the start of the
    latest pane; a reading all of whose windows have ended by then is dropped, another counts in
    those of its windows that are not closed. Windows still open when the data ends are put
    together from the state, so the result is whole. Values are validated readings (no null,
    no NaN) from 1970 on, where Spark's watermarks begin. The state needs the RocksDB store.
    """
    spark = events.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(
        provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    out, checkpoint = scratch_dir(spark, "keyed-rows"), scratch_dir(spark, "keyed-checkpoint")
    panes = (
        events.select(*KEYS, pane_of(F.col("event_time"), cfg.slide).alias("start"), "value")
        .mapInArrow(_panes_of_task, _SERIES_PANES)
        # A pane is late when its last window has ended.
        .withColumn("last_end", F.timestamp_seconds(F.col("start") + cfg.window))
        .withWatermark("last_end", f"{delay_seconds + cfg.window} seconds")
    )
    rows = panes.groupBy(*KEYS).transformWithStateInPandas(
        OpenPanes(cfg), _SERIES_PANES, "append", "eventTime"
    )
    try:
        _drain(rows.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint)
        held = spark.read.format("statestore").option("stateVarName", "series").load(checkpoint)
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    ended = spark.read.schema(rows.schema).parquet(out)
    listed = F.arrays_zip(*[F.col(f"value.{c}").alias(c) for c in _PANE])
    open_panes = held.select("key.*", F.explode(listed).alias("pane")).select(*KEYS, "pane.*")
    still_open = windows_of_panes(open_panes, cfg).join(
        held.select("key.*", "value.closed"), list(KEYS)
    ).filter(F.col("start") + cfg.window > F.col("closed"))
    return finish(ended.unionByName(still_open.drop("closed")), cfg)
