"""Reading the ``events`` table as a disordered sensor stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewin.operators.disorder import (
    DEFAULT_BUFFER,
    SCENARIOS,
    displacement,
    inject_disorder,
)
from latewin.operators.lateness import observe_arrivals
from latewin.operators.ordering import BLOCK_ROWS
from latewin.plans.mechanisms import presets
from latewin.schema import LatenessConfig, WindowConfig

# The table holds a few hundred events per day, hence hours instead of seconds.
WINDOW = WindowConfig(window=21600, slide=3600)
TUMBLING = WindowConfig(window=21600, slide=21600)
LATENESS = LatenessConfig(initial=3600, minimum=600, maximum=7200)
TIGHT = LatenessConfig(initial=600, minimum=60, maximum=900)
# Histories that overlap and are no multiple of the interval.
LONG_HISTORY = LatenessConfig(
    initial=3600, minimum=600, maximum=7200, history=250, min_observations=130, interval=100
)
CYCLE = 100
GUARD = 1800


def mechanisms(lateness: LatenessConfig = LATENESS):
    return presets(
        fixed_seconds=3600,
        guard_seconds=GUARD,
        cycle_events=CYCLE,
        aggressive_seconds=600,
        lateness=lateness,
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-order events: i, event_time, device_id, sensor, value."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("i"),
        F.floor(F.unix_micros(ts) / 1_000_000).cast("long").alias("event_time"),
        F.concat(F.lit("D"), (F.col("user_id") % 3).cast("string")).alias("device_id"),
        F.col("event_type").alias("sensor"),
        "value",
    )


def arrivals(
    spark: SparkSession, sf_dir: str, scenario: str = "heavy_ooo"
) -> DataFrame:
    """The same events in a disordered arrival order ``n``."""
    p = SCENARIOS[scenario].disorder_probability
    return inject_disorder(canonical(spark, sf_dir), p, seed=0)


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events once per scenario."""
    profiles = F.explode(
        F.array(
            *[
                F.struct(F.lit(s.name).alias("scenario"), F.lit(s.disorder_probability).alias("p"))
                for s in SCENARIOS.values()
            ]
        )
    )
    return canonical(spark, sf_dir).withColumn("_s", profiles).select("*", "_s.*").drop("_s")


def all_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events once per scenario, each in its own arrival order."""
    tagged = _tagged(spark, sf_dir)
    return inject_disorder(tagged, F.col("p"), seed=0, by=["scenario"]).drop("p")


def observed(spark: SparkSession, sf_dir: str, scenario: str = "heavy_ooo") -> DataFrame:
    """Arrival index and lateness observations in one scan."""
    rows = canonical(spark, sf_dir)
    shift = displacement(
        F.col("i"), SCENARIOS[scenario].disorder_probability, DEFAULT_BUFFER, 0
    )
    keyed = rows.withColumn("_key", F.col("i") + shift)
    block = F.floor(F.col("_key") / BLOCK_ROWS)
    return observe_arrivals(keyed, ["_key", "i"], block).drop("_key")


def observed_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tagged(spark, sf_dir)
    shift = displacement(F.col("i"), F.col("p"), DEFAULT_BUFFER, 0)
    keyed = rows.withColumn("_key", F.col("i") + shift)
    block = F.floor(F.col("_key") / BLOCK_ROWS)
    return observe_arrivals(keyed, ["_key", "i"], block, ["scenario"]).drop("_key", "p")
