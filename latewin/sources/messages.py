"""Events as JSON messages on a bus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewin.schema import MESSAGE


def encode_events(events: DataFrame, scenario: str = "") -> DataFrame:
    """``key`` and compact JSON ``value`` per event; the key keeps a series together.

    Needs event_id, event_time, device_id, sensor, value and arrival_sequence.
    """
    body = F.struct(
        "event_id",
        "event_time",
        "device_id",
        "sensor",
        "value",
        "arrival_sequence",
        F.lit(scenario).alias("scenario"),
    )
    return events.select(
        F.concat_ws("|", "device_id", "sensor").alias("key"), F.to_json(body).alias("value")
    )


def decode_events(messages: DataFrame) -> DataFrame:
    """Message columns, plus ``n``, from any table with a string or binary ``value``."""
    parsed = F.from_json(F.col("value").cast("string"), MESSAGE)
    return (
        messages.select(parsed.alias("m"))
        .select("m.*")
        .withColumn("n", F.col("arrival_sequence") + 1)
    )


def read_bus(
    spark: SparkSession, servers: str, topic: str, max_offsets_per_trigger: int | None = None
) -> DataFrame:
    """Stream of events from a Kafka topic, from its earliest offset.

    Run it with ``trigger(availableNow=True)`` to stop at the offsets present.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return decode_events(reader.load())


def write_bus(events: DataFrame, servers: str, topic: str, scenario: str = "") -> None:
    """Publish events; ``acks=all`` so that an acknowledged event is replicated."""
    (
        encode_events(events, scenario)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all")
        .option("topic", topic)
        .save()
    )
