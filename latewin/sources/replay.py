"""Replaying a bounded table as a stream, in arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, where = _files(spark, path)
    return fs.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that it appears whole or not at all."""
    fs, target = _files(spark, path)
    _, draft = _files(spark, path + "._draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, target):
        fs.delete(target, False)
        fs.rename(draft, target)


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _files(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def child_names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def delete_path(spark: SparkSession, path: str) -> None:
    fs, where = _files(spark, path)
    fs.delete(where, True)


def write_replay(events: DataFrame, path: str, rows_per_block: int) -> None:
    """Cut the arrivals into consecutive blocks, one file each, dated in block order.

    The file source serves files by modification time, so the dates make it
    replay block after block. Setting them touches file metadata only.
    """
    block = F.floor((F.col("n") - 1) / rows_per_block)
    spark = events.sparkSession
    (
        events.withColumn("replay_block", block)
        .repartition("replay_block")
        .sortWithinPartitions("replay_block", "n")
        .write.partitionBy("replay_block")
        .parquet(path)
    )
    fs, where = _files(spark, path)
    dirs = [s.getPath() for s in fs.listStatus(where) if s.isDirectory()]
    base = spark._jvm.java.lang.System.currentTimeMillis() - 1000 * (len(dirs) + 1)
    for d in dirs:
        number = int(d.getName().split("=")[1])
        for f in fs.listStatus(d):
            fs.setTimes(f.getPath(), base + 1000 * number, -1)


def read_replay(
    spark: SparkSession, path: str, schema, files_per_trigger: int = 1
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )
