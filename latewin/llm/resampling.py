"""Importance resampling towards a target distribution over hashed word features.

Features are runs of 1 to ``order`` consecutive words (see ``byte_words``), joined by one
blank; a feature's bucket is the CRC-32 of its bytes modulo ``buckets``. The checksum of a
run continues that of the run without its last word, so no joined string is made:
``crc32(b" " + word, crc32(run))``. Counters reduce the features of a task to at most
``buckets`` rows; Spark adds those up. Counts cover all rows of both tables.

A bucket's gain is the logarithm of its smoothed share in the target over that in the
documents; a document's weight is the mean gain of its features. Weight plus Gumbel noise,
which depends on the doc_id alone, ranks the documents: the highest scores are a draw
without replacement in proportion to the importance weights.

The only thing that travels to the tasks is one gain for every bucket (``buckets`` is a
parameter), so its size does not depend on the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latewin.llm.byte_words import STRETCH, stretches
from latewin.llm.tables import text_of
from latewin.operators.ordering import with_arrival_index
from latewin.session import stage

#: Distinct checksums a task counts before it adds them to its buckets.
COUNTED = 200_000


@dataclass(frozen=True)
class Resampling:
    order: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: int = 2024


def feature_hashes(data: bytes, order: int, size: int = STRETCH) -> Iterator[tuple[int, list[int]]]:
    """(words, checksums of all runs that end in them) for every stretch of a text."""
    before: list[bytes] = []
    for fresh in stretches(data, size):
        # A run may begin in the stretch before.
        words = before + fresh
        spaced = [b" " + w for w in words] if order > 1 else words
        level = list(map(crc32, words))
        found = level[len(before) :]
        for n in range(2, order + 1):
            level = list(map(crc32, spaced[n - 1 :], level))
            found += level[max(0, len(before) - n + 1) :]
        yield len(fresh), found
        before = words[max(0, len(words) - order + 1) :] if order > 1 else []


def _texts(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, text_of().cast("binary").alias("text"))


def bucket_counts(docs: DataFrame, cfg: Resampling) -> DataFrame:
    """(bucket, n) over all texts; buckets that hold nothing have no row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cfg.buckets, dtype=np.int64)
        seen: Counter[int] = Counter()

        def settle():
            at = np.fromiter(seen.keys(), dtype=np.int64, count=len(seen))
            np.add.at(total, at % cfg.buckets, np.fromiter(seen.values(), np.int64, len(seen)))
            seen.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, hashes in feature_hashes(text, cfg.order):
                    seen.update(hashes)
                    if len(seen) > COUNTED:
                        settle()
        settle()
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    found = _texts(docs).mapInArrow(count, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, cfg: Resampling) -> np.ndarray:
    """One gain for every bucket, in thousandths, rounded down."""
    held, wanted = [0] * cfg.buckets, [0] * cfg.buckets
    both = bucket_counts(docs, cfg).withColumn("wanted", F.lit(False)).unionByName(
        bucket_counts(target, cfg).withColumn("wanted", F.lit(True))
    )
    for row in both.collect():  # two rows a bucket at most
        (wanted if row.wanted else held)[row.bucket] = row.n
    below, above = float(sum(held) + cfg.buckets), float(sum(wanted) + cfg.buckets)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * below / ((s + 1) * above)))
            for s, t in zip(held, wanted, strict=True)
        ],
        dtype=np.int64,
    )


def weights(docs: DataFrame, gain: np.ndarray, cfg: Resampling) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = features = total = 0
                for fresh, hashes in feature_hashes(text, cfg.order):
                    at = np.array(hashes, dtype=np.int64) % cfg.buckets
                    words, features = words + fresh, features + len(hashes)
                    total += int(gain[at].sum())
                out.append((words, features, total // features if features else 0))
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs, "doc_id").mapInArrow(
        weigh, f"doc_id {kind}, n_words long, n_features long, weight long"
    )


def gumbel(seed: int) -> Column:
    """Noise in thousandths, rounded down, from the doc_id; null counts as no digits."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    first = F.substring(F.sha2(name.cast("binary"), 256), 1, 8)
    share = (F.conv(first, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def draw(rows: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """Add ``rank``: 1, 2, 3 ... by score, then doc_id, for the highest floor(percent * N / 100)
    of the N eligible rows; null for all others.

    Rows are first counted by score. Scores are whole thousandths of a bounded logarithm plus
    noise of at most 22.2, so that table has some hundred thousand rows at any input size. It
    gives the score at which the draw ends; only rows from there on are ordered, in one block
    for every score.
    """
    best_first = Window.orderBy(F.desc("score"))
    by_score = rows.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    placed = by_score.select(
        "score",
        F.sum("n").over(Window.partitionBy()).alias("all_rows"),
        F.coalesce(F.sum("n").over(best_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("before"),
    ).withColumn("drawn", F.expr(f"all_rows * {int(percent)} div 100"))
    end = placed.where("before < drawn").agg(F.min("score").alias("cut"), F.max("drawn").alias("drawn")).first()
    none = F.lit(None).cast("long")
    if end.cut is None:
        return rows.withColumn("rank", none)
    inside = F.coalesce(eligible & (F.col("score") >= end.cut), F.lit(False))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"]
    numbered = with_arrival_index(rows.where(inside), order, -F.col("score"), name="rank")
    return numbered.select(
        *rows.columns, F.when(F.col("rank") <= end.drawn, F.col("rank")).alias("rank")
    ).unionByName(rows.where(~inside).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, cfg: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row.

    Null and empty texts have no features and weight 0; a document with fewer than
    ``least_words`` words is scored and never drawn. Repeated rows are scored and ranked each.
    Of equal scores the smaller doc_id ranks first, a null doc_id last. Empty tables count as
    no features: without documents no rows, without a target the smoothing alone. Other
    columns of the tables are ignored.
    """
    scored = stage(
        weights(docs, gains(docs, target, cfg), cfg).withColumn(
            "score", F.col("weight") + gumbel(cfg.seed)
        ),
        "resampling",
    )
    return draw(scored, F.col("n_words") >= cfg.least_words, cfg.percent)
