"""Exact quantile of a whole column, without gathering it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096


def _neighbours(df: DataFrame, rank: int, low: float, high: float):
    """The values at 0-based ranks ``rank`` and ``rank + 1`` of column v, by narrowing.

    Each round counts the current range in at most BINS bins and descends into
    the bin that holds both ranks. When they fall into different bins, the first
    is the maximum of its bin and the second the minimum of the next. A range too
    narrow to be cut holds a few neighbouring doubles, which are counted one by one.
    """
    v = F.col("v")
    while low < high:
        # Divided before the difference is taken, which may lie beyond the doubles.
        width = high / BINS - low / BINS
        if low + width == low or high - width == high:
            folded = df.groupBy("v").count().orderBy("v").collect()
            values = [(r.v, r["count"]) for r in folded]
            found = []
            for wanted in (rank, rank + 1):
                left = wanted
                for value, number in values:
                    if left < number:
                        break
                    left -= number
                found.append(value)
            return tuple(found)
        index = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        bins = (
            df.groupBy(index.alias("b"))
            .agg(F.count(F.lit(1)).alias("rows"), F.min(v).alias("low"), F.max(v).alias("high"))
            .orderBy("b")
            .collect()
        )
        at = 0
        while rank >= bins[at].rows:
            rank -= bins[at].rows
            at += 1
        here = bins[at]
        if rank + 1 >= here.rows:
            after = bins[at + 1].low if at + 1 < len(bins) else here.high
            return here.high, after
        df = df.filter((v >= F.lit(here.low)) & (v <= F.lit(here.high)))
        low, high = here.low, here.high
    return low, high


def exact_quantile(df: DataFrame, column: str, q: float) -> float | None:
    """Linear-interpolation quantile over all non-null values of a finite column."""
    values = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    rows, low, high = values.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not rows:
        return None
    position = (rows - 1) * q
    below = int(position)
    first, second = _neighbours(values, below, low, high)
    return first if below == position else first + (second - first) * (position - below)
