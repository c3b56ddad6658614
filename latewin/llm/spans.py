"""Match positions from built-in functions.

The pieces between matches and the matches alternate, so a match starts where the
lengths of all before it end. Positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches, whole."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def starts(text: Column, pattern: str, found: Column) -> Column:
    """Start of every match of ``found`` (from :func:`matches`) as array<int>."""
    between = F.split(text, pattern, -1)
    lengths = F.zip_with(
        F.slice(between, F.lit(1), F.size(found)),
        found,
        lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit")),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(
        lengths,
        zero,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["hit"]).alias("at"),
            F.concat(acc["all"], F.array(acc["at"] + x["gap"])).alias("all"),
        ),
        lambda acc: acc["all"],
    )


def located(text: Column, pattern: str) -> Column:
    """Every match as struct<start, end, hit>; no work beyond a test where there is none."""
    found = matches(text, pattern)
    placed = F.zip_with(
        starts(text, pattern, found),
        found,
        lambda at, hit: F.struct(
            at.alias("start"), (at + F.length(hit)).alias("end"), hit.alias("hit")
        ),
    )
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return F.when(text.rlike(pattern), placed).otherwise(none)
