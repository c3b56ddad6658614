"""Is a result equal to the truth, key by key and field by field?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewin.schema import RESULT_FIELDS, RESULT_KEYS

TOLERANCE = 1e-6


def differs(expected: Column, actual: Column, tolerance: float = TOLERANCE) -> Column:
    """True unless the absolute difference is within tolerance.

    NaN never matches, a null matches only a null.
    """
    both_null = expected.isNull() & actual.isNull()
    close = F.coalesce(F.abs(expected - actual) <= tolerance, F.lit(False))
    return ~(both_null | close)


def aligned(
    truth: DataFrame,
    result: DataFrame,
    keys: Sequence[str] = RESULT_KEYS,
    fields: Sequence[str] = RESULT_FIELDS,
) -> DataFrame:
    """Full outer join on the keys with one row per distinct key and side.

    Repeated keys are folded before the join (their number is kept), so a
    repeated key cannot multiply rows.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        shown = F.struct(*[F.col(f).cast("double").alias(f) for f in fields])
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"_{name}_rows"), F.max(shown).alias(f"_{name}")
        )

    return side(truth, "truth").join(side(result, "result"), list(keys), "full_outer")


def missing(truth: DataFrame, result: DataFrame, keys: Sequence[str] = RESULT_KEYS) -> DataFrame:
    """Keys of the truth that the result lacks."""
    return truth.select(*keys).distinct().join(result.select(*keys), list(keys), "left_anti")


def extra(truth: DataFrame, result: DataFrame, keys: Sequence[str] = RESULT_KEYS) -> DataFrame:
    return missing(result, truth, keys)


def sample(keys: DataFrame, size: int = 50) -> DataFrame:
    """The first keys in order, as a report shows them."""
    return keys.orderBy(*keys.columns).limit(size)


def field_mismatches(
    truth: DataFrame,
    result: DataFrame,
    tolerance: float = TOLERANCE,
    keys: Sequence[str] = RESULT_KEYS,
    fields: Sequence[str] = RESULT_FIELDS,
) -> DataFrame:
    """One row per differing (key, field) with both values."""
    both = aligned(truth, result, keys, fields).filter(
        "_truth_rows is not null and _result_rows is not null"
    )
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("field"),
                    F.col(f"_truth.{f}").alias("expected"),
                    F.col(f"_result.{f}").alias("actual"),
                )
                for f in fields
            ]
        )
    )
    long = both.select(*keys, pairs.alias("p")).select(*keys, "p.*")
    return long.filter(differs(F.col("expected"), F.col("actual"), tolerance)).withColumn(
        "abs_diff", F.abs(F.col("expected") - F.col("actual"))
    )


def mismatch_counts(mismatches: DataFrame) -> DataFrame:
    return mismatches.groupBy("field").agg(F.count(F.lit(1)).alias("mismatches"))


def verdict(
    truth: DataFrame,
    result: DataFrame,
    tolerance: float = TOLERANCE,
    keys: Sequence[str] = RESULT_KEYS,
    fields: Sequence[str] = RESULT_FIELDS,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per ``by``: counts and whether the result is exact."""
    keys = [*by, *[k for k in keys if k not in by]]
    rows = aligned(truth, result, keys, fields)
    has_truth, has_result = F.col("_truth_rows").isNotNull(), F.col("_result_rows").isNotNull()
    both = has_truth & has_result
    wrong = [
        F.when(
            both & differs(F.col(f"_truth.{f}"), F.col(f"_result.{f}"), tolerance), 1
        ).otherwise(0)
        for f in fields
    ]
    wrong_here = sum(wrong[1:], wrong[0])

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    out = rows.groupBy(*by).agg(
        total(F.col("_truth_rows")).alias("ground_truth_rows"),
        total(F.col("_result_rows")).alias("result_rows"),
        F.count(F.when(both, 1)).alias("matched_keys"),
        F.count(F.when(has_truth & ~has_result, 1)).alias("missing_in_result"),
        F.count(F.when(has_result & ~has_truth, 1)).alias("extra_in_result"),
        total(F.coalesce(F.col("_truth_rows") - 1, F.lit(0))).alias("duplicate_truth_rows"),
        total(F.coalesce(F.col("_result_rows") - 1, F.lit(0))).alias("duplicate_result_rows"),
        total(wrong_here).alias("field_mismatches"),
    )
    problems = (
        F.col("missing_in_result")
        + F.col("extra_in_result")
        + F.col("duplicate_truth_rows")
        + F.col("duplicate_result_rows")
        + F.col("field_mismatches")
    )
    return out.withColumns({"exact": problems == 0, "tolerance": F.lit(float(tolerance))})


def assert_exact(report: DataFrame) -> None:
    """Raise on the first verdict that is not exact."""
    bad = report.filter(~F.col("exact")).limit(1).collect()
    if bad:
        raise AssertionError(f"result differs from the truth: {bad[0].asDict()}")
