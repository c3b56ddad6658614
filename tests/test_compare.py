"""Comparison semantics: NaN, null, duplicates, tolerance."""

import pytest

from latewin.operators import compare as cmp
from latewin.schema import RESULT

NAN = float("nan")


def rows(spark, *specs):
    out = [(s, s + 60, "D", "S", c, v, v, v, v) for s, c, v in specs]
    return spark.createDataFrame(out, RESULT)


def test_equal_within_tolerance(spark):
    a = rows(spark, (0, 1, 1.0), (10, 2, 2.0))
    b = rows(spark, (10, 2, 2.0 + 5e-7), (0, 1, 1.0))
    v = cmp.verdict(a, b).first()
    assert v.exact and v.matched_keys == 2 and v.field_mismatches == 0
    cmp.assert_exact(cmp.verdict(a, b))


def test_missing_extra_and_wrong(spark):
    a = rows(spark, (0, 1, 1.0), (10, 2, 2.0), (20, 1, 3.0))
    b = rows(spark, (10, 3, 2.0), (20, 1, 3.1), (30, 1, 1.0))
    v = cmp.verdict(a, b).first()
    assert (v.missing_in_result, v.extra_in_result, v.field_mismatches) == (1, 1, 5)
    assert not v.exact
    assert [r.start for r in cmp.missing(a, b).collect()] == [0]
    assert [r.start for r in cmp.extra(a, b).collect()] == [30]
    counts = {
        r.field: r.mismatches for r in cmp.mismatch_counts(cmp.field_mismatches(a, b)).collect()
    }
    assert counts == {"count": 1, "sum": 1, "avg": 1, "min": 1, "max": 1}
    with pytest.raises(AssertionError):
        cmp.assert_exact(cmp.verdict(a, b))


def test_nan_never_matches_and_null_only_null(spark):
    a = rows(spark, (0, 1, NAN), (10, 1, None), (20, 1, None))
    b = rows(spark, (0, 1, NAN), (10, 1, None), (20, 1, 1.0))
    assert cmp.verdict(a, b).first().field_mismatches == 8


def test_duplicate_keys_spoil_the_verdict(spark):
    a = rows(spark, (0, 1, 1.0))
    b = rows(spark, (0, 1, 1.0), (0, 1, 1.0))
    v = cmp.verdict(a, b).first()
    assert (v.duplicate_result_rows, v.matched_keys, v.exact) == (1, 1, False)
