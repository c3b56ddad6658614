"""Comparing results with the truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from latewin.operators import compare as cmp
from latewin.operators.windows import native_window_aggregate, window_aggregate
from latewin.plans import bindings as b
from latewin.plans.catalog import sql as s
from latewin.plans.catalog.lifecycle import FULL, TIGHT, full, tight
from latewin.plans.catalog.registry import query

W = b.WINDOW

# A result damaged by formula: keys dropped, added and shifted.
DAMAGED = f"""{s.EV}, {s.pairs(W, "ev")}, truth AS ({s.agg()}),
hashed_rows AS (SELECT *, start // {W.slide} + length("Sensor") AS h FROM truth),
damaged AS (
  SELECT start, "end", "DeviceId", "Sensor",
         CASE WHEN h % 23 = 0 THEN count + 1 ELSE count END AS count,
         CASE WHEN h % 29 = 0 THEN sum + 0.5 ELSE sum END AS sum, avg, min, max
  FROM hashed_rows WHERE h % 31 <> 0
  UNION ALL
  SELECT start, "end", "DeviceId" || 'x', "Sensor", count, sum, avg, min, max
  FROM hashed_rows WHERE h % 37 = 0)"""
USING = '(start, "DeviceId", "Sensor")'


def _pair(spark, d):
    truth = window_aggregate(b.canonical(spark, d), W, round_to=6)
    h = F.floor(F.col("start") / W.slide) + F.length("Sensor")
    kept = truth.filter(h % 31 != 0).withColumns(
        {
            "count": F.when(h % 23 == 0, F.col("count") + 1).otherwise(F.col("count")),
            "sum": F.when(h % 29 == 0, F.col("sum") + 0.5).otherwise(F.col("sum")),
        }
    )
    added = truth.filter(h % 37 == 0).withColumn("DeviceId", F.concat("DeviceId", F.lit("x")))
    return truth, kept.unionByName(added)


VERDICT_COLUMNS = """(SELECT count(*) FROM {truth}) AS ground_truth_rows,
  (SELECT count(*) FROM {result}) AS result_rows, m.matched_keys,
  (SELECT count(*) FROM {truth} t ANTI JOIN {result} r USING (start, "DeviceId", "Sensor"))
    AS missing_in_result,
  (SELECT count(*) FROM {result} r ANTI JOIN {truth} t USING (start, "DeviceId", "Sensor"))
    AS extra_in_result,
  CAST(0 AS BIGINT) AS duplicate_truth_rows, CAST(0 AS BIGINT) AS duplicate_result_rows,
  m.field_mismatches"""


def _verdict_sql(chain: str, truth: str, result: str) -> str:
    wrong = " + ".join(
        f"CASE WHEN abs(t.{f} - r.{f}) <= 1e-6 THEN 0 ELSE 1 END"
        for f in ("count", "sum", "avg", "min", "max")
    )
    columns = VERDICT_COLUMNS.format(truth=truth, result=result)
    return f"""WITH {chain}, m AS (
      SELECT count(*) AS matched_keys, CAST(coalesce(sum({wrong}), 0) AS BIGINT)
        AS field_mismatches FROM {truth} t JOIN {result} r USING {USING}),
    v AS (SELECT {columns} FROM m)
    SELECT *, missing_in_result + extra_in_result + field_mismatches = 0 AS exact,
    CAST(1e-6 AS DOUBLE) AS tolerance FROM v"""


@query("compare_verdict", _verdict_sql(DAMAGED, "truth", "damaged"))
def compare_verdict(spark, d):
    return cmp.verdict(*_pair(spark, d))


@query(
    "compare_gate",
    f"""SELECT 'damaged' AS result, exact AS passed FROM ({_verdict_sql(DAMAGED, "truth", "damaged")})
    UNION ALL SELECT 'truth', exact FROM ({_verdict_sql(DAMAGED, "truth", "truth")})""",
)
def compare_gate(spark, d):
    """Whether the gate lets a result pass: the truth itself, and a damaged copy."""
    truth, damaged = _pair(spark, d)
    outcome = []
    for name, result in (("truth", truth), ("damaged", damaged)):
        try:
            cmp.assert_exact(cmp.verdict(truth, result))
            outcome.append((name, True))
        except AssertionError:
            outcome.append((name, False))
    return spark.createDataFrame(outcome, "result string, passed boolean")


@query(
    "compare_missing",
    f"""WITH {DAMAGED} SELECT start, "DeviceId", "Sensor" FROM truth t
    ANTI JOIN damaged r USING {USING}""",
)
def compare_missing(spark, d):
    return cmp.missing(*_pair(spark, d))


@query(
    "compare_extra",
    f"""WITH {DAMAGED} SELECT start, "DeviceId", "Sensor" FROM damaged r
    ANTI JOIN truth t USING {USING}""",
)
def compare_extra(spark, d):
    return cmp.extra(*_pair(spark, d))


@query(
    "compare_missing_sample",
    f"""WITH {DAMAGED} SELECT start, "DeviceId", "Sensor" FROM truth t
    ANTI JOIN damaged r USING {USING} ORDER BY start, "DeviceId", "Sensor" LIMIT 50""",
)
def compare_missing_sample(spark, d):
    """The first 50 missing keys, as a report shows them."""
    return cmp.sample(cmp.missing(*_pair(spark, d)))


MISMATCHES = f"""{DAMAGED}, longs AS (
  {" UNION ALL ".join(f'''SELECT start, "DeviceId", "Sensor", '{f}' AS field,
  CAST(t.{f} AS DOUBLE) AS expected, CAST(r.{f} AS DOUBLE) AS actual
  FROM truth t JOIN damaged r USING {USING}''' for f in ("count", "sum", "avg", "min", "max"))}),
mismatches AS (SELECT *, round(abs(expected - actual), 6) AS abs_diff FROM longs
  WHERE NOT abs(expected - actual) <= 1e-6)"""


@query("compare_field_mismatch", f"WITH {MISMATCHES} SELECT * FROM mismatches")
def compare_field_mismatch(spark, d):
    rows = cmp.field_mismatches(*_pair(spark, d))
    return rows.withColumn("abs_diff", F.round("abs_diff", 6))


@query(
    "compare_field_counts",
    f"WITH {MISMATCHES} SELECT field, count(*) AS mismatches FROM mismatches GROUP BY field",
)
def compare_field_counts(spark, d):
    return cmp.mismatch_counts(cmp.field_mismatches(*_pair(spark, d)))


def _crosscheck_sql(chain: str) -> str:
    whole = f"""{chain}, truth AS ({s.agg(places=9)}),
    kept AS (SELECT * FROM categorized WHERE category <> 'C'),
    result AS ({s.agg(source="kept", places=9)})"""
    return _verdict_sql(whole, "truth", "result")


@query("crosscheck", _crosscheck_sql(FULL))
def crosscheck(spark, d):
    """A guarded run against Spark's own window aggregate of the in-order table."""
    truth = native_window_aggregate(b.canonical(spark, d), W)
    return cmp.verdict(truth, full(spark, d).result)


@query("crosscheck_tight", _crosscheck_sql(TIGHT))
def crosscheck_tight(spark, d):
    """The same with a guard too small for the disorder: the loss shows."""
    truth = native_window_aggregate(b.canonical(spark, d), W)
    return cmp.verdict(truth, tight(spark, d).result)


