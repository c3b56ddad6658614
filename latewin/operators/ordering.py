"""Order-dependent columns without a global window over the rows.

Rows are cut into blocks that are contiguous in the order. Each block is
windowed on its own; what earlier blocks contribute comes from a table of block
summaries, one row per BLOCK_ROWS rows, and only that table is windowed as a
whole (10**12 rows leave fewer than eight million summaries).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 17
# For tables that already hold one row per recalculation point or cycle.
POINT_BLOCK = 1 << 16

_AGG = {"max": F.max, "min": F.min, "sum": F.sum}


def _merge(kind: str, earlier: Column, later: Column) -> Column:
    if kind == "max":
        return F.greatest(earlier, later)
    if kind == "min":
        return F.least(earlier, later)
    if kind == "sum":
        return F.coalesce(earlier, F.lit(0)) + F.coalesce(later, F.lit(0))
    if kind == "first":
        return F.coalesce(earlier, later)
    return F.coalesce(later, earlier)


def _summary(kind: str, value: Column, order: Column) -> Column:
    if kind in _AGG:
        return _AGG[kind](value)
    present = F.when(value.isNotNull(), order)
    return F.min_by(value, present) if kind == "first" else F.max_by(value, present)


def _over(kind: str, value: Column, window) -> Column:
    if kind in _AGG:
        return _AGG[kind](value).over(window)
    pick = F.first if kind == "first" else F.last
    return pick(value, ignorenulls=True).over(window)


def carry_in(
    blocks: DataFrame, block: str, kinds: dict[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """For every block, what all earlier blocks together contribute."""
    earlier = (
        Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    )
    return blocks.select(
        *by,
        block,
        *[_over(k, F.col(c), earlier).alias(f"_carry_{c}") for c, k in kinds.items()],
    )


def running(
    df: DataFrame,
    order: Column | str,
    block: Column | str,
    columns: dict[str, tuple[Column, str]],
    by: Sequence[str] = (),
    inclusive: bool = True,
    descending: bool = False,
) -> DataFrame:
    """Add running aggregates; ``columns`` maps a name to (value, kind).

    ``kind`` is one of max, min, sum, first, last. ``block`` must be a
    non-decreasing function of ``order`` within ``by``; with ``descending`` the
    scan goes from the highest order to the lowest.
    """
    by = list(by)
    order = F.col(order) if isinstance(order, str) else order
    block = F.col(block) if isinstance(block, str) else block
    if descending:
        block = -block
    kinds = {name: kind for name, (_, kind) in columns.items()}
    staged = df.withColumns(
        {
            "_blk": block,
            "_ord": order,
            **{f"_val_{name}": value for name, (value, _) in columns.items()},
        }
    )
    summaries = staged.groupBy(*by, "_blk").agg(
        *[_summary(k, F.col(f"_val_{c}"), F.col("_ord")).alias(c) for c, k in kinds.items()]
    )
    carry = carry_in(summaries, "_blk", kinds, by)
    sort = F.col("_ord").desc() if descending else F.col("_ord")
    window = (
        Window.partitionBy(*by, "_blk")
        .orderBy(sort)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = staged.select(
        *df.columns,
        "_blk",
        *[_over(k, F.col(f"_val_{c}"), window).alias(f"_here_{c}") for c, k in kinds.items()],
    )
    return local.join(carry, [*by, "_blk"]).select(
        *df.columns,
        *[
            _merge(k, F.col(f"_carry_{c}"), F.col(f"_here_{c}")).alias(c)
            for c, k in kinds.items()
        ],
    )


def with_arrival_index(
    df: DataFrame,
    order: Sequence[Column | str],
    block: Column,
    by: Sequence[str] = (),
    name: str = "n",
) -> DataFrame:
    """Add a dense 1-based position ``name`` and keep the ``block`` it lies in.

    ``block`` is a value-based, non-decreasing function of the first order
    column, so that recomputed tasks always cut the rows the same way. The
    order must be total (end it with a unique column).
    """
    by = list(by)
    staged = df.withColumn("block", block)
    counts = staged.groupBy(*by, "block").agg(F.count(F.lit(1)).alias("rows"))
    carry = carry_in(counts, "block", {"rows": "sum"}, by)
    window = Window.partitionBy(*by, "block").orderBy(*order)
    local = staged.withColumn("_row", F.row_number().over(window))
    return local.join(carry, [*by, "block"]).select(
        *[c for c in df.columns if c not in by],
        *by,
        "block",
        (F.coalesce("_carry_rows", F.lit(0)) + F.col("_row")).cast("long").alias(name),
    )


def index_file_rows(df: DataFrame, name: str = "n", per_file: bool = False) -> DataFrame:
    """Dense 1-based position in file order, for rows just read from files.

    Files follow each other by name, or with ``per_file`` each starts at 1.

    Needs columns ``_file`` and ``_split`` (file name and split start from
    ``_metadata``). Every split is read by one task front to back, so a running
    id within the task plus the row counts of earlier splits is the position;
    the rows themselves are not shuffled.
    """
    numbered = df.withColumn("_id", F.monotonically_increasing_id())
    splits = numbered.groupBy("_file", "_split").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first")
    )
    # One row per file split: a petabyte in 128 MB splits makes eight million.
    line = Window.partitionBy("_file") if per_file else Window.partitionBy()
    earlier = line.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    offsets = splits.select(
        "_file", "_split", (before - F.col("_first") + 1).alias("_shift")
    )
    return numbered.join(offsets, ["_file", "_split"]).select(
        *df.columns, (F.col("_id") + F.col("_shift")).alias(name)
    )


def with_run_value(df: DataFrame, values: DataFrame, names: Sequence[str], by: Sequence[str]):
    """Attach columns of a table that has one row per ``by`` (one row in all if empty)."""
    if by:
        return df.join(values.select(*by, *names), list(by), "left")
    return df.withColumns({c: values.select(c).scalar() for c in names})
