"""CSV, Parquet and JSON tables: reading, writing and checking what was written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latewin.functions.columns import resolve_columns
from latewin.operators.ordering import BLOCK_ROWS, index_file_rows, running, with_arrival_index
from latewin.operators.validate import (
    IDENTITY,
    good_rows,
    raise_on_bad_cell,
    uniqueness,
    validate_rows,
    with_event_ids,
)
from latewin.schema import RESULT


# -- CSV ---------------------------------------------------------------------

# A quote inside a quoted cell is doubled.
QUOTING = {"quote": '"', "escape": '"'}
_TEXT = '[^"]*+(?:""[^"]*+)*+'
_CELL = f'(?:"{_TEXT}"|[^",]*+)'
# Lines of a record that goes over several: the cell that is open at the end of a line was
# opened in the line or before it, and so for the start. The first and the last line hold an
# odd number of quotes, the others an even one.
_FIRST_LINE = f'^(?:{_CELL},)*+"{_TEXT}$'
_MIDDLE_LINE = f'^{_TEXT}(?:"(?:,{_CELL})*+,"{_TEXT})?+$'
_LAST_LINE = f'^{_TEXT}"(?:,{_CELL})*+$'


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with every cell as text; a file, or all ``*.csv`` of a directory."""
    reader = spark.read.option("header", True).option("inferSchema", False).options(**QUOTING)
    try:
        raw = reader.option("pathGlobFilter", "*.csv").csv(path)
    except AnalysisException as e:
        raise ValueError(f"no CSV data in {path}: {e}") from e
    if not raw.columns:
        raise ValueError(f"CSV in {path} is empty")
    return raw


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_file, value, line)"""
    lines = (
        spark.read.option("pathGlobFilter", "*.csv")
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_split"),
        )
    )
    return index_file_rows(lines, "line", per_file=True)


def _header_cells(spark: SparkSession, line: str) -> list[str]:
    """Cells of a header line, read as CSV like every other line."""
    width = line.count(",") + 1
    schema = ", ".join(f"c{k} string" for k in range(width))
    row = spark.createDataFrame([(line,)], "value string").select(
        F.from_csv("value", schema, QUOTING).alias("r")
    ).first()[0]
    return [c.strip() for c in row if c is not None]


def _odd_quotes() -> Column:
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return quotes % 2


def require_same_headers(lines: DataFrame) -> None:
    """Raise where a file's header differs from the first file's, or is no whole line."""
    # One row per file, compared by Spark; only the first that differs comes back.
    heads = lines.filter("line = 1")
    first = heads.orderBy("_file").first()
    if first is None:
        return
    split = heads.filter(_odd_quotes() == 1).orderBy("_file").first()
    if split:
        raise ValueError(f"{split._file}, line 1: a quoted cell goes over the end of the header")
    other = heads.filter(F.trim("value") != first.value.strip()).orderBy("_file").first()
    if other:
        raise ValueError(f"{other._file}: its header {other.value!r} differs from {first.value!r}")


def has_quoted_breaks(lines: DataFrame) -> bool:
    """Some quoted cell goes over the end of a line."""
    return not lines.filter(_odd_quotes() == 1).isEmpty()


def csv_records(lines: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(_file, line, value) of whole records, ``line`` being a record's first.

    Whether a line begins inside a quoted cell is the parity of the odd quotes before it in its
    file: a prefix sum over blocks of lines, so splits are cut in parallel. Only the lines of
    records of several lines are then brought together, joined by a line feed. A quote that
    neither opens nor closes a cell, or a cell left open at a file's end, raises with the
    first such line. ``carry`` names columns taken from a record's first line.
    """
    scanned = running(
        lines.withColumn("_odd", _odd_quotes().cast("long")),
        "line",
        F.floor(F.col("line") / BLOCK_ROWS),
        {"_before": (F.col("_odd"), "sum")},
        ["_file"],
        inclusive=False,
    ).withColumn("_before", F.coalesce("_before", F.lit(0).cast("long")))
    inside, odd = F.col("_before") % 2 == 1, F.col("_odd") == 1
    form = (
        F.when(odd & ~inside, F.lit(_FIRST_LINE))
        .when(odd, F.lit(_LAST_LINE))
        .when(inside, F.lit(_MIDDLE_LINE))
    )
    stray = scanned.filter(~F.regexp_like("value", form))
    never_closed = (
        scanned.filter(odd)
        .groupBy("_file")
        .agg(F.count(F.lit(1)).alias("_odds"), F.max("line").alias("line"))
        .filter("_odds % 2 = 1")
    )
    wrong = stray.select("_file", "line").union(never_closed.select("_file", "line"))
    first = wrong.orderBy("_file", "line").first()
    if first:
        raise ValueError(
            f"{first._file}, line {first.line}: a quote neither opens nor closes a cell"
        )
    whole = scanned.filter(~inside & ~odd).select("_file", "line", "value", *carry)
    parts = F.array_sort(F.collect_list(F.struct("line", "value")))
    joined = (
        scanned.filter(inside | odd)
        .groupBy("_file", F.floor((F.col("_before") + F.when(inside, -1).otherwise(0)) / 2))
        .agg(
            F.min("line").alias("line"),
            F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"),
            *[F.min_by(c, "line").alias(c) for c in carry],
        )
        .select("_file", "line", "value", *carry)
    )
    return whole.unionByName(joined)


def _cells(
    lines: DataFrame, columns: Sequence[str], carry: Sequence[str] = ("line",)
) -> DataFrame:
    """Cells of records after the header line."""
    schema = ", ".join(f"c{k} string" for k in range(len(columns)))
    parsed = lines.filter("line > 1").select(
        *carry, F.from_csv("value", schema, QUOTING).alias("_row")
    )
    return parsed.select(
        *carry, *[F.col(f"_row.c{k}").alias(c) for k, c in enumerate(columns)]
    )


def checked_csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every data line of the CSV with its line number and reject reason."""
    columns = read_raw_csv(spark, path).columns
    lines = _numbered_lines(spark, path)
    require_same_headers(lines)
    resolve_columns(columns)
    records = csv_records(lines) if has_quoted_breaks(lines) else lines
    return validate_rows(_cells(records, columns), carry=["line"])


def _placed(lines: DataFrame) -> DataFrame:
    """Add ``_at``, the place of a line over all files, which follow each other by name."""
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file.
    starts = lines.groupBy("_file").agg(F.max("line").alias("_lines")).select(
        "_file", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_start")
    )
    return lines.join(starts, "_file").withColumn("_at", F.col("_start") + F.col("line"))


def read_arrival_csv(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Events in arrival order, which is the order of the lines (files by name).

    Rows with a blank required cell are dropped. With ``strict`` an unparsable
    number or time raises with its line number, otherwise the row is dropped too;
    :func:`checked_csv_lines` lists what was dropped. Rows are numbered inside
    their file split and not shuffled, unless a quoted cell goes over the end of a line: then
    records are put together first (:func:`csv_records`).
    """
    raw = read_raw_csv(spark, path)
    lines = _numbered_lines(spark, path)
    require_same_headers(lines)
    resolve_columns(raw.columns)
    broken = has_quoted_breaks(lines)
    if broken:
        carry = ["_at", "line"]
        records = csv_records(_placed(lines), ["_at"])
        checked = validate_rows(_cells(records, raw.columns, carry), carry=carry)
    else:
        located = raw.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_split"),
        )
        checked = validate_rows(located, carry=["_file", "_split"])
    if strict:
        bad = checked.filter(F.col("reject_reason").isin("bad_value", "bad_time"))
        if bad.limit(1).count():
            raise_on_bad_cell(checked_csv_lines(spark, path))
    if broken:
        events = _numbered(good_rows(checked), "_at").drop("line")
    else:
        events = index_file_rows(good_rows(checked), "n").drop("_file", "_split")
    if not events.limit(1).count():
        raise ValueError("CSV contains no valid data rows")
    return with_event_ids(events)


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    place = F.floor(F.col(order) / BLOCK_ROWS)
    return with_arrival_index(rows, [order], place).drop(order)


def read_arrival_text(
    spark: SparkSession, source: str | bytes, strict: bool = True
) -> DataFrame:
    """The same for a small CSV held in memory as text, bytes or a text buffer."""
    if hasattr(source, "read"):
        source = source.read()
    text = source.decode("utf-8", errors="replace") if isinstance(source, bytes) else source
    if not text.strip():
        raise ValueError("CSV is empty")
    lines = text.splitlines()
    header = _header_cells(spark, lines[0])
    if not any(header):
        raise ValueError("CSV has an empty header row")
    resolve_columns(header)
    table = spark.createDataFrame(
        list(enumerate(lines, 1)), "line long, value string"
    ).withColumn("_file", F.lit("text"))
    require_same_headers(table)
    checked = validate_rows(_cells(csv_records(table), header), carry=["line"])
    if strict:
        raise_on_bad_cell(checked)
    events = _numbered(good_rows(checked), "line")
    if not events.limit(1).count():
        raise ValueError("CSV contains no valid data rows")
    return with_event_ids(events)


def write_summary_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).options(**QUOTING).csv(path)


# -- Parquet ------------------------------------------------------------------


def read_canonical(
    spark: SparkSession,
    primary: str,
    fallback: str | None = None,
    columns: Sequence[str] = IDENTITY,
) -> DataFrame:
    """The canonical columns from the primary path, else from the fallback."""
    try:
        return spark.read.parquet(primary).select(*columns)
    except AnalysisException:
        if fallback is None:
            raise
        return spark.read.parquet(fallback).select(*columns)


def write_canonical(
    rows: DataFrame, path: str, partitions: int | None = None, replica: str | None = None
) -> bool | None:
    """Overwrite the canonical store; then copy it to ``replica`` if one is named.

    A failing replica does not fail the write: the return value says whether the
    copy exists (None when none was asked for). Without ``partitions`` the file
    count follows the data.
    """
    shaped = rows.repartition(partitions) if partitions else rows
    shaped.write.mode("overwrite").parquet(path)
    if replica is None:
        return None
    try:
        rows.sparkSession.read.parquet(path).write.mode("overwrite").parquet(replica)
    except Exception:  # noqa: BLE001  any storage error means no replica
        return False
    return True


def write_aggregate(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def read_back_check(rows: DataFrame, path: str) -> DataFrame:
    """Row counts before and after a write, and whether they and all rows agree."""
    spark = rows.sparkSession
    written = uniqueness(spark.read.parquet(path))
    expected = rows.agg(F.count(F.lit(1))).scalar()
    return written.select(
        expected.alias("expected_rows"),
        F.col("total_rows").alias("written_rows"),
        "unique_rows",
        ((F.col("total_rows") == expected) & F.col("is_unique")).alias("verified"),
    )


def assert_written(check: DataFrame) -> None:
    row = check.first()
    if not row.verified:
        raise RuntimeError(f"read-back check failed: {row.asDict()}")


def manifest(
    raw: DataFrame,
    canonical: DataFrame,
    window: int,
    slide: int,
    written: DataFrame | None = None,
) -> DataFrame:
    """What a canonicalisation read, kept and wrote, as one row."""
    files = raw.select(F.input_file_name().alias("f")).agg(
        F.count(F.lit(1)).alias("raw_rows"), F.count_distinct("f").alias("files")
    )
    kept = uniqueness(canonical)
    stored = (written if written is not None else canonical).agg(F.count(F.lit(1)))
    return files.select(
        "files",
        "raw_rows",
        kept.select("total_rows").scalar().alias("canonical_rows"),
        kept.select("unique_rows").scalar().alias("unique_rows"),
        (F.col("raw_rows") - kept.select("unique_rows").scalar()).alias("duplicate_rows"),
        stored.scalar().alias("written_rows"),
        F.lit(window).cast("long").alias("window_seconds"),
        F.lit(slide).cast("long").alias("slide_seconds"),
    )


# -- JSON ---------------------------------------------------------------------


def write_json(rows: DataFrame, path: str) -> None:
    """One compact JSON object per line."""
    rows.write.mode("overwrite").json(path)


def read_json_rows(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Result rows from JSON lines, from an array, or from ``{"rows": [...]}``.

    Only the line layout can be split; the other two are one document per file.
    """
    if layout == "lines":
        return spark.read.schema(RESULT).json(path)
    whole = spark.read.option("multiLine", True)
    if layout == "array":
        return whole.schema(RESULT).json(path)
    if layout != "rows":
        raise ValueError("layout must be 'lines', 'array' or 'rows'")
    nested = whole.schema(f"rows array<{RESULT.simpleString()}>").json(path)
    return nested.select(F.explode("rows").alias("r")).select("r.*")


def write_final_rows(rows: DataFrame, path: str, batch_id: int) -> None:
    """Append final rows under their batch; repeating a batch replaces only itself."""
    rows.write.mode("overwrite").json(f"{path}/batch_id={batch_id}")


def read_final_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).json(path).select(*RESULT.fieldNames())
