"""Mixing sources to target weights by systematic sampling.

Within a source every document is expected ``target / size of the source`` times.
Expected copies are summed along an order of the source, one random offset is
added, and a document is emitted once per integer boundary its share crosses. The
order goes by size class, hash bucket and size, so neighbours are of similar
size and the words taken come near the target.

A source may hold most rows: its order is cut into blocks of (size class, hash
bucket); a block is numbered on its own, and what lies before it comes from a
table with one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latewin.llm.tables import WORD, text_of

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_ROWS = 4096
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Maximal runs without white space, counted without splitting the text."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """source, source_size, target from a table of (source, source_size).

    Sources in code point order, null last, weigh ``weights`` in turn. A target stops at
    ``most`` times its source; what exceeds goes to the others by weight. With the
    sources ordered by size per weight, the capped ones are a prefix: a source is
    capped when its cap per weight lies below the level the rest would get. One
    row per source is sorted here, never the documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(by_name) - 1
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights)).cast("int") + 1
    )
    everything = Window.partitionBy(F.lit(0))
    level_order = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    rows = (
        sizes.select("source", F.col("source_size").cast("long"), weight.alias("weight"))
        .withColumn("level", most * F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("capped", F.coalesce(F.sum(most * F.col("source_size")).over(level_order), F.lit(0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(level_order), F.lit(0.0)))
        .withColumn("share", (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("gone")))
        .withColumn("stops", F.col("level") < F.col("share"))
    )
    # The first source that is not capped sets the level of all that follow it.
    rest = F.min(F.when(~F.col("stops"), F.struct("level", "source", "share"))).over(everything)
    return rows.select(
        "source",
        "source_size",
        F.when(F.col("stops"), (most * F.col("source_size")).cast("double"))
        .otherwise(
            F.least(F.col("weight") * rest["share"], (most * F.col("source_size")).cast("double"))
        )
        .alias("target"),
    )


def _hex_fraction(digest: Column) -> Column:
    """The first 48 bits of a hexadecimal digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    seed: str = SEED,
    block_rows: int = BLOCK_ROWS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row (and ``keep``).

    Null text has size 0; null is a source of its own. A source without words has
    target 0 and no copies. Rows alike in id, source and size are interchangeable
    and take consecutive places. Copies never exceed ``most`` as the expected
    number does not. The result depends on the rows and ``seed`` only.
    """
    rows = docs.select(
        "doc_id",
        "source",
        *[c for c in keep if c not in ("doc_id", "source")],
        word_count(text_of()).alias("size"),
        # A key that is never null, so that numbering and joins share a partitioning.
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_source"),
        F.md5(
            F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
            .cast("binary")
        ).alias("_place"),
    )
    per_source = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")
    )
    targets = source_targets(per_source.select("source", "source_size"), weights, most)
    most_rows = per_source.agg(F.max("rows")).first()[0] or 0
    buckets = max(1, -(-most_rows // block_rows))
    rows = rows.withColumn("_class", F.length(F.bin("size"))).withColumn(
        "_bucket", F.floor(_hex_fraction(F.col("_place")) * buckets)
    )
    block = ["_source", "_class", "_bucket"]
    before = (
        Window.partitionBy("_source")
        .orderBy("_class", "_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = (
        rows.groupBy(*block)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_earlier"))
        .join(
            targets.select(
                F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_source"),
                "source_size",
                "target",
            ),
            "_source",
        )
    )
    within = Window.partitionBy(*block).orderBy("size", "_place", "doc_id")
    placed = (
        rows.withColumn("_here", F.row_number().over(within))
        .join(blocks, block)
        .withColumn("nth", F.col("_earlier") + F.col("_here"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # One offset per source, from an md5, which every engine computes alike.
    offset = _hex_fraction(F.md5(F.concat_ws("|", F.lit(seed), "_source").cast("binary")))
    crossed = F.floor(F.col("nth") * rate + offset) - F.floor((F.col("nth") - 1) * rate + offset)
    copies = F.least(crossed, F.lit(most)).cast("long")
    return placed.select(
        "doc_id",
        "source",
        *[c for c in keep if c not in ("doc_id", "source")],
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken.

    Columns named like those of :func:`mix` pass through unchanged.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    taken = mix(docs.select("doc_id", "text", "source", whole), keep=["_row"], **options)
    return (
        taken.where("copies > 0")
        .select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
        .select("_row.*")
    )
