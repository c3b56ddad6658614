"""SimHash fingerprints and their search by permuted block tables.

Terms are words and pairs of neighbouring words, A-Z lower-cased. A term's 64-bit hash
votes on 64 signed bits with the term's weight; the sign of each sum is a bit of the
fingerprint. Votes are added two bits to a long, in fields of 32 bits, by an
ordinary aggregation. Only built-in functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latewin.llm.tables import text_of

BITS = 64
_HALF = BITS // 2
_LOW = (1 << _HALF) - 1
_FIELDS = (1 << _HALF) | 1
WORD_WEIGHT = 1
PAIR_WEIGHT = 3
#: Radius of the search, and blocks of which all but the radius agree.
RADIUS = 3
BLOCKS = 6
#: Documents that one window partition of the walk to the next document holds.
NEIGHBOURS = 512
#: Most stretches of doc_id, of about as many rows each, that blocks are cut from.
STRETCHES = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where a lambda uses it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def fingerprints(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fp`` (long), one row per distinct keys.

    Rows of equal keys must have equal texts (their votes double, the signs stay). Texts
    without words, null among them, have the fingerprint 0. A text may hold up to
    2**30 words.
    """
    words = F.col("_words")
    pairs = df.select(*keys, _words(F.coalesce(F.col(text), F.lit(""))).alias("_words")).select(
        *keys,
        F.explode_outer(
            F.arrays_zip(
                words.alias("a"),
                F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))).alias("b"),
            )
        ).alias("_t"),
    )
    word, after = F.col("_t").getField("a"), F.col("_t").getField("b")
    votes = pairs.select(
        *keys,
        F.when(word.isNotNull(), F.xxhash64(word)).otherwise(F.lit(0).cast("long")).alias("_h"),
        F.when(after.isNotNull(), F.xxhash64(word, after)).otherwise(F.lit(0).cast("long")).alias("_p"),
        F.when(word.isNull(), 0).when(after.isNull(), WORD_WEIGHT)
        .otherwise(WORD_WEIGHT + PAIR_WEIGHT).cast("long").alias("_w"),
    )
    fields = F.lit(_FIELDS)
    sums = votes.groupBy(*keys).agg(
        F.sum("_w").alias("_w"),
        *[
            F.sum(
                F.shiftrightunsigned("_h", i).bitwiseAND(fields) * WORD_WEIGHT
                + F.shiftrightunsigned("_p", i).bitwiseAND(fields) * PAIR_WEIGHT
            ).alias(f"_s{i}")
            for i in range(_HALF)
        ],
    )
    value = F.lit(0).cast("long")
    for i in range(BITS):
        votes_of = F.col(f"_s{i % _HALF}")
        ones = F.shiftrightunsigned(votes_of, _HALF) if i >= _HALF else votes_of.bitwiseAND(F.lit(_LOW))
        bit = (1 << i) if i < BITS - 1 else -(1 << i)
        value = value.bitwiseOR(F.when(ones * 2 > F.col("_w"), F.lit(bit)).otherwise(F.lit(0)).cast("long"))
    return sums.select(*keys, value.alias("fp"))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / BITS


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Bits kept by each table: every choice of ``blocks - radius`` blocks."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = 0
        for c in chosen:
            mask |= ((1 << (cuts[c + 1] - cuts[c])) - 1) << cuts[c]
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return masks


def within_radius(
    queries: DataFrame, rows: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """(query, fp, distance): distinct fingerprints of ``rows`` near each distinct query.

    Both tables have a column ``fp``. Two fingerprints that differ in at most ``radius``
    bits differ in at most as many blocks, so they agree on all of some choice of
    ``blocks - radius`` blocks: each choice is a table keyed by those bits, and none is
    missed. Equal fingerprints are searched once, so groups of copies do not multiply.
    """
    masks = F.array(*[F.lit(m) for m in block_masks(radius, blocks)])

    def tables(df: DataFrame, name: str) -> DataFrame:
        return (
            df.select(F.col("fp").alias(name))
            .where(f"{name} is not null")
            .distinct()
            .select(name, F.posexplode(masks).alias("table", "mask"))
            .select(name, "table", F.col(name).bitwiseAND(F.col("mask")).alias("key"))
        )

    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fp")))
    return (
        tables(queries, "query")
        .join(tables(rows, "fp"), ["table", "key"])
        .where(distance <= radius)
        .select("query", "fp", distance.alias("distance"))
        .distinct()
    )


def fingerprint_classes(rows: DataFrame) -> DataFrame:
    """fp, class_id (the smallest doc_id) and class_size (long), one row per fingerprint.

    ``class_id`` is null where no row of the class has a doc_id.
    """
    return rows.groupBy("fp").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")
    )


def with_matches(rows: DataFrame, prints: DataFrame, asked: Column) -> DataFrame:
    """Adds class_id, class_size and, where ``asked``, matches to every row.

    ``prints`` holds doc_id and fp of all rows to search in. ``matches`` is
    array<struct<distance, fp, doc_id, size>> by distance and fp: all classes within the
    search radius with their smallest doc_id and their size, the row's own class at
    distance 0 among them. Other members of a class are the rows of equal fp.
    """
    classes = fingerprint_classes(prints)
    listed = (
        within_radius(prints.where(asked), prints)
        .join(classes, "fp")
        .groupBy("query")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "distance", "fp", F.col("class_id").alias("doc_id"),
                        F.col("class_size").alias("size"),
                    )
                )
            ).alias("_matches")
        )
    )
    found = classes.join(listed.withColumnRenamed("query", "fp"), "fp", "left")
    return rows.join(found, "fp").withColumn("matches", F.when(asked, F.col("_matches"))).drop("_matches")


def _next_block(blocks: DataFrame, possible: int) -> DataFrame:
    """(blk, next) for a table of distinct block numbers; the last has none.

    Each round walks groups of NEIGHBOURS numbers; only a table of at most 65,536 numbers
    is sorted as a whole.
    """
    if possible <= 1 << 16:
        return blocks.select("blk", F.lead("blk").over(Window.orderBy("blk")).alias("next"))
    grouped = blocks.withColumn("up", F.floor(F.col("blk") / NEIGHBOURS))
    least = grouped.groupBy("up").agg(F.min("blk").alias("least"))
    ups = _next_block(least.select(F.col("up").alias("blk")), possible // NEIGHBOURS + 1)
    entry = ups.join(least.select(F.col("up").alias("next"), "least"), "next").select(
        F.col("blk").alias("up"), "least"
    )
    within = Window.partitionBy("up").orderBy("blk")
    return (
        grouped.withColumn("next", F.lead("blk").over(within))
        .join(entry, "up", "left")
        .select("blk", F.coalesce("next", "least").alias("next"))
    )


def with_next(docs: DataFrame) -> DataFrame:
    """blk, rn, doc_id, text, and next_text: the text of the next document by doc_id.

    (blk, rn) numbers the rows uniquely. After the last document comes the first. Rows of
    one doc_id follow each other by the hash of their text; rows without doc_id come
    last, in the order of that hash. doc_id is a whole number.
    """
    bounds = docs.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    n, low, high, rows = bounds[0], bounds[1] or 0, bounds[2] or 0, bounds[3]
    # Stretches by quantiles, so ids far off or unevenly spread do not share a block with the rest.
    shares = max(1, min(STRETCHES, n // NEIGHBOURS))
    at = docs.agg(F.percentile_approx("doc_id", [k / shares for k in range(1, shares)])).first()[0] if shares > 1 else []
    lows = sorted({low, *at})
    inside = -(-n // (shares * NEIGHBOURS)) or 1
    ends = [*lows[1:], high + 1]
    widths = [-(-(end - start) // inside) for start, end in zip(lows, ends, strict=True)]
    numbered = len(lows) * inside
    unnumbered = (rows - n) // NEIGHBOURS + 1
    text = text_of()
    place = F.xxhash64(text)
    stretch = F.size(F.filter(F.lit(lows[1:]).cast("array<long>"), lambda x: x <= F.col("doc_id")))
    of = lambda numbers, k: F.get(F.lit(numbers).cast("array<long>"), k)
    within = lambda k: F.least(
        F.floor((F.col("doc_id") - of(lows, k)) / of(widths, k)), F.lit(inside - 1)
    )
    block = F.coalesce(
        F.when(F.col("doc_id").isNotNull(), _let(stretch, lambda k: k * inside + within(k))),
        numbered + F.floor((place / float(1 << 64) + 0.5) * unnumbered),
    ).cast("long")
    cut = docs.select("doc_id", text.alias("text"), place.alias("_place"), block.alias("blk"))
    order = Window.partitionBy("blk").orderBy("doc_id", "_place")
    cut = cut.withColumn("rn", F.row_number().over(order)).withColumn(
        "_after", F.lead("text").over(order)
    )
    heads = cut.where("rn = 1").select("blk", "text")
    blocks = docs.select(block.alias("blk")) if rows == n else cut.select("blk")
    hops = _next_block(blocks.distinct(), numbered + unnumbered)
    first = F.lit(0 if n else numbered).cast("long")
    hops = hops.select("blk", F.coalesce("next", first).alias("next"))
    entry = hops.join(
        heads.select(F.col("blk").alias("next"), F.col("text").alias("_entry")), "next"
    ).select("blk", "next", "_entry")
    return cut.join(entry, "blk").select(
        "blk",
        "next",
        "rn",
        "doc_id",
        "text",
        F.when(F.col("_after").isNull(), F.col("_entry")).otherwise(F.col("_after")).alias("next_text"),
    )


def edited(text: Column, after: Column) -> Column:
    """The last quarter replaced by the first code points of ``after``."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(text.substr(F.lit(1), n - cut), after.substr(F.lit(1), cut))


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256 and, as longs, fp, edited_fp, next_fp of every row.

    Null text counts as empty; an empty text has fingerprint 0 and an empty edited text.
    """
    rows = with_next(docs).select(
        "blk", "next", "rn", "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "text",
        edited(F.col("text"), F.col("next_text")).alias("edited"),
    )
    # Both texts under one aggregation, which the partitioning by block already serves.
    keys = ["blk", "next", "rn", "doc_id", "n_chars", "edited_sha256", "version"]
    both = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).select(
        *keys[:-1], F.posexplode(F.array("text", "edited")).alias("version", "text")
    )
    prints = fingerprints(both, keys)
    wide = prints.groupBy(*keys[:-1]).agg(
        F.max(F.when(F.col("version") == 0, F.col("fp"))).alias("fp"),
        F.max(F.when(F.col("version") == 1, F.col("fp"))).alias("edited_fp"),
    )
    order = Window.partitionBy("blk").orderBy("rn")
    return wide.withColumn("_after", F.lead("fp").over(order))


def next_fingerprints(rows: DataFrame) -> DataFrame:
    """Adds next_fp to stored rows of :func:`fingerprint_rows`, across blocks too."""
    heads = rows.where("rn = 1").select(F.col("blk").alias("next"), F.col("fp").alias("_entry"))
    return rows.join(heads, "next").withColumn("next_fp", F.coalesce("_after", "_entry"))
