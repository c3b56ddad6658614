"""Exact duplicates by skew-safe combining.

Texts are equal when identical once white space is deleted. Rows are combined
three times, each time grouped by the digest *and* the whole normalised text:

1. within each task, by the partial aggregation before the first exchange;
2. by (digest, salt), so that a digest holding a third of all rows meets in
   ``salts`` places and not in one;
3. the salt winners by digest.

A digest with a single text after step 3 identifies its rows. One that belongs
to several texts (a collision) has its rows matched by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewin.llm.tables import text_of

SALTS = 32
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
# doc_id in the low digits, reversed, under the number of code points.
_SPAN = "10000000000000000000"
_TOP = "9223372036854775808"


def normalised(text: Column) -> Column:
    return F.translate(text, _BLANKS, "")


def _decimal(value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return value.cast("decimal(38,0)")


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """Larger for more code points, then for a smaller doc_id; null ids lose.

    A decimal keeps the aggregation buffer fixed in size, so the combining is a
    hash aggregation.
    """
    order = F.coalesce(_decimal(_TOP) - _decimal(doc_id), _decimal("0"))
    return (_decimal(n_chars) * _decimal(_SPAN) + order).cast("decimal(38,0)")


def _doc_of(rank: Column) -> Column:
    low = rank % _decimal(_SPAN)
    return F.when(low != 0, (_decimal(_TOP) - low).cast("long"))


def exact_classes(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, content, keep_id, group_size."""
    text = text_of()
    rows = docs.select(
        normalised(text).alias("content"),
        _rank(F.length(text), F.col("doc_id")).alias("rank"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"),
    ).withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))
    salted = rows.groupBy("digest", "salt", "content").agg(
        F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n")
    )
    return (
        salted.groupBy("digest", "content")
        .agg(F.max("rank").alias("rank"), F.sum("n").alias("group_size"))
        .select("digest", "content", _doc_of(F.col("rank")).alias("keep_id"), "group_size")
    )


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Every row with the row that stays: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; texts of white space only equal the empty text.
    Rows with one doc_id and one text are both marked kept. A null doc_id is kept
    only if its group has no other id. Columns beyond doc_id and text are ignored.
    """
    from latewin.session import stage

    classes = stage(
        exact_classes(docs, salts)
        .groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("texts"),
            F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
        ),
        "exact",
    )
    rows = docs.select(
        "doc_id", F.sha2(normalised(text_of()).cast("binary"), 256).alias("digest")
    )
    plain = rows.join(classes.where("texts = 1").drop("texts"), "digest")
    columns = [
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    ]
    result = plain.select(*columns)
    if not classes.where("texts > 1").isEmpty():
        result = result.unionByName(
            _collided(docs, classes.where("texts > 1").select("digest"), salts).select(*columns)
        )
    return result


def _collided(docs: DataFrame, digests: DataFrame, salts: int) -> DataFrame:
    rows = docs.select(
        "doc_id", normalised(text_of()).alias("content")
    ).withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))
    texts = exact_classes(docs, salts).join(digests, "digest", "left_semi")
    return rows.join(texts, ["digest", "content"])


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all their columns.

    Of several rows with the kept doc_id and the same text, one stays.
    """
    keep = exact_groups(docs, salts).where("kept").select("doc_id", "text_sha256").distinct()
    keep = keep.select(F.col("doc_id").alias("keep_doc"), F.col("text_sha256").alias("keep_sha"))
    # The row travels whole in one column, so none of its names can clash.
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.col("doc_id").alias("row_doc"),
        F.sha2(normalised(text_of()).cast("binary"), 256).alias("row_sha"),
    )
    same = F.col("row_doc").eqNullSafe(F.col("keep_doc")) & (F.col("row_sha") == F.col("keep_sha"))
    return rows.join(keep, same, "left_semi").select("row.*")
