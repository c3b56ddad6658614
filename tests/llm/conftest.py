import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session", autouse=True)
def pseudonym_key(spark):
    """The session's secret key, which pseudonyms need."""
    spark.conf.set("spark.latewin.pseudonymKey", "example-key")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) rows, over several partitions."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return make


ODD_ROWS = [
    (1, "alpha beta gamma delta epsilon zeta"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "alpha beta gamma delta epsilon zeta"),
    (5, "alpha beta gamma delta epsilon zeta"),
    (None, "alpha beta gamma delta epsilon zeta"),
    (None, None),
    (6, "one"),
    (7, "word " * 30_000),
    (8, "x" * 200_000),
    (9, "é ß İ \U0001f389 你好 \x00\x1c end"),
]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and very long texts, ties and repeated rows."""
    return make_docs(ODD_ROWS)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([], 1)
