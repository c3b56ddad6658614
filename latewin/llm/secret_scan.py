"""Secret scans with character Markov models.

Three fixed patterns give the base spans. Beyond them, every run of token characters
is scored by two first-order Markov models of characters, one of random strings
and one of ordinary identifiers; a run whose log-likelihood ratio exceeds a bar that
depends on its length is a further span. Only built-in functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latewin.llm.spans import located
from latewin.llm.tables import WORD, text_of

# Fixed patterns. The two whose length is tested take it into the repetition, which
# gives the same matches: a run that is too short holds no longer one.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
)
ASSIGN_VALUE = (
    r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9+/_.=-]+)$"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")

#: Runs that the models judge: token characters, outside the base spans.
LEAST_RUN = 12
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}"
#: Characters of the models, in the order of their rows and columns.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Mean log-likelihood ratio (nats per character) from which a run is a secret.
THRESHOLD = 0.35
#: The whole ratio (nats) that a run needs besides, which is more a character in a short one.
LEAST_RATIO = 10.0

# Parts of ordinary identifiers, from which labelled samples are composed.
PARTS = (
    "get set add new old max min sum key map row col log run end top user name file path data "
    "list item node type size text line word page time date year hour code mode state index "
    "value count table query event model layer batch block token parse build write print "
    "start stop open close first last next prev left right parent child string number object "
    "array class method field buffer stream client server request response handler manager "
    "service config option default error message session project account document version"
).split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(sample, random): random strings of several alphabets and composed identifiers."""
    i = F.col("id")
    digest = F.sha2(F.concat(F.lit("sample-"), i.cast("string")).cast("binary"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    random = F.when(i % 4 == 0, digest).when(i % 4 == 1, F.upper(F.substring(base64, 1, 20)))
    random = random.when(i % 4 == 2, F.translate(base64, "+/", "")).otherwise(base64)
    parts = F.array(*[F.lit(p) for p in PARTS])

    def part(k: int) -> Column:
        at = F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(PARTS))).cast("int") + 1
        return F.element_at(parts, at)

    snake = F.concat_ws("_", part(0), part(1), part(2), part(3))
    camel = F.concat(part(0), *[F.initcap(part(k)) for k in (1, 2, 3)])
    path = F.concat_ws("/", part(0), part(1), F.concat_ws("-", part(2), part(3)))
    upper = F.upper(F.concat_ws("_", part(0), part(1), part(2)))
    numbered = F.concat(snake, F.lit("_"), (i % 100).cast("string"))
    common = (
        F.when(i % 5 == 0, snake).when(i % 5 == 1, camel).when(i % 5 == 2, path)
        .when(i % 5 == 3, upper).otherwise(numbered)
    )
    ids = spark.range(n)
    return ids.select(random.alias("sample"), F.lit(True).alias("random")).union(
        ids.select(common.alias("sample"), F.lit(False).alias("random"))
    )


def corpus_samples(docs: DataFrame, documents: int = 200) -> DataFrame:
    """Ordinary words of at most ``documents`` documents, as further identifiers.

    The model is fitted on this bounded sample (the documents of least hash); every
    text is scanned.
    """
    chosen = (
        docs.select(text_of().alias("text"), F.xxhash64("doc_id").alias("h"))
        .orderBy("h", F.md5(F.col("text").cast("binary")))
        .limit(documents)
    )
    words = chosen.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    plain = words.where(F.col("w").rlike("^[A-Za-z]{2,24}$"))
    return plain.select(F.col("w").alias("sample"), F.lit(False).alias("random"))


def train(samples: DataFrame) -> list[float]:
    """The table of log-likelihood ratios, one number per ordered pair of ALPHABET.

    Pairs are counted by Spark; the result has a fixed size. Add-one smoothing gives
    unseen pairs a finite ratio, also for an empty table of samples.
    """
    clean = F.regexp_replace("sample", "[^A-Za-z0-9+/_=-]", "")
    pairs = samples.where("sample is not null").select("random", clean.alias("s")).select(
        "random",
        F.explode(
            F.transform(
                F.when(F.length("s") > 1, F.sequence(F.lit(1), F.length("s") - 1)).otherwise(
                    F.array().cast("array<int>")
                ),
                lambda i: F.col("s").substr(i, F.lit(2)),
            )
        ).alias("pair"),
    )
    size = len(ALPHABET)
    counts = {True: [0] * (size * size), False: [0] * (size * size)}
    for row in pairs.groupBy("random", "pair").count().collect():
        at = ALPHABET.index(row["pair"][0]) * size + ALPHABET.index(row["pair"][1])
        counts[row["random"]][at] = row["count"]
    table = []
    for a in range(size):
        here = slice(a * size, (a + 1) * size)
        r, o = counts[True][here], counts[False][here]
        for b in range(size):
            random = math.log((r[b] + 1) / (sum(r) + size))
            table.append(random - math.log((o[b] + 1) / (sum(o) + size)))
    return table


def markov_score(run: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a run of ALPHABET characters."""
    # One literal that is folded once, not an expression per number.
    numbers = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    size = len(ALPHABET)

    def after(acc: Column, c: Column) -> Column:
        code = F.instr(F.lit(ALPHABET), c) - 1
        ratio = F.coalesce(F.get(numbers, acc["code"] * size + code), F.lit(0.0))
        return F.struct(code.alias("code"), (acc["total"] + ratio).alias("total"))

    # Before the first character the index is negative, which adds nothing.
    total = F.aggregate(
        F.filter(F.split(run, ""), lambda c: c != ""),
        F.struct(F.lit(-1).alias("code"), F.lit(0.0).alias("total")),
        after,
        lambda acc: acc["total"],
    )
    return F.when(F.length(run) > 1, total / (F.length(run) - 1)).otherwise(0.0)


def _outside(run: Column, base: Column) -> Column:
    """The pieces of a run that no base span covers and that are long enough to judge."""
    kind = "struct<start:int,end:int,hit:string>"

    def piece(start: Column, end: Column) -> Column:
        found = F.struct(
            start.cast("int").alias("start"),
            end.cast("int").alias("end"),
            run["hit"].substr(start - run["start"] + 1, end - start).alias("hit"),
        )
        return F.when(end - start >= LEAST_RUN, F.array(found)).otherwise(
            F.array().cast(f"array<{kind}>")
        )

    touching = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    begin = F.struct(run["start"].alias("at"), F.array().cast(f"array<{kind}>").alias("all"))
    cut = F.aggregate(
        F.array_sort(F.transform(touching, lambda b: F.struct(b["start"], b["end"]))),
        begin,
        lambda acc, b: F.struct(
            F.greatest(acc["at"], b["end"]).alias("at"),
            F.concat(acc["all"], piece(acc["at"], b["start"])).alias("all"),
        ),
        lambda acc: F.concat(acc["all"], piece(acc["at"], run["end"])),
    )
    return F.when(F.size(touching) == 0, F.array(run)).otherwise(cut)


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            s["end"].alias("end"),
        ),
    )


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"]),
        ),
        ",",
    )


def scan_secrets(docs: DataFrame, table: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans of every row.

    Null and empty texts have no spans and the digest of the empty string. Of a run that
    touches base spans the models judge the pieces outside them. Each row is treated
    alone: repeated rows repeat their result and other columns are ignored.
    """
    text = F.col("_text")
    long_value = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN_VALUE, 1)) >= 12
    rows = docs.select("doc_id", text_of().alias("_text")).select(
        "doc_id",
        F.filter(located(text, ASSIGN), long_value).alias("assign"),
        located(text, ACCESS).alias("access"),
        located(text, HEX).alias("hex"),
        located(text, RUN).alias("runs"),
    )
    base = F.concat("assign", "access", "hex")
    rows = rows.withColumn(
        "markov",
        F.filter(
            F.flatten(F.transform("runs", lambda s: _outside(s, base))),
            lambda s: F.get(
                F.transform(
                    F.array(markov_score(s["hit"], table)),
                    lambda x: (x > threshold) & (x * (F.length(s["hit"]) - 1) > LEAST_RATIO),
                ),
                F.lit(0),
            ),
        ),
    )
    written = _written(F.concat(*[_tagged(F.col(k), k) for k in KINDS[:3]]))
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(written.cast("binary"), 256).alias("base_sha256"),
        _written(F.concat(*[_tagged(F.col(k), k) for k in KINDS])).alias("spans"),
    )
