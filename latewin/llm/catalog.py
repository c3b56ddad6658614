"""The operators' queries over the given tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latewin.llm import (
    bpe,
    catalog_sql,
    exact,
    lbl,
    licenses,
    mixing,
    near,
    pii,
    prefix_trie,
    resampling,
    secret_scan,
    simhash,
    token_files,
    toxicity,
)
from latewin.llm.tables import documents, id_remainder, table
from latewin.session import scratch_dir, stage


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    samples = secret_scan.labelled_samples(spark).unionByName(secret_scan.corpus_samples(docs))
    return secret_scan.scan_secrets(docs, secret_scan.train(samples))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-files")
    token_files.write_files(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), path
    )
    return token_files.document_digests(token_files.read_files(spark, path))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal fingerprints (smallest doc_id, size) and, for documents whose id
    divides by 100, matches: all classes within the search radius, distance 0 included, and
    n_within: the number of other fingerprints among them. Members of a class have its
    fingerprint."""
    prints = stage(simhash.fingerprint_rows(documents(spark, sf_dir)), "fingerprints")
    asked = F.col("doc_id") % 100 == 0
    rows = simhash.with_matches(simhash.next_fingerprints(prints), prints, asked)
    fp = F.col("fp")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        simhash.as_hex(fp).alias("fingerprint"),
        simhash.as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        simhash.likeness(fp, F.col("edited_fp")).alias("near_edited"),
        simhash.likeness(fp, F.col("next_fp")).alias("near_next"),
        F.when(asked, F.size(F.filter("matches", lambda m: m["distance"] > 0)).cast("long")).alias("n_within"),
        "class_id",
        "class_size",
        F.transform(
            "matches",
            lambda m: F.struct(
                m["distance"].alias("distance"), simhash.as_hex(m["fp"]).alias("fingerprint"),
                m["doc_id"].alias("doc_id"), m["size"].alias("size"),
            ),
        ).alias("matches"),
    )


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(pii.KEY_SETTING, "key of the test tables")
    return pii.pseudonymise(documents(spark, sf_dir), key).select(
        "doc_id", "text", "n_found",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.transform("values", lambda v: v["pseudonym"]).alias("pseudonyms"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(
        documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")
    )


def op8_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score_documents(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(id_remainder(3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"),
    )


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_labels(licenses.scan_licenses(documents(spark, sf_dir)))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


_RE_SPACE = r"[\x20\x09-\x0D]"

EXACT_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '{_RE_SPACE}', '', 'g') AS c FROM documents
), g AS (
  SELECT doc_id, c,
         first_value(doc_id) OVER (PARTITION BY c ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY c) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(c) AS text_sha256 FROM g
"""

MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents
), s AS (
  SELECT source, skey, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY ALL
), w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE
    AS weight FROM s
), l AS (SELECT *, 3 * source_size / weight AS level FROM w), a AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, sum(weight) OVER () AS weights,
    coalesce(sum(3 * source_size) OVER o, 0)::DOUBLE AS capped, coalesce(sum(weight) OVER o, 0.0) AS gone
  FROM l WINDOW o AS (ORDER BY level, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT *, (total - capped) / (weights - gone) AS share FROM a),
m AS (
  SELECT share AS rest FROM f WHERE level >= share ORDER BY level, encode(source) NULLS LAST LIMIT 1
), t AS (
  SELECT skey, source_size,
    CASE WHEN level < share THEN (3 * source_size)::DOUBLE
         ELSE least(weight * rest, (3 * source_size)::DOUBLE) END AS target FROM f, m
), b AS (SELECT greatest(1, ceil(max(n) / {mixing.BLOCK_ROWS}.0))::BIGINT AS buckets FROM s), p AS (
  SELECT d.doc_id, d.skey, d.size, d.place,
    CASE WHEN size = 0 THEN 1 ELSE length(bin(size)) END AS class,
    floor(('0x' || place[1:12])::BIGINT::DOUBLE / 281474976710656.0 * buckets)::BIGINT AS bucket
  FROM d, b
), r AS (
  SELECT p.*, row_number() OVER (
    PARTITION BY skey ORDER BY class, bucket, size, place, doc_id) AS nth FROM p
), e AS (
  SELECT r.*, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || md5('{mixing.SEED}|' || skey)[1:12])::BIGINT::DOUBLE / 281474976710656.0 AS off
  FROM r JOIN t USING (skey)
)
SELECT doc_id, size, source_size, target,
  (size * least(floor(nth * rate + off) - floor((nth - 1) * rate + off), 3))::BIGINT AS taken FROM e
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_token_files, op3_exact_dedup, op4_near_dedup, op5_simhash,
        op6_pseudonyms, op7_bpe, op8_log_bilinear, op9_mixing, op10_toxicity,
        op11_resampling, op12_licenses, op13_prefix_trie,
    )
}
SQL = {"op3_exact_dedup": EXACT_SQL, "op9_mixing": MIX_SQL} | catalog_sql.SQL
