"""The registered queries over the smallest tables; SQL where there is one."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from latewin.llm import exact, mixing, near, toxicity
from latewin.llm.catalog import QUERIES, SQL
from latewin.llm.tables import documents
from tests.oracle_check import compare, connect


def test_contract():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert QUERIES.keys() | {"pipeline"} <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    ok, note = compare(spark, connect(sf), sf, QUERIES[name], SQL[name])
    assert ok, note


@pytest.mark.parametrize("name", ["op2_token_files", "op7_bpe", "op10_toxicity"])
def test_a_row_per_document(spark, sf, name):
    docs = {r.doc_id for r in documents(spark, sf).select("doc_id").collect()}
    rows = QUERIES[name](spark, sf).collect()
    assert len(rows) == len(docs) and {r.doc_id for r in rows} == docs


def test_pipeline_stages(spark, sf):
    docs = documents(spark, sf)
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        before = docs.cache()
        docs = step(spark, before, sf)
        ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name == "exact_dedup":
            want = [r.doc_id for r in exact.exact_groups(before).collect() if r.kept]
        elif name == "near_dedup":
            want = [r.doc_id for r in near.near_duplicates(before).collect() if r.kept]
        elif name == "mixing":
            want = [r.doc_id for r in mixing.mix(before).collect() for _ in range(r.copies)]
        elif name == "toxicity":
            from latewin.llm.tables import table

            model = toxicity.train(before, table(spark, sf, "labels"))
            scored = toxicity.score_documents(before, model).collect()
            want = [r.doc_id for r in scored if r.score < toxicity.REJECT]
        else:
            want = [r.doc_id for r in before.select("doc_id").collect()]
        assert ids == sorted(want)
        if name != "bpe":
            assert docs.columns == columns
    assert set(docs.columns) == {"doc_id", "n_tokens", "ids", "decoded"}
