import re
from collections import defaultdict

from pyspark.sql import functions as F

from latewin.llm.mixing import mix, mixed_documents, source_targets
from tests.llm.conftest import ODD_ROWS


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, total, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: float(most * sizes[s]) for s in over}
        open_ -= over
    return target


def test_targets(spark):
    cases = [
        {"a": 10, "b": 1000, "c": 1000, None: 5},
        {"a": 1, "b": 1, "c": 10_000, "d": 0},
        {"only": 7},
        {"a": 0, None: 0},
        {f"s{i}": (i * 37) % 101 for i in range(40)},
        {"z": 5, "é": 5, "Z": 90, "\U0001f389": 4, "￮": 3},
    ]
    for sizes in cases:
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(rows).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def big(make_docs):
    sources = ["hot"] * 8 + ["b", "c", None, "d"]
    return make_docs([(i, "w " * (1 + (i * 7919) % 97), sources[i % 12]) for i in range(12_000)], 6)


def test_near_targets_bounded_and_repeatable(make_docs):
    docs = big(make_docs)
    rows = mix(docs, block_rows=256).collect()
    assert len(rows) == 12_000
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - t) < 0.03 * t for s, t in target.items())
    again = {r.doc_id: r.copies for r in mix(docs.repartition(3), block_rows=256).collect()}
    assert again == {r.doc_id: r.copies for r in rows}
    whole = mixed_documents(docs.withColumn("copies", F.lit("own")), block_rows=256)
    assert whole.columns == [*docs.columns, "copies"]
    counted = {r.doc_id: r["count"] for r in whole.groupBy("doc_id").count().collect()}
    assert counted == {r.doc_id: r.copies for r in rows if r.copies}


def test_odd_rows(odd_docs, no_docs):
    rows = mix(odd_docs).collect()
    assert len(rows) == len(ODD_ROWS)
    want = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ODD_ROWS)
    assert sorted(r.size for r in rows) == want
    assert mix(no_docs).collect() == [] and mixed_documents(no_docs).collect() == []


def test_no_words_at_all(make_docs):
    rows = mix(make_docs([(1, ""), (2, None, "x"), (3, " ", None)])).collect()
    assert all((r.size, r.target, r.copies) == (0, 0.0, 0) for r in rows)
