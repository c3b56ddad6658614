import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from latewin.llm.exact import exact_dedup, exact_groups
from tests.llm.conftest import ODD_ROWS


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((i, text or ""))
    out = []
    for content, members in groups.items():
        numbered = [m for m in members if m[0] is not None]
        # The most code points first, also where a row without doc_id has them.
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        sha = hashlib.sha256(content.encode()).hexdigest()
        out += [(i, keep, len(members), i == keep, sha) for i, _ in members]
        assert numbered or keep is None
    return sorted(out, key=repr)


def test_odd_rows(odd_docs):
    got = sorted((tuple(r) for r in exact_groups(odd_docs).collect()), key=repr)
    assert got == brute([r[:2] for r in ODD_ROWS])


def test_longest_then_smallest_stays(make_docs):
    rows = [(9, "a b"), (3, "ab"), (4, "a  b"), (2, "a\tb "), (7, "x"), (1, "x")]
    got = {r.doc_id: r for r in exact_groups(make_docs(rows)).collect()}
    assert {i for i, r in got.items() if r.kept} == {2, 1}
    assert got[3].keep_id == 2 and got[3].group_size == 4


def test_hot_group_and_salts(make_docs):
    rows = [(i, "same text" if i % 3 else f"own {i}") for i in range(600)]
    one = sorted(map(tuple, exact_groups(make_docs(rows), salts=1).collect()))
    many = sorted(map(tuple, exact_groups(make_docs(rows, 8), salts=64).collect()))
    assert one == many == sorted(brute(rows), key=lambda r: r[0])


def test_dedup_keeps_columns_and_clashing_names(make_docs):
    docs = make_docs([(1, "a"), (2, " a"), (3, "b")]).withColumns(
        {"_sha": F.lit("own"), "keep_sha": F.lit("own"), "row": F.lit(3), "digest": F.lit("x"), "salt": F.lit(1), "kept": F.lit(False), "keep_id": F.lit(0)}
    )
    out = exact_dedup(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == [2, 3]
    assert {(r["_sha"], r["keep_sha"], r["row"]) for r in rows} == {("own", "own", 3)}


def test_empty(no_docs):
    assert exact_groups(no_docs).collect() == []
    assert exact_dedup(no_docs).collect() == []
