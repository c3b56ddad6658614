import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from latewin.llm.components import components
from latewin.llm.near import near_dedup, near_duplicates
from tests.llm.conftest import ODD_ROWS


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in lists[x] if j < i).items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def check(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_groups_of_copies_shared_passages_and_chains(make_docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(60)]
    rows, n = [], 0
    for group in range(12):
        base = [word() for _ in range(rng.choice([4, 6, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
        # Each link of a chain differs a little more from the first.
        chain = [word() for _ in range(120)]
        for k in range(6):
            chain = [*chain[3:], word(), word(), word()]
            rows.append((n, " ".join(chain)))
            n += 1
    for k in range(60):
        own = [word() for _ in range(rng.choice([3, 5, 10, 100]))]
        rows.append((n, " ".join([*own, *passage])))
        n += 1
    rng.shuffle(rows)
    check(make_docs(rows), rows)


def test_case_and_few_words(make_docs):
    rows = [(1, "One Two"), (2, "one  two"), (3, "two one"), (4, "É a"), (5, "é a")]
    check(make_docs(rows), rows)


def test_odd_rows(odd_docs):
    got = near_duplicates(odd_docs).collect()
    assert len(got) == len(ODD_ROWS)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[5].component_id == 1 and not by_id[5].kept
    assert by_id[2].n_shingles == 0 and by_id[2].kept and by_id[3].kept
    assert by_id[7].n_shingles == 1
    assert sorted((r.component_id or 0) for r in got if r.doc_id is None) == [0, 1]


def test_dedup_keeps_columns(make_docs):
    docs = make_docs([(2, "a b c d e f"), (1, "a b c d e f"), (3, "")]).withColumns(
        {"node": F.lit(1), "digest": F.lit("d"), "root": F.lit(0)}
    )
    out = near_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_empty(no_docs):
    assert near_duplicates(no_docs).collect() == []


def test_components_of_long_paths(spark):
    rng = random.Random(3)
    names = list(range(200))
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(199) if i % 50 != 49]
    edges += [(5, 5), (None, 3), edges[0]]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    for k in range(4):
        part = names[50 * k : 50 * (k + 1)]
        assert {found[x] for x in part} == {min(part)}


def test_one_id_with_two_texts(make_docs):
    rows = [(1, "a b c d e f"), (1, "p q r s t u"), (2, "p q r s t u"), (3, "a b c d e f")]
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(make_docs(rows)).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1)]
