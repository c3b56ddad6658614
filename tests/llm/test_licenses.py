import random
import re

import pytest
from pyspark.sql import functions as F

from latewin.llm import licenses
from latewin.llm.byte_words import words_of
from latewin.llm.licenses import Join, Template, license_labels, make_templates, scan_licenses
from tests.llm.conftest import ODD_ROWS

TEXTS = (
    ("a", "red green blue red grey black white"),
    ("b", "one two three"),
    ("c", "two three four five six seven eight nine ten one"),
)
PHRASES = (("p", "three one two"), ("q", "green red"))


def ordered(templates, rng):
    pool = sorted({w for t in templates for w in t.words})
    rng.shuffle(pool)
    for t in templates:
        t.order = sorted(set(t.words), key=pool.index)
    return templates


def brute(words, templates):
    """Every block of every template, one at each word, without any filter."""
    places, hits = [], {}
    for k, t in enumerate(templates):
        size = len(t.words)
        if t.phrase:
            places += [
                (t.label, i) for i in range(len(words) - size + 1) if words[i : i + size] == t.words
            ]
            continue
        best = 0
        for i in range(max(1, len(words) - size + 1)):
            best = max(best, len(set(words[i : i + size]) & set(t.words)))
        if best >= t.least:
            hits[k] = best / len(set(t.words))
    return sorted(places, key=lambda p: (p[1], p[0])), hits


@pytest.mark.parametrize("seed", range(60))
def test_blocks_equal_brute_force(seed):
    rng = random.Random(seed)
    templates = ordered(make_templates(TEXTS, PHRASES, rng.choice([0.5, 0.8, 1.0])), rng)
    pool = [w.decode() for t in templates for w in t.words] + ["x", "y"] * rng.randrange(8)
    data = " ".join(rng.choice(pool) for _ in range(rng.randrange(200))).encode()
    join = Join(templates)
    n, places, blocks = join.text(data)
    want_places, want = brute(words_of(data), templates)
    assert n == len(words_of(data)) and places == want_places
    best = {}
    for label, start, end, share in blocks:
        best[label] = max(share, best.get(label, 0))
        assert 0 <= start < end <= n
    assert best == {templates[k].label: share for k, share in want.items()}
    # Cut into stretches the result is the same.
    assert join.text(data, 40) == (n, places, blocks)


def test_real_notices(make_docs):
    rows = [
        (1, "Some code.\nReleased under the MIT License.\nMore."),
        (2, "Licensed under the Apache License, Version 2.0"),
        (3, "Licensed under CC BY-NC 4.0."),
        (4, "This work is licensed under the GNU General Public License, version 3."),
        (5, "Redistribution and use in source and binary forms, with or without\n# modification,"
            " are permitted provided that following conditions are met:"),
        (6, "The public has general use of this work, version by version, under the sun."),
        (7, "under the mit license " * 3),
        *[(None, t) for _, t in ODD_ROWS],
    ]
    docs = make_docs(rows).withColumns({"labels": F.lit("x"), "n_words": F.lit("y")})
    out = license_labels(scan_licenses(docs)).collect()
    got = {r.doc_id: r for r in out if r.doc_id}
    assert [got[i].labels for i in range(1, 8)] == [
        "mit", "apache-2", "cc-by-nc", "gpl-3", "bsd", "", "mit",
    ]
    assert [got[i].base_labels for i in range(1, 8)] == ["mit", "apache-2", "cc-by-nc", "", "", "", "mit"]
    assert (got[7].n_base, got[7].first_word, got[7].last_word, got[7].score) == (3, 0, 8, 1.0)
    assert got[6].score == 0.0 and 0.8 <= got[5].score < 1 and got[6].first_word is None
    assert sum(r.doc_id is None for r in out) == len(ODD_ROWS)
    for r in out:
        if r.doc_id is None:
            assert (r.labels, r.n_base) == ("", 0)
    words = sorted(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t or "")) for _, t in ODD_ROWS)
    assert sorted(r.n_words for r in out if r.doc_id is None) == words


def test_frequent_template_words(make_docs):
    """Words in a third of all texts come last in the order, so they are not in a prefix."""
    rows = [(i, "the software is provided " * 40) for i in range(50)] + [(99, licenses.TEMPLATES[1][1])]
    ordered = licenses.order_templates(make_docs(rows), make_templates())
    for t in ordered:
        if not t.phrase and len(t.order) > 20:
            assert not {b"the", b"software", b"is", b"provided"} & set(t.prefix())
    got = {r.doc_id: r.labels for r in license_labels(scan_licenses(make_docs(rows))).collect()}
    assert got[99] == "mit" and got[0] == ""


def test_checks_and_empty(no_docs, make_docs):
    assert scan_licenses(no_docs).collect() == []
    with pytest.raises(ValueError):
        make_templates([("x", "...")])
    with pytest.raises(ValueError):
        make_templates(threshold=0)
    none = scan_licenses(make_docs([(1, "a b")]), []).first()
    assert (none.n_words, none.places, none.blocks) == (2, [], [])
    assert Template("x", [b"a", b"b"], 1, order=[b"a", b"b"]).prefix() == [b"a", b"b"]
