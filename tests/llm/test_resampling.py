import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latewin.llm import resampling
from latewin.llm.byte_words import stretches, words_of
from latewin.llm.resampling import Resampling, feature_hashes, resample
from tests.llm.conftest import ODD_ROWS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, target, cfg):
    def features(text):
        words = plain_words(text)
        return [
            crc32(" ".join(words[i : i + n]).encode()) % cfg.buckets
            for n in range(1, cfg.order + 1)
            for i in range(len(words) - n + 1)
        ]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text))
    for _, text in target:
        t.update(features(text))
    total, wanted = sum(s.values()), sum(t.values())
    out = []
    for name, text in rows:
        found = features(text)
        gain = [
            math.floor(1000 * math.log(
                float(t[b] + 1) * (total + cfg.buckets) / (float(s[b] + 1) * (wanted + cfg.buckets))))
            for b in found
        ]
        weight = sum(gain) // len(gain) if gain else 0
        key = f"{cfg.seed}:{'' if name is None else name}".encode()
        h = int(hashlib.sha256(key).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([name, len(plain_words(text)), len(found), weight, score, None])
    able = [r for r in out if r[1] >= cfg.least_words]
    able.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, row in enumerate(able[: len(able) * cfg.percent // 100]):
        row[5] = place + 1
    return sorted(map(tuple, out), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.integers(1, 3), st.integers(1, 30))
def test_words_and_chained_checksums(text, order, size):
    data = text.encode("utf-8", "ignore")
    text = data.decode()
    assert [w.decode() for w in words_of(data)] == plain_words(text)
    assert [w for part in stretches(data, size) for w in part] == words_of(data)
    words = plain_words(text)
    want = Counter(
        crc32(" ".join(words[i : i + n]).encode())
        for n in range(1, order + 1)
        for i in range(len(words) - n + 1)
    )
    parts = list(feature_hashes(data, order, size))
    assert Counter(h for _, found in parts for h in found) == want
    assert sum(n for n, _ in parts) == len(words)


@pytest.mark.parametrize("order", [1, 2])
def test_equals_brute_force(make_docs, order, monkeypatch):
    monkeypatch.setattr(resampling, "COUNTED", 50)
    rng = np.random.default_rng(order)
    words = [f"w{k}" for k in range(40)]
    rows = [
        (i, " ".join(rng.choice(words, size=int(rng.integers(0, 60))))) for i in range(300)
    ] + ODD_ROWS
    target = [(k, f"W1 w2, w3 w{k}") for k in range(20)] + [(None, None)]
    cfg = Resampling(order=order, buckets=64, percent=30)
    clash = make_docs(rows).withColumns({"score": F.lit("x"), "rank": F.lit(1), "weight": F.lit(2)})
    got = sorted(map(tuple, resample(clash, make_docs(target), cfg).collect()), key=repr)
    # Two equal rows share a doc_id and a score, so their ranks may be either way round.
    assert got == brute(rows, target, cfg)


def test_ties_and_shares(make_docs):
    rows = [(7, "a " * 20)] * 10 + [(8, "b")]
    got = resample(make_docs(rows), make_docs([(1, "a")]), Resampling(percent=50)).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]
    assert all(r["rank"] is None for r in got if r.doc_id == 8)


def test_empty_tables(make_docs, no_docs):
    assert resample(no_docs, no_docs).collect() == []
    got = resample(make_docs([(1, "x"), (2, None)]), no_docs).collect()
    assert {r.doc_id: r.n_features for r in got} == {1: 1, 2: 0}
    assert resample(no_docs, make_docs([(1, "x")])).collect() == []
