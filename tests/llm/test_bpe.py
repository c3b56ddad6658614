import hashlib
import random
import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from latewin.llm import bpe
from latewin.llm.bpe import PieceMemory, WordBpe, encode_digests, encode_documents
from tests.llm.conftest import ODD_ROWS

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = WordBpe(PATH)


def library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "Hello worLd's  x", "aaaaaaaaaaaaaaaa", "<|endoftext|>", "a<|startoftext|>B c",
        "İstanbul ΣΑΣ ß é́", "你好 🎉👍🏽", "I'LL don'T '''s .....", "1234 ½ \x00\x1c\x1f a b　c",
        "<|endoftext|", "x" * 5000,
    ],
)
def test_same_as_library(text):
    ids = OWN.encode([text])[0]
    assert (ids, OWN.decode(ids)) == library(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text(texts):
    assert OWN.encode(texts) == [library(t)[0] for t in texts]


def test_rows(odd_docs):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for row in ODD_ROWS:
        ids, decoded = library(row[1] or "")
        want.append((row[0], len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    got = [tuple(r) for r in encode_digests(odd_docs, PATH).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_real_outputs_and_clashing_columns(make_docs, no_docs):
    docs = make_docs([(1, "Hello"), (2, None)]).withColumn("ids", F.lit("own"))
    got = {r.doc_id: r for r in encode_documents(docs, PATH).collect()}
    assert (list(got[1].ids), got[1].decoded) == library("Hello")
    assert list(got[2].ids) == [] and got[2].decoded == "" and got[2].n_tokens == 0
    assert encode_documents(no_docs, PATH).collect() == []


@pytest.mark.parametrize("seed", range(25))
def test_long_words(seed):
    """Words that take the rounds for long words, among short ones."""
    rng = random.Random(seed)
    letters = rng.choice(["ab", "aab", "abcdefghijklmnopqrstuvwxyz", "etaoin", "中é1"])
    words = ["".join(rng.choices(letters, k=rng.choice([3, 255, 256, 257, 900]))) for _ in range(6)]
    text = " ".join([*words, "a" * 700, "ab" * 300])
    assert OWN.encode([text])[0] == library(text)[0]


def test_time_in_proportion():
    rng = random.Random(0)

    def seconds(n):
        word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
        start = time.perf_counter()
        OWN.encode([word])
        return time.perf_counter() - start

    seconds(1000)
    # In proportion to the square it would be 64 times as long.
    assert seconds(160_000) < 24 * max(seconds(20_000), 0.05)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 20_000)
    monkeypatch.setattr(bpe, "SLICE", 500)
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.random()}" for _ in range(rng.randrange(400))) for _ in range(30)]
    memory, most = PieceMemory(OWN), 0
    for text, ids in zip(texts, memory.texts(texts), strict=True):
        assert ids.tolist() == library(text)[0]
        most = max(most, memory.held)
    # What one slice adds comes on top, whatever the texts hold.
    assert most < 20_000 + 500 * (bpe.PIECE_BYTES + 5)
