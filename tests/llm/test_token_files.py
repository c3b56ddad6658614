import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from latewin.llm.context_coder import ID_LIMIT, decode, encode
from latewin.llm.token_files import (
    PieceEncoder,
    decode_documents,
    document_digests,
    read_files,
    write_files,
)

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, ID_LIMIT - 1), max_size=300), st.integers(1, 64))
def test_round_trip(ids, block):
    assert decode(encode(np.array(ids, dtype=np.int64), block)).tolist() == ids


def test_predictable_ids_shrink_and_blocks_are_independent():
    ids = np.tile(np.arange(50) * 991, 400)
    file = encode(ids)
    assert len(file) < len(ids) / 2 and decode(file).tolist() == ids.tolist()
    rng = np.random.default_rng(2)
    noise = rng.integers(0, 50_000, 9000)
    assert decode(encode(noise)).tolist() == noise.tolist()


def test_damage_is_found():
    file = bytearray(encode(np.arange(5000)))
    file[-40] ^= 1
    with pytest.raises(ValueError, match="checksum of block"):
        decode(bytes(file))
    with pytest.raises(ValueError, match="not a file"):
        decode(b"something else, long enough to have a head")
    with pytest.raises(ValueError):
        decode(bytes(file[:-8]))
    with pytest.raises(ValueError):
        encode(np.array([ID_LIMIT]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab' .\n\t　\x1c1é<|endoftxt>"), max_size=40), max_size=3))
def test_pieces_equal_the_library(texts):
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in PieceEncoder(PATH).encode(texts)] == want


def test_many_unseen_pieces_joined():
    rng = random.Random(3)
    letters = "abcdeé.,'ß1中"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(7000)]
    texts = ["".join(w + rng.choice([" ", " ", "\n"]) for w in words), "\n".join(words[:50]), "\n", " \n"]
    encoder = PieceEncoder(PATH)
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_token_in_text():
    text = "a <|endoftext|> b<|endoftext|>"
    got = np.frombuffer(PieceEncoder(PATH).encode([text])[0], "<u4").tolist()
    assert got == LIBRARY.encode(text, add_special_tokens=False).ids and 50256 in got


def test_documents_in_order(spark, make_docs, tmp_path):
    rng = random.Random(1)
    rows = [(i * 7 - 50, " ".join(rng.choice(["the", "of", "zebra", "q1"]) for _ in range(rng.randrange(60)))) for i in range(80)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 20_000)]
    path = str(tmp_path / "files")
    write_files(make_docs(rows, 5), PATH, path, file_ids=500)
    files = read_files(spark, path)
    assert files.count() > 3
    start = 0
    got = {r.doc_id: r for r in document_digests(files).collect()}
    full = {r.doc_id: r for r in decode_documents(files).collect()}
    for doc_id, text in sorted(rows):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        raw = np.array(ids, dtype="<u4").tobytes()
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(raw))
        assert list(full[doc_id].ids) == ids
        start += len(ids)


def test_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    write_files(odd_docs.withColumn("body", odd_docs["text"]), PATH, str(tmp_path / "odd"))
    got = document_digests(read_files(spark, str(tmp_path / "odd"))).collect()
    assert len(got) == odd_docs.count()
    assert sum(r.doc_id is None for r in got) == 2
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    write_files(no_docs, PATH, str(tmp_path / "none"))
    assert document_digests(read_files(spark, str(tmp_path / "none"))).collect() == []


def test_repeated_rows_over_files(spark, make_docs, tmp_path):
    """Files that hold the same are still different files."""
    path = str(tmp_path / "repeats")
    write_files(make_docs([(1, "a b"), (1, "a b"), (2, "c")] + [(None, None)] * 4, 2), PATH, path, file_ids=1)
    got = document_digests(read_files(spark, path)).collect()
    assert len(got) == 7 == read_files(spark, path).count()
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None] * 4 + [1, 1, 2]
