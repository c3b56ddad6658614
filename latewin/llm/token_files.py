"""Token ids of a corpus in files of the context-mixing coder.

A file holds whole documents in ascending doc_id order: the table of documents (their ids
and lengths) and the coded ids. Files are rows of a Parquet table, so any store Spark
writes to will do; a file is decoded on its own.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from latewin.llm.context_coder import decode, encode
from latewin.llm.tables import text_of

END_ID = 0
#: Ids a file holds before it is closed; a longer document makes a longer file.
FILE_IDS = 1 << 23
#: Distinct pieces a Python worker remembers.
REMEMBERED = 600_000
#: Pieces that the library encodes as one text.
JOINED = 2_000

_DOUBLE = re.compile(r"\s\s")
_PLAIN = re.compile(r"\n?\S(.*\S)?\Z", re.DOTALL)
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
#: Files are numbered in order: the task that wrote it, then its place there.
FILE_SCHEMA = "file_no bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, body binary"
TASK_FILES = 1 << 32


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def _whole(later: str) -> str:
    return later if later.startswith("\n") else " " + later


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> PieceEncoder:
    """The encoder of a Python worker, so that its tasks share the pieces they have seen."""
    return PieceEncoder(path)


class PieceEncoder:
    """Encodes texts with the tokenizers library, each distinct piece once.

    A space or line break between two characters that are no white space always begins a
    new token of a byte-level BPE, so a text may be cut there. Later pieces lose the space
    they begin with but keep the line break.
    """

    def __init__(self, path: str):
        self.library = _tokenizer(path)
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        # A byte-level token has a character for each byte.
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, number in vocabulary.items():
            self.n_bytes[number] = len(token)

    def _alone(self, known: dict[str, bytes], pieces: list[str], later: bool) -> None:
        for i in range(0, len(pieces), 20_000):
            part = pieces[i : i + 20_000]
            found = self.library.encode_batch_fast(
                [_whole(p) if later else p for p in part], add_special_tokens=False
            )
            known.update(
                (p, np.array(e.ids, dtype="<u4").tobytes()) for p, e in zip(part, found, strict=True)
            )

    def _learn(self, pieces: set[str]) -> None:
        """Encodes later pieces, many as one text where each begins at a cut."""
        fresh = list(pieces.difference(self.later))
        plain = [_PLAIN.match(p) is not None for p in fresh]
        self._alone(self.later, [p for p, ok in zip(fresh, plain, strict=True) if not ok], True)
        fresh = [p for p, ok in zip(fresh, plain, strict=True) if ok]
        for i in range(0, len(fresh), JOINED):
            part = fresh[i : i + JOINED]
            wholes = [_whole(p) for p in part]
            found = self.library.encode_batch_fast(["".join(wholes)], add_special_tokens=False)
            ids = np.array(found[0].ids, dtype="<u4")
            ends = np.cumsum([len(p.encode()) for p in wholes])
            token_ends = np.cumsum(self.n_bytes[ids])
            cuts = np.searchsorted(token_ends, ends)
            if not np.array_equal(token_ends[cuts], ends):
                raise ValueError("a token of this tokenizer spans the cut between two words")
            raw, stops = ids.tobytes(), ((cuts + 1) * 4).tolist()
            self.later.update(
                (p, raw[low:high]) for p, low, high in zip(part, [0, *stops], stops, strict=False)
            )

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian u32."""
        if len(self.later) > REMEMBERED:
            self.later.clear()
        self.first.clear()
        cut = [
            _BOUNDARY.split(t) if _DOUBLE.search(t) else t.replace("\n", " \n").split(" ")
            for t in texts
        ]
        self._alone(self.first, list({pieces[0] for pieces in cut}), False)
        self._learn(set().union(*(pieces[1:] for pieces in cut)))
        later = self.later.__getitem__
        return [self.first[p[0]] + b"".join(map(later, p[1:])) for p in cut]


def write_files(docs: DataFrame, tokenizer: str, path: str, file_ids: int = FILE_IDS) -> None:
    """Encodes every text (null: empty), ends it with END_ID, and writes the files.

    Documents are dealt to tasks by ranges of doc_id and sorted within; rows without
    doc_id come first, rows of one doc_id in the order of their texts' hash.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = worker_encoder(tokenizer), np.array([END_ID], dtype="<u4").tobytes()
        doc_ids, parts, total = [], [], 0
        # Tasks hold ascending ranges of doc_id.
        number_of = itertools.count(TaskContext.get().partitionId() * TASK_FILES)

        def file() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            return pd.DataFrame(
                {
                    "file_no": [next(number_of)],
                    "n_ids": [len(ids)],
                    "doc_ids": [list(doc_ids)],
                    "lengths": [[len(p) // 4 for p in parts]],
                    "body": [encode(ids)],
                }
            )

        for batch in batches:
            numbers = [None if pd.isna(x) else int(x) for x in batch["doc_id"].astype("Int64")]
            for number, ids in zip(numbers, encoder.encode(list(batch["text"])), strict=True):
                doc_ids.append(number)
                parts.append(ids + end)
                total += len(parts[-1]) // 4
                if total >= file_ids:
                    yield file()
                    doc_ids, parts, total = [], [], 0
        if parts:
            yield file()

    rows = docs.select("doc_id", text_of().alias("text"))
    ordered = (
        rows.repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    ordered.mapInPandas(run, FILE_SCHEMA).write.parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def decode_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids array<int> of every document, decoded from its file."""
    return _decoded(files, lambda ids: ids.astype(np.int32), "ids", "array<int>")


def document_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from its file."""
    return _decoded(files, lambda ids: zlib.crc32(ids.tobytes()), "ids_crc32", "bigint")


def _decoded(files: DataFrame, value, name: str, kind: str) -> DataFrame:
    # One row per file; what earlier files hold is a running sum over these.
    order = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("file_no", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))
    placed = files.join(before, "file_no").select("before", "doc_ids", "lengths", "body")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for before, doc_ids, lengths, body in batch.itertuples(index=False):
                ids, ends = decode(body), np.cumsum(lengths)
                starts = ends - lengths
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(
                            [None if pd.isna(x) else int(x) for x in doc_ids], dtype="Int64"
                        ),
                        "start": before + starts,
                        "n_tokens": lengths,
                        name: [value(ids[a:b]) for a, b in zip(starts, ends, strict=True)],
                    }
                )

    return placed.mapInPandas(run, f"doc_id bigint, start bigint, n_tokens bigint, {name} {kind}")
