"""BPE encoding and decoding by batched merge rounds in numpy.

The symbols of many words lie in one flat array. A round looks up every adjacent
pair of a word in the sorted pair keys by binary search, picks each word's pair
of lowest rank and merges all its occurrences, leftmost first; words without a
known pair drop out. Long words take rounds of their own, one for every rank that
occurs, lowest first: ranks are kept, and only pairs next to a merge are looked up
again, so the time grows with the word and not with its square. Texts are cut at
ASCII white space, which no token crosses; each distinct piece a task remembers is
split and merged once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from latewin.llm.tables import text_of

#: Bytes of distinct pieces and their ids that a task remembers; emptied when full.
REMEMBERED_BYTES = 48 << 20
#: What a remembered piece costs beside its characters and ids.
PIECE_BYTES = 200
#: Code points encoded at once; longer texts are cut at white space.
SLICE = 1 << 19
#: Symbols from which a word takes the rounds for long words.
LONG_WORD = 256
# str.split also cuts at these four, which are not white space to the tokenizer.
_SEPARATORS = re.compile(r"[\x1C-\x1F]")
_CUT = re.compile(r"[\x20\x09-\x0D]+")


def stretches(text: str, size: int) -> Iterator[str]:
    """The text in parts of about ``size`` code points that end before white space."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def cut_at_space(text: str) -> list[str]:
    if _SEPARATORS.search(text):
        return [p for p in _CUT.split(text) if p]
    return text.split()


class WordBpe:
    """A byte-level BPE with word ends, read from a tokenizers file.

    The file's own normaliser and pre-tokeniser split a piece into words; merging,
    ids and decoding are done here.
    """

    def __init__(self, path: str):
        self.path = path
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, self.end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, number in [*vocab.items(), *self.special.items()]:
            self.tokens[number] = token
        self.vocab = vocab
        self.find_special = (
            re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)))
            if self.special
            else None
        )
        size = len(self.tokens)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], dtype=np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.size, self.keys = size, keys[order]
        self.rank, self.product = order.astype(np.int64), merged
        # Ids of the characters of the byte alphabet, inside a word and at its end.
        self.inner = np.zeros(512, dtype=np.int64)
        self.final = np.zeros(512, dtype=np.int64)
        for token, number in vocab.items():
            if len(token) == 1:
                self.inner[ord(token)] = number
                self.final[ord(token)] = vocab[token + self.end]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, end of each word in them).

        Words are given in the characters of the byte alphabet.
        """
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        symbols = self.inner[points]
        last = np.cumsum(lengths)[lengths > 0] - 1
        symbols[last] = self.final[points[last]]
        owner = np.repeat(np.arange(len(words)), lengths)
        long = np.repeat(lengths >= LONG_WORD, lengths)
        parts = [self._short(symbols[~long], owner[~long])]
        if long.any():
            parts.append(self._long(symbols[long], owner[long]))
        symbols = np.concatenate([p[0] for p in parts])
        owner = np.concatenate([p[1] for p in parts])
        ends = np.cumsum(np.bincount(owner, minlength=len(words)))
        return symbols[np.argsort(owner, kind="stable")], ends

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair of symbols; the number of merges where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.keys))

    def _short(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, owner) after all merges, word by word lowest rank first."""
        done_symbols, done_owner = [symbols[:0]], [owner[:0]]
        none = np.int64(len(self.keys))
        while len(symbols):
            rank = np.full(len(symbols), none)
            rank[:-1] = np.where(
                owner[:-1] == owner[1:], self._ranks(symbols[:-1], symbols[1:]), none
            )
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            span = np.diff(np.r_[first, len(owner)])
            lowest = np.minimum.reduceat(rank, first)
            live = np.repeat(lowest < none, span)
            if not live.all():
                done_symbols.append(symbols[~live])
                done_owner.append(owner[~live])
            hit = live & (rank == np.repeat(lowest, span))
            # In a run of overlapping pairs (a a a) every second one merges.
            where = np.flatnonzero(hit)
            if len(where):
                run = np.r_[True, np.diff(where) != 1]
                begin = where[np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))]
                where = where[(where - begin) % 2 == 0]
                symbols[where] = self.product[rank[where]]
                live[where + 1] = False
            symbols, owner = symbols[live], owner[live]
        return np.concatenate(done_symbols), np.concatenate(done_owner)

    def _long(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for long words, whose symbols are linked to their neighbours.

        A round merges one rank in all words. It is the lowest of all words, so of each word
        that has it too.
        """
        n, none = len(symbols), len(self.keys)
        same = owner[:-1] == owner[1:]
        after = np.r_[np.where(same, np.arange(1, n), -1), -1]
        before = np.r_[-1, np.where(same, np.arange(n - 1), -1)]
        rank = np.full(n, none)
        rank[:-1] = np.where(same, self._ranks(symbols[:-1], symbols[1:]), none)
        alive = np.ones(n, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}

        def file(at: np.ndarray) -> list[int]:
            """Puts places with a pair under its rank; ranks that were not there before."""
            at = at[rank[at] < none]
            at = at[np.argsort(rank[at], kind="stable")]
            ranks, starts = np.unique(rank[at], return_index=True)
            fresh = []
            for r, part in zip(ranks.tolist(), np.split(at, starts[1:]), strict=bool(len(at))):
                if r not in waiting:
                    waiting[r] = []
                    fresh.append(r)
                waiting[r].append(part)
            return fresh

        todo = file(np.arange(n))
        heapify(todo)
        while todo:
            now = heappop(todo)
            parts = waiting.pop(now)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[rank[at] == now]
            if not len(at):
                continue
            run = np.r_[True, after[at[:-1]] != at[1:]]
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            symbols[at] = self.product[now]
            alive[gone], rank[gone] = False, none
            after[at] = beyond
            linked = beyond >= 0
            before[beyond[linked]] = at[linked]
            left = before[at]
            changed = np.unique(np.concatenate([at, left[left >= 0]]))
            follows = after[changed]
            rank[changed] = np.where(
                follows >= 0, self._ranks(symbols[changed], symbols[follows]), none
            )
            for r in file(changed):
                heappush(todo, r)
        return symbols[alive], owner[alive]

    def _split(self, text: str) -> list[str]:
        normal = self.library.normalizer.normalize_str(text)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, list[int]]:
        """(ids of all pieces in a row, end of each piece in them).

        Strings of special tokens become their ids. All pieces are split in one
        call; those that hold a special token or white space of their own, which
        would shift the pieces after them, are split alone.
        """
        if not pieces:
            return np.zeros(0, dtype=np.int64), []
        joined = " ".join(pieces)
        special = self.find_special is not None and self.find_special.search(joined)
        normal = self.library.normalizer.normalize_str(joined)
        parts = normal.split(" ")
        if special or len(parts) != len(pieces):
            return self._pieces_alone(pieces)
        found = self.library.pre_tokenizer.pre_tokenize_str(normal)
        starts = np.fromiter((at for _, (at, _) in found), dtype=np.int64, count=len(found))
        part_ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
        words_before = np.searchsorted(starts, part_ends)
        ids, word_ends = self.merge([w for w, _ in found])
        return ids, np.r_[0, word_ends][words_before].tolist()

    def _pieces_alone(self, pieces: list[str]) -> tuple[np.ndarray, list[int]]:
        # None stands for a special token, whose id is put in after merging.
        words, given, ends = [], [], []
        for piece in pieces:
            at = 0
            for m in self.find_special.finditer(piece) if self.find_special else ():
                words += [*self._split(piece[at : m.start()]), None]
                given.append(self.special[m.group()])
                at = m.end()
            words += self._split(piece[at:])
            ends.append(len(words))
        ids, word_ends = self.merge([w or "" for w in words])
        ids, low, out, numbers, before = ids.tolist(), 0, [], iter(given), [0]
        for word, high in zip(words, word_ends.tolist(), strict=True):
            out.extend(ids[low:high] if word is not None else [next(numbers)])
            before.append(len(out))
            low = high
        return np.array(out, dtype=np.int64), [before[e] for e in ends]

    def encode(self, texts: list[str]) -> list[list[int]]:
        memory = PieceMemory(self)
        return [memory.ids(t).tolist() for t in texts]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space: the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids)


class PieceMemory:
    """Ids of pieces already met, as bytes, up to REMEMBERED_BYTES.

    It is checked after every slice of a text and emptied when full, so what it holds does not
    depend on the texts; an emptied memory costs time, never rows.
    """

    def __init__(self, bpe: WordBpe):
        self.bpe, self.known, self.held = bpe, {}, 0

    def learn(self, pieces: set[str]) -> None:
        fresh = list(pieces.difference(self.known))
        ids, ends = self.bpe.pieces(fresh)
        raw, low = ids.astype(np.int32).tobytes(), 0
        for piece, end in zip(fresh, ends, strict=True):
            self.known[piece] = raw[low : 4 * end]
            low = 4 * end
        self.held += len(raw) + sum(map(len, fresh)) + PIECE_BYTES * len(fresh)

    def trim(self) -> None:
        if self.held > REMEMBERED_BYTES:
            self.known, self.held = {}, 0

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text; no more than a slice is cut into pieces at once."""
        found = []
        for part in stretches(text, SLICE):
            pieces = cut_at_space(part)
            self.learn(set(pieces))
            found.append(b"".join(map(self.known.__getitem__, pieces)))
            self.trim()
        return np.frombuffer(b"".join(found), dtype=np.int32)

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of every text; short texts learn their pieces together."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
                size += len(texts[end])
                end += 1
            if end == at + 1:
                yield self.ids(texts[at])
            else:
                cut = [cut_at_space(t) for t in texts[at:end]]
                self.learn(set().union(*cut))
                for pieces in cut:
                    raw = b"".join(map(self.known.__getitem__, pieces))
                    yield np.frombuffer(raw, dtype=np.int32)
                self.trim()
            at = end


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _encoded(path: str, batches: Iterator[pa.RecordBatch], digests: bool):
    bpe = word_bpe(path)
    memory = PieceMemory(bpe)
    written = [str(i) for i in range(len(bpe.tokens))]
    for batch in batches:
        n_tokens, first, second = [], [], []
        for ids in memory.texts(batch.column(1).to_pylist()):
            listed = ids.tolist()
            decoded = " ".join(map(bpe.tokens.__getitem__, listed))
            n_tokens.append(len(listed))
            if digests:
                numbers = " ".join(map(written.__getitem__, listed))
                first.append(hashlib.sha256(numbers.encode()).hexdigest())
                second.append(hashlib.sha256(decoded.encode()).hexdigest())
            else:
                first.append(ids)
                second.append(decoded)
        if not digests:
            flat = np.concatenate(first) if first else np.zeros(0, dtype=np.int32)
            offsets = np.cumsum([0, *n_tokens]).astype(np.int32)
            first = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n_tokens, pa.int64()),
                first if not digests else pa.array(first, pa.string()),
                pa.array(second, pa.string()),
            ],
            ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))],
        )


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids array<int>, decoded of every row; null text as empty."""
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        lambda it: _encoded(path, it, False),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long,"
        " ids array<int>, decoded string",
    )


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    Null and empty texts have no tokens and the digests of the empty string. Rows
    are treated one by one, so repeated rows repeat their result.
    """
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        lambda it: _encoded(path, it, True),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long,"
        " ids_sha256 string, decoded_sha256 string",
    )
