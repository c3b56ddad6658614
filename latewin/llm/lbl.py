"""Scoring by a log-bilinear language model.

The two words before a token predict a vector, q = C1 r(w-1) + C2 r(w-2). Words are cut by
frequency into classes; a class scores q . s(class) + its bias, and a word inside its class
q . r(w) + b(w). A softmax over all classes times one over the words of the class makes the
probability. The vocabulary is made of the most frequent training words seen MIN_COUNT times, until
COVERAGE of all tokens and WIDE_WORDS words are reached, or all of them (at least the LEAST_WORDS
most frequent); of the end of a text; and of one class for all other words, inside which a word
has its add-one share. So the vectors grow with the corpus, but slower than its words.

Word counts cover all training texts. The vectors are trained in numpy by
noise-contrastive estimation on every training token: each partition runs over its
own texts from the same start, and Spark averages each word's results by how often a
partition met it. Normalisers are computed for the contexts that occur, by matrix products
over batches of tokens: all classes for each token, and a class's words for its tokens.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewin.llm.tables import text_of
from latewin.session import stage

#: Words seen so often in training have vectors, and in a small corpus so many words have.
MIN_COUNT = 5
LEAST_WORDS = 1021
#: Beyond so many words, only those that cover this share of the training tokens have vectors.
WIDE_WORDS = 1 << 16
COVERAGE = 0.9
DIM = 16
NOISE = 48
NOISE_CLASSES = 24
BATCH = 1024
RATE = 0.3
#: Most words, apart from the vocabulary, whose counts travel to every task; the others are joined.
CARRIED = 1 << 17
#: Longer words are known by their beginning and a digest.
WORD_BYTES = 64
#: Words whose trained numbers travel in one row, and tokens that are scored together.
CHUNK = 256
SLICE = 1 << 16
#: Scores of tokens that are held at once, and the largest that needs no scaling.
SCORES = 1 << 16
PLAIN = 70.0
#: Distinct words a task counts before it hands them on.
COUNTED = 400_000
# Numbers of the vocabulary before the words.
END, OTHER, BEGIN = 0, 1, 2
_FIRST = 3


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text, modulo 7, is 2; a missing id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 7 == 2


def tokens(text: str) -> list[bytes]:
    """Words in bytes, A-Z lower-cased; bytes.split cuts at exactly the six blanks."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if max(map(len, words), default=0) > WORD_BYTES:
        return [w if len(w) <= WORD_BYTES else _short(w) for w in words]
    return words


def _short(word: bytes) -> bytes:
    """WORD_BYTES + 1 bytes, as no other word has."""
    return word[:32] + hashlib.blake2b(word, digest_size=WORD_BYTES - 31).digest()


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary), c; the end of a text is the empty word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()

        def out():
            return pd.DataFrame({"word": list(seen.keys()), "c": list(seen.values())})

        for batch in batches:
            for text in batch["text"]:
                seen.update(tokens(text))
            seen[b""] += len(batch)
            if len(seen) > COUNTED:
                yield out()
                seen.clear()
        if seen:
            yield out()

    parts = texts.select("text").mapInPandas(run, "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Counts:
    table: DataFrame
    tokens: int
    distinct: int
    ends: int  # training texts, each of which ends once; known whatever is carried
    carried: dict[bytes, int]  # without the end
    least: int  # words counted this often are carried
    modelled: int  # words counted this often are in the vocabulary


def _collected(words: DataFrame) -> dict[bytes, int]:
    found = words.select("word", "c").toArrow()
    return dict(zip(found["word"].to_pylist(), found["c"].to_pylist(), strict=True))


def gather_counts(
    texts: DataFrame, most: int = CARRIED, *, wide: int = WIDE_WORDS, coverage: float = COVERAGE
) -> Counts:
    """Counts of all training texts, the words of the vocabulary and others up to ``most``."""
    table = stage(word_counts(texts), "words")
    is_end = F.octet_length("word") == 0
    n, v, ends = table.agg(
        F.sum("c"), F.count(F.lit(1)), F.sum(F.when(is_end, F.col("c")))
    ).first()
    words = table.where(~is_end)
    # Words by octave eighths of their count: a table of a few hundred rows at most.
    eighth = F.floor(F.log2("c") * 8)
    steps = words.groupBy(eighth.alias("e")).agg(
        F.count(F.lit(1)).alias("n"), F.min("c").alias("c"), F.sum("c").alias("tokens")
    )
    found, covered, others = 0, ends or 0, 0
    modelled = least = None
    for row in sorted(steps.collect(), key=lambda r: -r["e"]):
        enough = found >= wide and covered >= coverage * n
        if row["c"] >= MIN_COUNT and not enough:
            found, covered, modelled = found + row["n"], covered + row["tokens"], row["c"]
            continue
        others += row["n"]
        if others > most:
            break
        least = row["c"]
    modelled = modelled or MIN_COUNT
    least = least or modelled
    return Counts(table, n or 0, v or 0, ends or 0, _collected(words.where(F.col("c") >= least)), least, modelled)


def model_words(counts: Counts, fewest: int = LEAST_WORDS) -> dict[bytes, int]:
    """The vocabulary with its counts, by falling count."""
    found = {w: c for w, c in counts.carried.items() if c >= counts.modelled}
    if len(found) < fewest:
        words = counts.table.where(F.octet_length("word") > 0)
        found = _collected(words.orderBy(F.desc("c"), "word").limit(fewest))
    return dict(sorted(found.items(), key=lambda x: (-x[1], x[0])))


def class_starts(counts: np.ndarray) -> np.ndarray:
    """Where classes of words begin, and their end, for counts by falling frequency.

    Classes share the sum of square roots of counts evenly, so frequent words are in small
    ones. The number of classes is that with the least work for a mean token.
    """
    if not len(counts):
        return np.zeros(1, dtype=np.int64)
    mass = np.cumsum(np.sqrt(counts))
    best = None
    for k in range(12):
        at = np.searchsorted(mass, mass[-1] * np.arange(1, 1 << k) / (1 << k))
        starts = np.unique(np.r_[0, at, len(counts)])
        sizes = np.diff(starts)
        work = len(sizes) + (np.add.reduceat(counts, starts[:-1]) * sizes).sum() / counts.sum()
        if best is None or work < best[0]:
            best = work, starts
    return best[1].astype(np.int64)


@dataclass(frozen=True)
class Shape:
    """Numbers of a model in one array: words, contexts, word biases; then classes."""

    size: int
    dim: int = DIM
    classes: int = 0

    @property
    def numbers(self) -> int:
        k, d = self.size, self.dim
        return k * d + 2 * d * d + k + self.classes * (d + 1)

    def split(self, flat: np.ndarray):
        k, d = self.size, self.dim
        r, c, b = np.split(flat[: k * d + 2 * d * d + k], [k * d, k * d + 2 * d * d])
        return r.reshape(k, d), c.reshape(2, d, d), b

    def heads(self, flat: np.ndarray):
        s, bias = np.split(flat[len(flat) - self.classes * (self.dim + 1) :], [self.classes * self.dim])
        return s.reshape(self.classes, self.dim), bias


def start_numbers(shape: Shape, share: np.ndarray, class_share: np.ndarray, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    flat = np.zeros(shape.numbers, dtype=np.float32)
    r, c, b = shape.split(flat)
    s, bias = shape.heads(flat)
    r[:] = rng.normal(0, 0.1, r.shape)
    s[:] = rng.normal(0, 0.1, s.shape)
    c[:] = np.eye(shape.dim) * 0.5
    b[:] = np.log(share)
    bias[:] = np.log(class_share)
    return flat


def _numbers(words: list[bytes], number: dict[bytes, int]) -> np.ndarray:
    """Words outside the vocabulary are OTHER."""
    out = np.empty(len(words) + 3, dtype=np.int64)
    out[:2] = BEGIN
    out[2:-1] = np.fromiter(map(number.get, words, itertools.repeat(OTHER)), np.int64, len(words))
    out[-1] = END
    return out


def _grouped(index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct indices, stable order by index, where each distinct index begins in it)."""
    bits = len(index).bit_length()
    ordered = np.sort((index.astype(np.int64) << bits) | np.arange(len(index)))
    order = ordered & ((1 << bits) - 1)
    ordered >>= bits
    new = np.empty(len(index), dtype=bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return ordered[first], order, first


def _sums(rows: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of each group that :func:`_grouped` gives."""
    out = rows.take(order.take(first), axis=0)
    times = np.diff(first, append=len(order))
    several = np.flatnonzero(times > 1)
    if len(several):
        lengths = times[several]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        here = np.arange(ends[-1]) + np.repeat(first[several] - starts, lengths)
        out[several] = np.add.reduceat(rows.take(order.take(here), axis=0), starts, axis=0)
    return out


def _summed(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices, and the sums of their rows."""
    at, order, first = _grouped(index)
    return at, _sums(rows, order, first)


class _Noise:
    """Draws by share, and the logarithm of their expected number."""

    def __init__(self, share: np.ndarray, draws: int):
        self.cumulated = np.cumsum(share)
        self.log = np.log(draws * share).astype(np.float32)
        self.draws = draws

    def draw(self, rng: np.random.Generator) -> np.ndarray:
        u = rng.random(self.draws) * self.cumulated[-1]
        return np.minimum(np.searchsorted(self.cumulated, u, side="right"), len(self.log) - 1)


def _contrast(q, mine, theirs, log_mine, log_theirs, rows):
    """Gradient of q of the log-likelihood of "the target is data, noise is noise".

    A last column holds the biases of ``mine`` and ``theirs``, and ones in q. The gradients of
    the targets' vectors and biases, then those of the noise, go into ``rows``.
    """
    n = len(q)
    good = np.einsum("ij,ij->i", q, mine) - log_mine
    up = (1 / (1 + np.exp(np.clip(good, -30, 30))))[:, None]
    noise = -theirs
    noise[:, -1] += log_theirs
    down = q @ noise.T
    np.clip(down, -30, 30, out=down)
    np.exp(down, out=down)
    down += 1
    np.divide(-1, down, out=down)
    np.multiply(up, q, out=rows[:n])
    np.matmul(down.T, q, out=rows[n : n + len(theirs)])
    dq = down @ theirs
    dq += up * mine
    return dq


class _Table:
    """Rows of numbers, a vector and its bias, each with its sum of squared gradients."""

    def __init__(self, vectors: np.ndarray, bias: np.ndarray):
        self.values = np.column_stack([vectors, bias])
        self.squares = np.full(self.values.shape, 1e-2, dtype=np.float32)

    def change(self, at: np.ndarray, grad: np.ndarray, values: np.ndarray | None = None) -> None:
        """``values`` are those ``at``, where they have been looked up."""
        squares = self.squares.take(at, axis=0)
        squares += grad * grad
        self.squares[at] = squares
        grad *= RATE
        grad /= np.sqrt(squares, out=squares)
        grad += self.values.take(at, axis=0) if values is None else values
        self.values[at] = grad


class Trainer:
    """Noise-contrastive estimation by AdaGrad over batches of (w-2, w-1, w).

    Only the numbers of words in a batch change, and each distinct word is read and written
    once. ``met`` counts the batch entries of each word, by which the partitions' results
    are averaged.
    """

    def __init__(self, shape: Shape, flat: np.ndarray, share, class_share, class_of, seed: int):
        self.shape = shape
        flat = flat.astype(np.float32)
        r, c, b = shape.split(flat)
        self.words, self.heads = _Table(r, b), _Table(*shape.heads(flat))
        # Rows have a column more, for the biases: contexts do without it.
        width = shape.dim + 1
        self.c = np.zeros((2, width, width), dtype=np.float32)
        self.c[:, :-1, :-1] = c
        self.c_squares = np.full(c.shape, 1e-2, dtype=np.float32)
        self.rng = np.random.default_rng(seed)
        self.noise = _Noise(share, NOISE)
        self.class_noise = _Noise(class_share, NOISE_CLASSES)
        self.class_of = class_of
        self.met = np.zeros(shape.size, dtype=np.float32)
        self.seen = 0
        # Kept from step to step.
        self.rows = np.empty((3 * BATCH + NOISE, width), dtype=np.float32)
        self.class_rows = np.empty((BATCH + NOISE_CLASSES, width), dtype=np.float32)

    @property
    def numbers(self) -> tuple[np.ndarray, ...]:
        """Word vectors with their biases, contexts, class vectors, class biases."""
        heads = self.heads.values
        return self.words.values, self.c[:, :-1, :-1], heads[:, :-1], heads[:, -1]

    def step(self, before2: np.ndarray, before1: np.ndarray, word: np.ndarray) -> None:
        n, c = len(word), self.c
        drawn, class_drawn = self.noise.draw(self.rng), self.class_noise.draw(self.rng)
        every = np.concatenate([word, drawn, before1, before2])
        at, order, first = _grouped(every)
        times = np.diff(first, append=len(every))
        found = self.words.values.take(at, axis=0)
        place = np.empty(len(every), dtype=np.int64)
        place[order] = np.repeat(np.arange(len(at)), times)
        mine, theirs, v1, v2 = np.split(found.take(place, axis=0), [n, n + NOISE, 2 * n + NOISE])
        q = v1 @ c[0]
        q += v2 @ c[1]
        q[:, -1] = 1
        rows = self.rows[: 3 * n + NOISE]
        dq = _contrast(q, mine, theirs, self.noise.log[word], self.noise.log[drawn], rows)

        classes = np.concatenate([self.class_of[word], class_drawn])
        heads, log = self.heads.values.take(classes, axis=0), self.class_noise.log[classes]
        class_rows = self.class_rows[: n + NOISE_CLASSES]
        dq += _contrast(q, heads[:n], heads[n:], log[:n], log[n:], class_rows)

        dc = np.stack([v1.T @ dq, v2.T @ dq])[:, :-1, :-1] / n
        np.matmul(dq, c[0].T, out=rows[n + NOISE : 2 * n + NOISE])
        np.matmul(dq, c[1].T, out=rows[2 * n + NOISE :])
        self.words.change(at, _sums(rows, order, first) / n, found)
        class_at, sums = _summed(classes, class_rows)
        self.heads.change(class_at, sums / n)
        self.c_squares += dc * dc
        c[:, :-1, :-1] += RATE * dc / np.sqrt(self.c_squares)
        self.met[at] += times
        self.seen += n


def _averaged(parts: DataFrame) -> DataFrame:
    """chunk, at, x: the mean of each row of numbers, by its weight."""

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        width = rows["width"].iloc[0]
        at = np.concatenate([np.frombuffer(x, dtype=np.int32) for x in rows["at"]])
        weight = np.concatenate([np.frombuffer(x, dtype=np.float32) for x in rows["weight"]])
        x = np.concatenate([np.frombuffer(x, dtype=np.float32) for x in rows["x"]]).reshape(-1, width)
        index, sums = _summed(at, np.c_[x * weight[:, None], weight].astype(np.float64))
        out = (sums[:, :-1] / sums[:, -1:]).astype(np.float32)
        return pd.DataFrame(
            {"chunk": [rows["chunk"].iloc[0]], "at": [index.astype(np.int32).tobytes()], "x": [out.tobytes()]}
        )

    return parts.groupBy("chunk").applyInPandas(mean, "chunk int, at binary, x binary")


@dataclass(frozen=True)
class Model:
    shape: Shape
    flat: np.ndarray
    words: list[bytes]
    starts: np.ndarray  # of the classes of words; END and OTHER are classes 0 and 1


def class_numbers(starts: np.ndarray) -> np.ndarray:
    """The class of every number; BEGIN, which is never a target, has OTHER's."""
    return np.r_[0, 1, 1, np.repeat(np.arange(len(starts) - 1) + 2, np.diff(starts))]


def train(texts: DataFrame, words: dict[bytes, int], counts: Counts, passes: int = 1) -> Model:
    size = _FIRST + len(words)
    by_word = np.array(list(words.values()), dtype=float)
    starts = class_starts(by_word)
    class_of = class_numbers(starts)
    shape = Shape(size, classes=len(starts) + 1)
    raw = np.r_[counts.ends + 1, counts.tokens - by_word.sum() - counts.ends + 1, 1e-9, by_word]
    share = raw / raw.sum()
    class_share = np.bincount(class_of, weights=share, minlength=shape.classes)
    flat = start_numbers(shape, share, class_share)
    words_part = size * (shape.dim + 1)

    for _ in range(passes):
        begin = texts.sparkSession.sparkContext.broadcast(
            (flat, share, class_share, class_of, {w: i + _FIRST for i, w in enumerate(words)})
        )

        def run(batches: Iterator[pd.DataFrame], begin=begin) -> Iterator[pd.DataFrame]:
            flat0, share, class_share, class_of, lookup = begin.value
            trainer = Trainer(shape, flat0, share, class_share, class_of, seed=13)
            for batch in batches:
                rows = [_numbers(tokens(t), lookup) for t in batch["text"]]
                if not rows:
                    continue
                flat_rows = np.concatenate(rows)
                at = np.flatnonzero(flat_rows != BEGIN)
                # Examples in a fixed random order, so a batch mixes many texts.
                at = at[np.random.default_rng(len(at)).permutation(len(at))]
                for i in range(0, len(at), BATCH):
                    here = at[i : i + BATCH]
                    trainer.step(flat_rows[here - 2], flat_rows[here - 1], flat_rows[here])
            if not trainer.seen:
                return
            r, c, s, bias = trainer.numbers

            def row(chunk: int, at: np.ndarray, x: np.ndarray, weight: np.ndarray) -> tuple:
                parts = (at.astype(np.int32), x.astype(np.float32), weight.astype(np.float32))
                return (chunk, x.shape[1], *[p.tobytes() for p in parts])

            met = np.flatnonzero(trainer.met)
            out = []
            for at in np.split(met, np.searchsorted(met, np.arange(CHUNK, shape.size, CHUNK))):
                if len(at):
                    out.append(row(at[0] // CHUNK, at, r[at], trainer.met[at]))
            rest = np.r_[c.ravel(), s.ravel(), bias]
            for i in range(0, len(rest), CHUNK):
                x = rest[i : i + CHUNK, None]
                out.append(row(-1 - i // CHUNK, i + np.arange(len(x)), x, np.full(len(x), trainer.seen)))
            yield pd.DataFrame(out, columns=["chunk", "width", "at", "x", "weight"])

        parts = texts.select("text").mapInPandas(
            run, "chunk int, width int, at binary, x binary, weight binary"
        )
        flat = flat.copy()
        r, c, b = shape.split(flat)
        rest = np.r_[c.ravel(), flat[words_part + c.size :]]
        for found in _averaged(parts).toArrow().to_pylist():
            at = np.frombuffer(found["at"], dtype=np.int32)
            x = np.frombuffer(found["x"], dtype=np.float32)
            if found["chunk"] < 0:
                rest[at] = x
            else:
                x = x.reshape(-1, shape.dim + 1)
                r[at], b[at] = x[:, :-1], x[:, -1]
        c[:] = rest[: c.size].reshape(c.shape)
        flat[words_part + c.size :] = rest[c.size :]
    return Model(shape, flat, list(words), starts)


def log_sums(q: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """log of the softmax's sum over all ``vectors`` for every row of ``q``."""
    one = np.ones((len(q), 1), dtype=q.dtype)
    return _log_sums(np.hstack([q, one]), np.c_[vectors, bias])


def _log_sums(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The same for biases in the last column of ``vectors``, where ``q`` holds ones.

    Runs over blocks of rows whose scores stay in the processor's cache.
    """
    return _block_log_sums(q, vectors, _longest(q) * _longest(vectors) + _highest(vectors))


def _longest(rows: np.ndarray) -> float:
    """The largest length of a row without its last column."""
    short = rows[:, :-1]
    return math.sqrt(np.einsum("ij,ij->i", short, short).max(initial=0))


def _highest(rows: np.ndarray) -> float:
    """The largest number in the last column, whatever its sign."""
    return float(np.abs(rows[:, -1]).max(initial=0))


def _block_log_sums(q: np.ndarray, vectors: np.ndarray, most: float) -> np.ndarray:
    """No score is beyond ``most``; where its exponential is a plain number, the largest score
    needs no taking away."""
    out = np.empty(len(q), dtype=q.dtype)
    step = max(16, SCORES // max(1, len(vectors)))
    scores = np.empty((min(step, len(q)), len(vectors)), dtype=q.dtype)
    turned, ones = vectors.T, np.ones(len(vectors), dtype=q.dtype)
    for i in range(0, len(q), step):
        part = q[i : i + step]
        found = np.matmul(part, turned, out=scores[: len(part)])
        if most < PLAIN:
            np.exp(found, out=found)
            np.log(found @ ones, out=out[i : i + step])
        else:
            top = found.max(1)
            found -= top[:, None]
            np.exp(found, out=found)
            out[i : i + step] = top + np.log(found @ ones)
    return out


def normalisers(shape: Shape, flat: np.ndarray) -> np.ndarray:
    """The sums over one class of all words, for every (w-2, w-1), as a square table."""
    r, c, b = shape.split(flat.astype(np.float32))
    first, second = r @ c[0], r @ c[1]
    possible = np.arange(shape.size) != BEGIN
    return np.stack([log_sums(first + w2, r[possible], b[possible]) for w2 in second])


class Scorer:
    """The model's numbers as rows of a vector and its bias, laid out once for many tokens."""

    def __init__(self, model: Model, class_of: np.ndarray):
        r, c, b = model.shape.split(model.flat)
        self.words = np.column_stack([r, b])
        # What a word adds to q as w-1 and as w-2; the ones in q come with w-1.
        first, second = r @ c[0], r @ c[1]
        self.first = np.column_stack([first, np.ones_like(b)])
        self.second = np.column_stack([second, np.zeros_like(b)])
        self.heads = np.column_stack(model.shape.heads(model.flat))
        self.class_of = class_of
        self.cuts = _FIRST + model.starts
        # The longest vector of each class and its highest bias.
        parts = [self.words[a:z] for a, z in zip(self.cuts, self.cuts[1:], strict=False)]
        self.limits = [(_longest(x), _highest(x)) for x in parts]

    def log_probabilities(self, w2, w1, w) -> np.ndarray:
        """Natural logarithms of the model's probabilities of w after (w2, w1)."""
        k = self.class_of.take(w)
        # By class, so that the tokens of a class lie together.
        order = np.argsort(k.astype(np.int16) if len(self.heads) < 1 << 15 else k, kind="stable")
        w2, w1, w, k = (x.take(order) for x in (w2, w1, w, k))
        q = self.first.take(w1, axis=0)
        q += self.second.take(w2, axis=0)
        here = np.einsum("ij,ij->i", q, self.heads.take(k, axis=0)) - _log_sums(q, self.heads)
        # The first two classes are END and OTHER.
        cuts = np.searchsorted(k, np.arange(2, len(self.heads) + 1))
        low, longest = cuts[0], _longest(q)
        here[low:] += np.einsum("ij,ij->i", q[low:], self.words.take(w[low:], axis=0))
        for j in np.flatnonzero(np.diff(cuts)):
            length, high = self.limits[j]
            here[cuts[j] : cuts[j + 1]] -= _block_log_sums(
                q[cuts[j] : cuts[j + 1]],
                self.words[self.cuts[j] : self.cuts[j + 1]],
                longest * length + high,
            )
        out = np.empty_like(here)
        out[order] = here
        return out


def log_probabilities(model: Model, class_of: np.ndarray, w2, w1, w) -> np.ndarray:
    """Natural logarithms of the model's probabilities of w after (w2, w1)."""
    return Scorer(model, class_of).log_probabilities(w2, w1, w)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the rows that are not held out. Null text counts as empty and has one
    token, its end. Repeated rows count repeatedly in training and repeat their scores.
    Without training rows all words are unknown and the end takes all but the rest.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text"))
    training = rows.where("not held_out").select("text")
    counts = gather_counts(training)
    words = model_words(counts)
    model = train(training, words, counts)
    size = model.shape.size
    n, v = counts.tokens, counts.distinct
    modelled = sum(words.values()) + counts.ends
    end_known = int(counts.ends > 0)
    others = math.log10(n - modelled + max(v - len(words) - 1, 0) + 1)
    total = math.log10(n + v + 1)
    # log10(c + 1) of carried words, the vocabulary first; a word outside is looked up by the join.
    more_words = [w for w in counts.carried if w not in words]
    logs = np.log10(
        np.r_[counts.ends, 0, 0, list(words.values()), [counts.carried[w] for w in more_words]] + 1.0
    )
    shared = spark.sparkContext.broadcast((model, logs, more_words))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, logs, more_words = shared.value
        lookup = {w: i + _FIRST for i, w in enumerate(model.words + more_words)}
        scorer = Scorer(model, class_numbers(model.starts))

        def model_scores(texts: list[np.ndarray]) -> np.ndarray:
            """Sum of each text's natural logarithms."""
            ids = np.concatenate(texts)
            ids[ids >= size] = OTHER
            text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            at = np.flatnonzero(ids != BEGIN)
            sums = np.zeros(len(texts))
            for i in range(0, len(at), SLICE):
                here = at[i : i + SLICE]
                p = scorer.log_probabilities(ids[here - 2], ids[here - 1], ids[here])
                sums += np.bincount(text[here], weights=p, minlength=len(texts))
            return sums

        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            out, waiting, scores, held_back = [], [], [], 0
            for doc_id, held, text in zip(batch["doc_id"], batch["held_out"], batch["text"], strict=True):
                ws = tokens(text)
                ids = _numbers(ws, lookup)
                w = ids[2:]
                unknown = np.flatnonzero(w == OTHER)
                rest = Counter([ws[i] for i in unknown])
                other = (w >= size) | (w == OTHER)
                out.append(
                    (
                        row_id,
                        doc_id,
                        held,
                        len(w),
                        len(ws) - len(unknown) + end_known,
                        float(logs[w].sum()) - len(w) * total,
                        float(logs[w[other]].sum()) - int(other.sum()) * others,
                        list(rest.keys()),
                        list(rest.values()),
                    )
                )
                row_id += 1
                waiting.append(ids)
                held_back += len(ids)
                if held_back >= SLICE:
                    scores.append(model_scores(waiting))
                    waiting, held_back = [], 0
            if waiting:
                scores.append(model_scores(waiting))
            result = pd.DataFrame(out, columns=names)
            if scores:
                result["score"] += np.concatenate(scores) / math.log(10)
            yield result

    names = ["row_id", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest", "times"]
    scored = stage(
        rows.mapInPandas(
            run,
            f"row_id long, doc_id {kind}, held_out boolean, n_tokens long, n_known long,"
            " base_score double, score double, rest array<binary>, times array<long>",
        ),
        "scored",
    )
    rest = scored.select("row_id", F.explode(F.arrays_zip("rest", "times")).alias("t")).select(
        "row_id", F.col("t.rest").alias("word"), F.col("t.times").alias("times")
    )
    # Words of the vocabulary that are not carried otherwise are never in ``rest``.
    joined = counts.table.where(F.col("c") < counts.least)
    found = (
        rest.join(joined, "word")
        .groupBy("row_id")
        .agg(
            F.sum("times").alias("known"),
            F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("logs"),
        )
    )
    more = lambda c, d: F.col(c) + F.coalesce(F.col(d), F.lit(0))
    return scored.drop("rest", "times").join(found, "row_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        more("n_known", "known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        more("base_score", "logs").alias("base_score"),
        more("score", "logs").alias("score"),
    )
