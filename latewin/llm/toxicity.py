"""A toxicity classifier regularised by counterfactuals.

A logistic regression over the words of a text and their first letters. In labelled
texts that mention a group, the identity term is swapped for another one, and the
squared change of the linear score is part of the loss, so a neutral mention of a
group does not move the score.

Fitted on a bounded sample of labelled rows (``sample_rows`` of each class, by hash);
scores come from the text alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latewin.llm.tables import id_remainder, text_of
from latewin.session import stage

SAMPLE_ROWS = 4000
FEATURES = 4000
LEAST_Z = 3.5
PREFIXES = (4, 5, 6)
L2 = 1e-3
SWAP_PENALTY = 10.0
REJECT = 0.7
#: Words whose features a task remembers.
REMEMBERED = 300_000

# Fixed value: neutral names of groups, exchangeable within a row.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "american"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "elderly", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "deutsche"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "français"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "españoles"),
)
_GROUP = {w: row for row in IDENTITY for w in row}
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [f"={word}", *[word[:n] for n in PREFIXES if len(word) >= n]]


def text_features(words: set[str]) -> set[str]:
    return {f for w in words for f in features_of(w)}


def swapped(words: set[str]) -> list[set[str]]:
    """The words with one identity term replaced, once for every other term of its row."""
    return [
        (words - {w}) | {other}
        for w in sorted(words & _GROUP.keys())
        for other in _GROUP[w]
        if other not in words
    ]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, texts: pd.Series, memory: dict[str, tuple[str, ...]]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            found: set[str] = set()
            for word in set(words_of(text)):
                hits = memory.get(word)
                if hits is None:
                    hits = tuple(f for f in features_of(word) if f in self.weights)
                    memory[word] = hits
                found.update(hits)
            out[i] = self.bias + sum(self.weights[f] for f in sorted(found))
        if len(memory) > REMEMBERED:
            memory.clear()
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, toxic, text: at most ``rows`` labelled documents of each class, by hash.

    Only ids whose remainder modulo 3 is not 1. Of several labels of a document the highest
    counts; null labels do not. The drawn ids are broadcast, at most 2 * ``rows``.
    """
    usable = (
        labels.where("doc_id is not null and toxic is not null")
        .where(id_remainder(3) != 1)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    hashed = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h"))
    drawn = [hashed.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(rows) for y in (0, 1)]
    ids = drawn[0].union(drawn[1]).select("doc_id", "toxic")
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), "doc_id")


def _sample_features(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
                words = set(words_of(text))
                own = text_features(words)
                swaps = [text_features(s) for s in swapped(words)]
                rows.append(
                    (
                        int(toxic),
                        sorted(own),
                        [sorted(own - s) for s in swaps],
                        [sorted(s - own) for s in swaps],
                    )
                )
            yield pd.DataFrame(rows, columns=["toxic", "features", "lost", "gained"])

    return sample.select("toxic", "text").mapInPandas(
        run,
        "toxic int, features array<string>, lost array<array<string>>, gained array<array<string>>",
    )


def select_features(features: DataFrame, most: int = FEATURES, least_z: float = LEAST_Z) -> list[str]:
    """Features whose share differs between the classes, the clearest ``most`` of them."""
    sizes = {r["toxic"]: r["count"] for r in features.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return []
    counts = (
        features.select("toxic", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
        .where("a + b >= 5")
    )
    share = (F.col("a") + F.col("b")) / float(n1 + n0)
    spread = F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    z = (F.col("a") / float(n1) - F.col("b") / float(n0)) / spread
    best = counts.withColumn("z", F.abs(z)).where(F.col("z") >= least_z)
    return [r["feature"] for r in best.orderBy(F.desc("z"), "feature").limit(most).collect()]


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = [len(r) for r in rows]
    return np.repeat(np.arange(len(rows)), lengths), np.array([i for r in rows for i in r], dtype=np.int64)


def fit_weights(
    y: np.ndarray,
    rows: list[list[int]],
    swaps: list[tuple[list[int], list[int]]],
    n_features: int,
    l2: float = L2,
    swap_penalty: float = SWAP_PENALTY,
    steps: int = 300,
) -> tuple[np.ndarray, float]:
    """Weights and bias of least loss, by Adam over the whole sample.

    Loss: mean log-loss + l2 * |w|^2 + swap_penalty * mean squared score change over
    the swaps, each given as (features lost, features gained).
    """
    at, feature = _flat(rows)
    swap_at, swap_feature = _flat([[*lost, *gained] for lost, gained in swaps])
    sign = np.array([s for lost, gained in swaps for s in [-1.0] * len(lost) + [1.0] * len(gained)])
    w, b = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        linear = b + np.bincount(at, weights=w[feature], minlength=len(y))
        error = (1 / (1 + np.exp(-np.clip(linear, -50, 50))) - y) / max(len(y), 1)
        grad = np.bincount(feature, weights=error[at], minlength=n_features) + 2 * l2 * w
        if len(swaps):
            change = np.bincount(swap_at, weights=sign * w[swap_feature], minlength=len(swaps))
            pull = 2 * swap_penalty / len(swaps) * change
            grad += np.bincount(swap_feature, weights=sign * pull[swap_at], minlength=n_features)
        g = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, swap_penalty: float = SWAP_PENALTY) -> Model:
    """The model; without labels of both classes it scores every text near 0."""
    features = stage(_sample_features(training_sample(docs, labels, rows)), "toxicity")
    chosen = select_features(features)
    if not chosen:
        return Model({}, -4.0)
    number = {f: i for i, f in enumerate(chosen)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lambda fs: [number[f] for f in fs if f in number]
        for batch in batches:
            yield pd.DataFrame(
                {
                    "toxic": batch["toxic"],
                    "f": [known(x) for x in batch["features"]],
                    "lost": [[known(x) for x in xs] for xs in batch["lost"]],
                    "gained": [[known(x) for x in xs] for xs in batch["gained"]],
                }
            )

    # At most 2 * rows rows of numbers below FEATURES.
    sample = features.mapInPandas(
        run, "toxic int, f array<int>, lost array<array<int>>, gained array<array<int>>"
    ).collect()
    sample.sort(key=lambda r: (r["toxic"], r["f"]))
    swaps = [
        (lost, gained)
        for r in sample
        for lost, gained in zip(r["lost"], r["gained"], strict=True)
        if lost or gained
    ]
    y = np.array([r["toxic"] for r in sample], dtype=float)
    w, b = fit_weights(y, [r["f"] for r in sample], swaps, len(chosen), swap_penalty=swap_penalty)
    return Model({f: float(x) for f, x in zip(chosen, w, strict=True)}, b)


def score_documents(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score (0 to 1) of every row; null and empty texts get the bias alone.

    Rows are scored one by one, so repeated rows repeat their score.
    """
    kept = docs.select(*keep, text_of().alias("_text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            yield batch.drop(columns="_text").assign(score=model.score(batch["_text"], memory))

    return kept.mapInPandas(run, f"{schema}, score double")


def clean_documents(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The documents scored below ``reject``, with all their columns."""
    whole = docs.select(
        F.col("text") if "text" in docs.columns else F.lit("").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        memory: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            texts = pd.Series(pc.fill_null(batch.column("text"), "").to_pylist(), dtype=object)
            good = model.score(texts, memory) < reject
            rows = pa.RecordBatch.from_arrays([batch.column("_row")], names=["_row"])
            yield rows.filter(pa.array(good))

    schema = whole.select("_row").schema
    return whole.mapInArrow(run, schema).select("_row.*")
