"""Near duplicates from bottom-k sketches.

A text is the set of its distinct five-word shingles; its sketch is the ``K``
smallest hashes of that set. Texts with equal sets form a class, and only classes
go on.

Candidates. For two sets with similarity s, each of the k smallest values of the
union lies in both sketches with probability s. At s = 0.85 and k = 32 at least
``SHARED`` = 15 values are shared but for a chance of about 1e-7. So the values
of a sketch are ordered by how many classes retain them, rarest first, and only
the first k - 15 + 1 are indexed: two sketches that share 15 values share one of
those. Values retained by one class link nothing but take up places, which
keeps widely shared passages out of the index.

Hot values. A list of the index is never expanded into all its pairs. First each list
links its members to its head only, the member with the fewest values of its own.
Links confirmed so far give components. Texts in lists that still span several
components go on with their *full* sets: a value that no other of these texts has
cannot be shared, so the size of the rest bounds every similarity exactly. Members that
no member of a list can match are taken off it; heads are linked again; then pairs of
different components are examined, all of them but those that the bound excludes. So no
link between components is missed, and a large group of loose copies is not paired
with itself.

A candidate must have sizes within the threshold and an estimate, from the sketch
of the union, of at least 15 / k; what passes is confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewin.llm.arrays import mix, shingle_set, word_hashes
from latewin.llm.components import components
from latewin.llm.tables import text_of
from latewin.session import stage

K = 32
SHARED = 15
PERCENT = 85


def _sets(texts: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    for i, words in word_hashes([t.encode("utf-8", "surrogatepass") for t in texts]):
        yield i, shingle_set(words)


def _digest(values: np.ndarray) -> bytes:
    """128 bits over a set, from two independent sums of scrambled values."""
    a = mix(values).sum(dtype=np.uint64)
    b = mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest of the set, sketch; null text as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, digest, sketch = [0] * len(batch), [b""] * len(batch), [[]] * len(batch)
            for i, values in _sets(batch["text"]):
                n[i] = len(values)
                digest[i] = _digest(values) if len(values) else b""
                sketch[i] = values[:k].view(np.int64)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "text_hash": batch["text_hash"],
                    "n_shingles": n,
                    "digest": digest,
                    "sketch": sketch,
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(
        "doc_id", text_of().alias("text"), F.xxhash64(text_of()).alias("text_hash")
    ).mapInPandas(
        run,
        f"doc_id {kind}, text_hash long, n_shingles long, digest binary, sketch array<bigint>",
    )


def _index(values: DataFrame, retained: Column, needed: Column) -> DataFrame:
    """(value, place, node, n_shingles, alone) for the rarest retained values of a node.

    ``values`` has node, n_shingles and value. Two nodes that can be linked share at
    least ``needed`` of their ``retained`` values. ``alone`` counts the values no other
    node retains; they come first in the order but are left out of the lists. ``place``
    counts from 1.
    """
    spread = values.groupBy("value").agg(F.count(F.lit(1)).alias("spread")).where("spread > 1")
    seen = (
        values.join(spread, "value")
        .groupBy("node", "n_shingles")
        .agg(F.sort_array(F.collect_list(F.struct("spread", "value"))).alias("seen"))
        .withColumn("alone", retained - F.size("seen"))
    )
    room = F.greatest(retained - needed + 1 - F.col("alone"), F.lit(0)).cast("int")
    return seen.select(
        "node", "n_shingles", "alone", F.posexplode(F.slice("seen", F.lit(1), room)).alias("at", "s")
    ).select(
        F.col("s.value").alias("value"),
        (F.col("alone") + F.col("at") + 1).alias("place"),
        "node",
        "n_shingles",
        "alone",
    )


def _sketch_index(classes: DataFrame, k: int, shared: int, percent: int) -> DataFrame:
    values = classes.select("node", "n_shingles", F.explode("sketch").alias("value"))
    # A set within the sketch must share percent % of itself, a larger one `shared`.
    needed = F.least(F.ceil(F.col("n_shingles") * percent / 100), F.lit(shared))
    return _index(values, F.least("n_shingles", F.lit(k)), needed)


def _full_index(texts: DataFrame, percent: int) -> DataFrame:
    """The index over full sets of the given (node, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes = batch["node"].to_numpy()
            for i, values in _sets(batch["text"]):
                yield pd.DataFrame(
                    {"node": nodes[i], "n_shingles": len(values), "value": values.view(np.int64)}
                )

    values = texts.select("node", "text").mapInPandas(
        run, "node long, n_shingles long, value long"
    )
    n = F.col("n_shingles")
    return _index(values, n, F.ceil(n * percent / 100))


def _shared_estimate(k: int) -> Column:
    """Values of the union's sketch that both sketches retain."""
    union = F.slice(F.array_sort(F.array_union("sketch_u", "sketch_v")), 1, k)
    return F.size(F.array_intersect(F.array_intersect(union, "sketch_u"), "sketch_v"))


def _likely(
    pairs: DataFrame, classes: DataFrame, k: int, shared: int, percent: int
) -> DataFrame:
    """Pairs whose sizes and sketches leave a chance."""
    side = {
        s: classes.select(
            F.col("node").alias(s),
            F.col("n_shingles").alias(f"n_{s}"),
            F.col("sketch").alias(f"sketch_{s}"),
        )
        for s in "uv"
    }
    small, large = F.least("n_u", "n_v"), F.greatest("n_u", "n_v")
    # Below k the union's sketch is the whole union, and the sets decide.
    enough = F.when(small < k, F.lit(1)).otherwise(F.lit(shared))
    return (
        pairs.join(side["u"], "u")
        .join(side["v"], "v")
        .where(small * 100 >= large * percent)
        .where(_shared_estimate(k) >= enough)
        .select("u", "v")
    )


def _confirmed(likely: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of classes whose full sets reach the threshold."""
    wanted = likely.select(F.col("u").alias("node")).union(likely.select("v")).distinct()
    chosen = texts.join(wanted, "node", "left_semi")
    full = likely.join(chosen.withColumnsRenamed({"node": "u", "text": "text_u"}), "u").join(
        chosen.withColumnsRenamed({"node": "v", "text": "text_v"}), "v"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left, right = dict(_sets(batch["text_u"])), dict(_sets(batch["text_v"]))
            good = []
            for i in range(len(batch)):
                a, b = left[i], right[i]
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.loc[good, ["u", "v"]]

    return full.select("u", "v", "text_u", "text_v").mapInPandas(run, "u long, v long")


def _open_lists(index: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The lists that span several components, each member with its component's root."""
    if roots is None:
        return index.withColumn("root", F.col("node"))
    rooted = index.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = (
        rooted.groupBy("value")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low < high")
        .select("value")
    )
    return rooted.join(several, "value", "left_semi")


def _possible(lists: DataFrame, percent: int) -> DataFrame:
    """Members that the smallest set of their list leaves a chance.

    With c shareable values a set of size n reaches percent % against a set of size m only
    if (100 + percent) * c >= percent * (n + m).
    """
    least = lists.groupBy("value").agg(F.min("n_shingles").alias("least_n"))
    common = F.col("n_shingles") - F.col("alone")
    return (
        lists.join(least, "value")
        .where(common * (100 + percent) >= (F.col("n_shingles") + F.col("least_n")) * percent)
        .drop("least_n")
    )


def _star_pairs(lists: DataFrame) -> DataFrame:
    """Each list's head with the members outside its component."""
    heads = lists.groupBy("value").agg(
        F.min(F.struct("alone", "node", "root")).alias("head")
    ).select("value", F.col("head.node").alias("head"), F.col("head.root").alias("head_root"))
    return (
        lists.join(heads, "value")
        .where("root <> head_root")
        .select(F.least("head", "node").alias("u"), F.greatest("head", "node").alias("v"))
        .distinct()
    )


def _cross_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list in different components that their full sets leave a chance.

    One side is taken outside the list's largest component, so members already
    connected are not paired with each other.
    """
    parts = lists.groupBy("value", "root").agg(F.count(F.lit(1)).alias("n"))
    heads = (
        parts.groupBy("value")
        .agg(F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1")
        .select("value", F.col("top.root").alias("top"))
    )
    open_lists = lists.join(heads, "value").withColumn(
        "common", F.col("n_shingles") - F.col("alone")
    )
    carried = ("node", "root", "n_shingles", "common", "place")
    outside = open_lists.where("root <> top").select(
        "value", *[F.col(c).alias(f"{c}_a") for c in carried]
    )
    every = open_lists.select("value", *[F.col(c).alias(f"{c}_b") for c in carried])
    both = F.col("n_shingles_a") + F.col("n_shingles_b")
    shared = F.ceil(both * percent / (100 + percent))
    return (
        outside.join(every, "value")
        .where("root_a <> root_b")
        .where(F.least("common_a", "common_b") >= shared)
        # Two sets that share so many values share one among the first n - shared + 1 of both.
        .where(F.col("place_a") <= F.col("n_shingles_a") - shared + 1)
        .where(F.col("place_b") <= F.col("n_shingles_b") - shared + 1)
        .select(F.least("node_a", "node_b").alias("u"), F.greatest("node_a", "node_b").alias("v"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, k: int = K, shared: int = SHARED, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Rows are linked when 100 * |intersection| >= ``percent`` * |union| of their sets.
    component_id is the smallest doc_id reachable. Null, empty and white-space texts
    have an empty set and stand alone under their own doc_id. Rows of one doc_id
    and set are alike. A null doc_id is never a component_id unless all of its
    component are null. ``shared`` must fit ``k`` and ``percent`` (see the module text).
    """
    rows = stage(sketches(docs, k), "sketches")
    # Numbers given while the table is written hold for all that read it.
    classes = stage(
        rows.where("n_shingles > 0")
        .groupBy("digest")
        .agg(
            F.min(
                F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
            ).alias("least"),
            F.max("n_shingles").alias("n_shingles"),
            F.first("sketch").alias("sketch"),
        )
        .select(
            F.monotonically_increasing_id().alias("node"),
            "digest",
            F.col("least.doc_id").alias("least_id"),
            F.col("least.text_hash").alias("text_hash"),
            "n_shingles",
            "sketch",
        ),
        "classes",
    )
    index = stage(_sketch_index(classes, k, shared, percent), "index")
    # One text stands for a class: the one of its least doc_id.
    indexed = index.select("node").distinct()
    chosen = classes.join(indexed, "node", "left_semi").select(
        "node", F.col("least_id").alias("_least"), "text_hash"
    )
    own = docs.select("doc_id", text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    # Moved once; every later step reads these few texts.
    texts = stage(
        own.join(chosen, "text_hash")
        .where(F.col("doc_id").eqNullSafe(F.col("_least")))
        .select("node", "text")
        .dropDuplicates(["node"]),
        "texts",
    )

    def confirmed(pairs: DataFrame, estimate: bool = True) -> DataFrame:
        pairs = stage(pairs, "pairs")
        if estimate:
            pairs = stage(_likely(pairs, classes, k, shared, percent), "likely")
        return stage(_confirmed(pairs, texts, percent), "links")

    links = confirmed(_star_pairs(_open_lists(index, None)))
    roots = stage(components(links), "roots")
    still = _open_lists(index, roots).select("node").distinct()
    full = stage(_full_index(texts.join(still, "node", "left_semi"), percent), "full")
    lists = _possible(_open_lists(full, roots), percent)
    links = links.union(confirmed(_star_pairs(lists)))
    roots = stage(components(links), "roots")
    # What the bounds over full sets let pass is beyond the power of the sketches.
    lists = _possible(_open_lists(full, roots), percent)
    links = links.union(confirmed(_cross_pairs(lists, percent), estimate=False))
    roots = stage(components(links), "roots")
    groups = roots.join(classes.select(F.col("node"), "least_id"), "node")
    smallest = groups.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = (
        classes.select("node", "digest", "least_id")
        .join(groups.join(smallest, "root").select("node", "component_id"), "node", "left")
        .select("digest", F.coalesce("component_id", "least_id").alias("class_id"))
    )
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("class_id"))
    return (
        rows.drop("sketch")
        .join(named, "digest", "left")
        .select(
            "doc_id",
            "n_shingles",
            component.alias("component_id"),
            F.col("doc_id").eqNullSafe(component).alias("kept"),
        )
    )


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, one of each component, with all their columns.

    Documents are matched by doc_id, so rows that repeat a kept doc_id stay.
    """
    kept = near_duplicates(docs, **options).where("kept").select("doc_id").distinct()
    same = docs["doc_id"].eqNullSafe(kept["doc_id"])
    return docs.join(kept, same, "left_semi")
