"""Isolation forest over window rows: trees grow in parallel, rows are scored in place.

Liu, Ting, Zhou: Isolation Forest, ICDM 2008. A tree sees at most 256 rows,
whatever the table holds, so the forest is small by construction (trees x 511
nodes) and the table is only ever scanned.

A split follows from the least and greatest value of every feature in the node and a hash of
(seed, tree, node); node i has children 2i + 1 and 2i + 2. All choices are arithmetic on MD5
digits, so another engine that follows the same rules grows the same trees. Features are
rounded first, so that the order in which partial sums were added cannot change a split.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import md5
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latewin.operators.features import FEATURES, window_features
from latewin.operators.ordering import with_run_value
from latewin.operators.quantile import exact_quantile
from latewin.session import stage

KEYS = ("start", "DeviceId", "Sensor")
EULER = 0.5772156649015329
_NODES = (
    "tree int, node int, feature int, threshold double, left int, right int, depth double"
)
#: Ranks are taken modulo this prime; digits of a hash are seven hexadecimal ones.
PRIME = 2147483647
HASHES = 1 << 28
#: Places to which features, leaf depths and scores are rounded.
FEATURE_PLACES = {"sum": 6, "avg": 8, "val_range": 6, "avg_ratio": 6, "lag_avg_diff": 8}
DEPTH_PLACES = 6
SCORE_PLACES = 9


@dataclass(frozen=True)
class ForestConfig:
    trees: int = 100
    sample: int = 256
    seed: int = 42
    contamination: float = 0.05
    min_rows: int = 5


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype="float64")
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    m = n[big]
    out[big] = 2.0 * (np.log(m - 1.0) + EULER) - 2.0 * (m - 1.0) / m
    return out


def rounded(features: DataFrame) -> DataFrame:
    return features.withColumns({c: F.round(c, k) for c, k in FEATURE_PLACES.items()})


def _hash(*parts) -> Column:
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def _constant(seed: int, name: str, tree: int) -> int:
    return int(md5(f"{seed}|{name}|{tree}".encode()).hexdigest()[:7], 16)


def subsamples(features: DataFrame, rows: int, cfg: ForestConfig) -> DataFrame:
    """For every tree the ``sample`` rows of the lowest rank (a * hash of the key + b) mod PRIME.

    A row first keeps only the trees for which it ranks among the lowest few multiples of the
    sample size, so far fewer than rows x trees rows are ordered. Should that leave a tree
    short, all rows are ranked.
    """
    wanted = min(cfg.sample, rows)
    chosen = _ranked(features, cfg, min(1.0, 2.0 * cfg.sample / max(rows, 1)))
    if rows > 2 * cfg.sample:
        chosen = stage(chosen, "subsamples")
        full = chosen.groupBy("tree").count().filter(F.col("count") >= wanted).count()
        if full < cfg.trees:
            chosen = _ranked(features, cfg, 1.0)
    return chosen


def _ranked(features: DataFrame, cfg: ForestConfig, share: float) -> DataFrame:
    a, b = (
        F.array(*[F.lit(_constant(cfg.seed, name, t) + 1).cast("long") for t in range(cfg.trees)])
        for name in "ab"
    )

    def rank(tree: Column) -> Column:
        return (F.col("_key") * F.get(a, tree) + F.get(b, tree)) % PRIME

    trees = F.sequence(F.lit(0), F.lit(cfg.trees - 1))
    low = features.withColumn("_key", _hash(*[F.col(c) for c in KEYS])).withColumn(
        "tree", F.explode(F.filter(trees, lambda t: rank(t) < int(share * PRIME) + 1))
    )
    order = Window.partitionBy("tree").orderBy("_rank", *KEYS)
    return (
        low.withColumn("_rank", rank(F.col("tree")))
        .withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") <= cfg.sample)
        .drop("_key", "_rank", "_place")
    )


def _grow(tree: int, x: np.ndarray, seed: int) -> pd.DataFrame:
    """Nodes of one tree; a leaf's depth includes what is still unsplit below it."""

    def digits(name: str, node: int) -> int:
        return int(md5(f"{seed}|{name}|{tree}|{node}".encode()).hexdigest()[:7], 16)

    limit = ceil(log2(max(len(x), 2)))
    nodes, todo = [], [(0, 0, x)]
    while todo:
        node, depth, here = todo.pop()
        low, high = here.min(axis=0), here.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(here) <= 1 or len(usable) == 0:
            below = depth + float(average_path([len(here)])[0])
            nodes.append((tree, node, -1, 0.0, -1, -1, round(below, DEPTH_PLACES)))
            continue
        feature = int(usable[digits("feature", node) % len(usable)])
        least, most = float(low[feature]), float(high[feature])
        cut = least + (most - least) * (digits("cut", node) / HASHES)
        cut = least if cut >= most else cut
        left, right = 2 * node + 1, 2 * node + 2
        nodes.append((tree, node, feature, cut, left, right, float(depth)))
        goes_left = here[:, feature] <= cut
        todo += [(left, depth + 1, here[goes_left]), (right, depth + 1, here[~goes_left])]
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in _NODES.split(", ")])


def fit_forest(
    features: DataFrame, cfg: ForestConfig = ForestConfig(), rows: int | None = None
) -> DataFrame:
    """Node table of the forest; one small task per tree. Inner nodes name a feature, leaves -1."""
    seed, names = cfg.seed, list(FEATURES)

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return _grow(int(key[0]), part[names].to_numpy("float64"), seed)

    rows = features.count() if rows is None else rows
    return subsamples(features, rows, cfg).groupBy("tree").applyInPandas(build, _NODES)


def score(features: DataFrame, forest: DataFrame, sample: int) -> DataFrame:
    """Add ``score`` in (0, 1), higher for easier to isolate.

    The node table (at most trees x 511 rows) travels to the executors with the
    function; rows stay in their partitions.
    """
    nodes = forest.toPandas()
    size = int(nodes["node"].max()) + 1
    trees = []
    for _, part in nodes.sort_values("tree", kind="stable").groupby("tree", sort=True):
        arrays = []
        for column, filler in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("depth", 0.0)):
            full = np.full(size, filler)
            full[part["node"].to_numpy()] = part[column].to_numpy()
            arrays.append(full)
        trees.append(tuple(arrays))
    norm = float(average_path([sample])[0]) or 1.0
    schema = T.StructType([*features.schema.fields, T.StructField("score", T.DoubleType())])
    names = list(FEATURES)

    def run(batches):
        for rows in batches:
            x = rows[names].to_numpy("float64")
            index = np.arange(len(x))
            total = np.zeros(len(x))
            for feature, threshold, left, right, depth in trees:
                at = np.zeros(len(x), dtype="int64")
                inner = feature[at] >= 0
                while inner.any():
                    f = feature[at]
                    below = x[index, np.maximum(f, 0)] <= threshold[at]
                    step = np.where(below, left[at], right[at])
                    at = np.where(f >= 0, step, at)
                    inner = feature[at] >= 0
                total += depth[at]
            found = np.power(2.0, -total / len(trees) / norm)
            yield rows.assign(score=np.round(found, SCORE_PLACES))

    return features.mapInPandas(run, schema)


class Detection:
    """Scores of a table of window rows and the reports on them."""

    def __init__(self, rows: DataFrame, cfg: ForestConfig = ForestConfig()):
        self.cfg = cfg
        self.features = stage(rounded(window_features(rows)), "features")
        self.rows = self.features.count()
        self.sufficient = self.rows >= cfg.min_rows
        if self.sufficient:
            forest = fit_forest(self.features, cfg, self.rows)
            scored = stage(
                score(self.features, forest, min(cfg.sample, self.rows)), "scores"
            )
            self.threshold = exact_quantile(scored, "score", 1.0 - cfg.contamination)
            shifted = F.round(F.col("score") - F.lit(self.threshold), SCORE_PLACES)
            self._scored = scored.withColumns(
                {"anomaly_score": shifted, "is_anomaly": shifted > 0}
            )

    @property
    def scored(self) -> DataFrame:
        """Rows with ``anomaly_score`` (above 0 is anomalous) and ``is_anomaly``."""
        if self.sufficient:
            return self._scored.drop("score")
        return self.features.limit(0).withColumns(
            {"anomaly_score": F.lit(0.0), "is_anomaly": F.lit(False)}
        )

    def summary(self) -> DataFrame:
        """Status, counts and score extremes as one row."""
        cfg = self.cfg
        found = self.scored.agg(
            F.count(F.when(F.col("is_anomaly"), 1)).alias("anomaly_count"),
            F.coalesce(F.round(F.min("anomaly_score"), 4), F.lit(0.0)).alias("score_min"),
            F.coalesce(F.round(F.max("anomaly_score"), 4), F.lit(0.0)).alias("score_max"),
            F.coalesce(F.round(F.avg("anomaly_score"), 4), F.lit(0.0)).alias("score_mean"),
        )
        return found.select(
            F.lit("success" if self.sufficient else "insufficient_data").alias("status"),
            F.lit(self.rows).cast("long").alias("observations_scored"),
            "anomaly_count",
            F.round(F.col("anomaly_count") / max(self.rows, 1) * 100, 2).alias(
                "anomaly_percentage"
            ),
            "score_min",
            "score_max",
            "score_mean",
            F.lit("IsolationForest").alias("algorithm"),
            F.lit(cfg.contamination).alias("contamination"),
            F.lit(cfg.seed).alias("random_state"),
            F.lit(cfg.trees).alias("n_estimators"),
        )

    def histogram(self, bins: int = 10) -> DataFrame:
        return histogram(self.scored, "anomaly_score", bins)

    def top(self, size: int = 50) -> DataFrame:
        """Anomalous rows, most anomalous first."""
        return (
            self.scored.filter("is_anomaly")
            .orderBy(F.col("anomaly_score").desc(), *KEYS)
            .limit(size)
        )

    def preview(self, size: int = 20) -> DataFrame:
        return self.scored.orderBy("DeviceId", "Sensor", "start").limit(size)


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin includes the maximum.

    A constant column gets unit width around its value.
    """
    ends = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    same = F.col("_low") == F.col("_high")
    ends = ends.select(
        F.when(same, F.col("_low") - 0.5).otherwise(F.col("_low")).alias("_low"),
        F.when(same, F.col("_high") + 0.5).otherwise(F.col("_high")).alias("_high"),
    )
    placed = with_run_value(df.select(column), ends, ["_low", "_high"], ())
    width = (F.col("_high") - F.col("_low")) / bins
    bucket = F.least(F.floor((F.col(column) - F.col("_low")) / width), F.lit(bins - 1))
    counts = placed.groupBy(bucket.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    empty = ends.filter("_low is not null").select(
        "_low", "_high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    return empty.join(counts, "bin", "left").select(
        "bin",
        F.round(F.col("_low") + width * F.col("bin"), 3).alias("bin_start"),
        F.round(F.col("_low") + width * (F.col("bin") + 1), 3).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )
