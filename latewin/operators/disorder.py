"""Deliberate disorder: scenario catalogue and arrival orders."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latewin.operators.ordering import BLOCK_ROWS, with_arrival_index

DEFAULT_SEED = 20260826
DEFAULT_BUFFER = 20
_MODULUS = 1 << 31


@dataclass(frozen=True)
class Scenario:
    name: str
    max_delay_seconds: int
    disorder_probability: float


# The disorder profiles every run must share.
SCENARIOS = {
    s.name: s
    for s in (
        Scenario("baseline", 0, 0.00),
        Scenario("mild_ooo", 2, 0.10),
        Scenario("moderate_ooo", 5, 0.25),
        Scenario("heavy_ooo", 10, 0.40),
        Scenario("burst_ooo", 20, 0.50),
    )
}


def scenario(name: str) -> Scenario:
    if name not in SCENARIOS:
        raise ValueError(f"unknown scenario {name!r}; known: {', '.join(SCENARIOS)}")
    return SCENARIOS[name]


def scenario_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(s.name, s.max_delay_seconds, s.disorder_probability) for s in SCENARIOS.values()],
        "name string, max_delay_seconds int, disorder_probability double",
    )


def mix(i: Column, seed: int = 0) -> Column:
    """Linear congruential hash of a non-negative integer, below 2**31.

    Reduced before multiplying, so it never overflows a long.
    """
    reduced = F.pmod(i + F.lit(seed), F.lit(_MODULUS)).cast("long")
    return F.pmod(reduced * F.lit(1103515245) + F.lit(12345), F.lit(_MODULUS))


def displacement(i: Column, probability: Column | float, buffer: int, seed: int) -> Column:
    """0 with probability 1-p, else a hash-chosen shift of 0..buffer-1 positions."""
    r = mix(i, seed)
    percent = probability if isinstance(probability, Column) else F.lit(probability)
    hit = r % 100 < F.round(percent * 100).cast("long")
    return F.when(hit, F.floor(r / 100) % buffer).otherwise(F.lit(0)).cast("long")


def inject_disorder(
    df: DataFrame,
    probability: Column | float,
    position: str = "i",
    buffer: int = DEFAULT_BUFFER,
    seed: int = DEFAULT_SEED,
    by: Sequence[str] = (),
    max_displacement: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Re-index rows so that some arrive up to ``buffer - 1`` places late.

    ``position`` is the in-order integer position (unique within ``by``).
    """
    shift = displacement(F.col(position), probability, buffer, seed)
    if max_displacement is not None:
        shift = F.least(shift, F.lit(max_displacement))
    keyed = df.withColumn("_key", F.col(position).cast("long") + shift)
    return with_arrival_index(
        keyed,
        [F.col("_key"), F.col(position)],
        F.floor(F.col("_key") / block_rows),
        by,
    ).drop("_key")


def buffer_disorder(
    df: DataFrame,
    probability: float,
    position: str = "i",
    buffer: int = DEFAULT_BUFFER,
    seed: int = DEFAULT_SEED,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Reorder through a buffer of ``buffer`` rows, block by block.

    Once the buffer is full, its head leaves, or with the given probability a
    random later element does; what is left at the end of a block leaves in
    random order (in file order when the probability is 0). ``position`` must be
    dense from 0. Adds ``n`` and ``disorder_release``.
    """
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("_slot", T.LongType()),
            T.StructField("disorder_release", T.BooleanType()),
        ]
    )

    def reorder(block: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(position).reset_index(drop=True)
        rng = np.random.default_rng([seed, int(block[0])])
        waiting: list[int] = []
        released: list[int] = []
        disordered: list[bool] = []
        for row in range(len(rows)):
            waiting.append(row)
            if len(waiting) < buffer:
                continue
            jump = probability > 0 and len(waiting) > 1 and rng.random() < probability
            released.append(waiting.pop(int(rng.integers(1, len(waiting))) if jump else 0))
            disordered.append(jump)
        if probability > 0:
            rng.shuffle(waiting)
        out = rows.iloc[released + waiting].copy()
        out["_slot"] = np.arange(len(out), dtype="int64")
        out["disorder_release"] = disordered + [False] * len(waiting)
        return out

    blocked = F.floor(F.col(position) / block_rows)
    out = df.groupBy(blocked.alias("block")).applyInPandas(reorder, schema)
    start = F.floor(F.col(position) / block_rows) * block_rows
    return out.withColumn("n", (start + F.col("_slot") + 1).cast("long")).drop("_slot")


def local_shuffle(
    df: DataFrame, position: str = "i", group: int = 30, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Shuffle within consecutive groups of ``group`` rows."""
    start = F.floor(F.col(position) / group)
    return with_arrival_index(
        df,
        [start, mix(F.col(position), seed), F.col(position)],
        F.floor(start / max(1, BLOCK_ROWS // group)),
    )


def full_shuffle(
    df: DataFrame, position: str = "i", seed: int = DEFAULT_SEED, blocks: int = 1 << 16
) -> DataFrame:
    """Shuffle everything: order by a hash of the position."""
    order = mix(F.col(position), seed)
    return with_arrival_index(
        df, [order, F.col(position)], F.floor(order / (_MODULUS // blocks))
    )


#: Rounds of the permutation of positions.
SWAP_ROUNDS = 24
SWAP_PRIME = (1 << 31) - 1


def swap_rounds(rows: int, seed: int = DEFAULT_SEED) -> list[tuple[int, int, int]]:
    """(pivot below ``rows``, multiplier, addend) of every round, from the seed alone."""

    def number(r: int, name: str) -> int:
        return int(md5(f"{seed}|{name}|{r}".encode()).hexdigest()[:12], 16)

    return [
        (number(r, "pivot") % rows, number(r, "times") % (SWAP_PRIME - 2) + 1, number(r, "plus") % SWAP_PRIME)
        for r in range(SWAP_ROUNDS)
    ]


def permuted(position: Column, rows: int, seed: int = DEFAULT_SEED) -> Column:
    """A keyed permutation of [0, rows): Hoang, Morris, Rogaway's swap-or-not.

    A round pairs x with pivot - x modulo ``rows``; a hash of the larger of both, the same for
    either, decides whether they change places. Each round is a permutation, whatever ``rows``.
    """
    keys = F.array(
        *[
            F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(key, "pmc", strict=True)])
            for key in swap_rounds(rows, seed)
        ]
    )

    def swapped(x: Column, key: Column) -> Column:
        other = F.pmod(key["p"] - x, F.lit(rows))
        mixed = ((F.greatest(x, other) % SWAP_PRIME) * key["m"] + key["c"]) % SWAP_PRIME
        bit = F.floor((mixed * mixed) % SWAP_PRIME / 4096) % 2
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(keys, position.cast("long"), swapped)


def keyed_shuffle(
    df: DataFrame, rows: int, position: str = "i", seed: int = DEFAULT_SEED, name: str = "n"
) -> DataFrame:
    """Shuffle everything: ``position`` is dense from 0, and each row computes its arrival number
    from it alone. No row moves and none is sorted."""
    return df.withColumn(name, permuted(F.col(position), rows, seed) + 1)
