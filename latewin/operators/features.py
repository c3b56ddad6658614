"""Numeric features of window rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewin.operators.ordering import running

# The feature names, in model order.
FEATURES = (
    "count",
    "sum",
    "avg",
    "min",
    "max",
    "val_range",
    "avg_ratio",
    "window_hour",
    "window_minute",
    "lag_avg_diff",
)
_SERIES = ("DeviceId", "Sensor")
# Windows of one series are scanned in stretches of this many seconds.
STRETCH = 1 << 22


def clean(c: Column) -> Column:
    """Finite stand-ins: NaN and null to 0, infinities to plus or minus a million."""
    c = F.coalesce(c.cast("double"), F.lit(0.0))
    return (
        F.when(F.isnan(c), F.lit(0.0))
        .when(c == float("inf"), F.lit(1e6))
        .when(c == float("-inf"), F.lit(-1e6))
        .otherwise(c)
    )


def raw_features(rows: DataFrame) -> DataFrame:
    """The ten features before clean-up; missing numbers count as 0.

    The change of the mean is against the series' previous existing window. A
    long series is cut into stretches of time, so none has to fit one task.
    """
    numbers = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        for c in ("count", "sum", "avg", "min", "max")
    }
    base = rows.select(
        F.coalesce("start", F.lit(0)).cast("long").alias("start"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in _SERIES],
        *[e.alias(c) for c, e in numbers.items()],
    )
    base = running(
        base,
        "start",
        F.floor(F.col("start") / STRETCH),
        {"before": (F.col("avg"), "last")},
        by=_SERIES,
        inclusive=False,
    )
    spread = F.col("max") - F.col("min")
    return base.select(
        "start",
        *_SERIES,
        *numbers,
        spread.alias("val_range"),
        ((F.col("avg") - F.col("min")) / (spread + 1e-6)).alias("avg_ratio"),
        F.pmod(F.floor(F.col("start") / 3600), F.lit(24)).cast("double").alias("window_hour"),
        F.pmod(F.floor(F.col("start") / 60), F.lit(60)).cast("double").alias("window_minute"),
        F.coalesce(F.col("avg") - F.col("before"), F.lit(0.0)).alias("lag_avg_diff"),
    )


def window_features(rows: DataFrame) -> DataFrame:
    """Key columns and the ten cleaned features."""
    return raw_features(rows).select(
        "start", *_SERIES, *[clean(F.col(c)).alias(c) for c in FEATURES]
    )
