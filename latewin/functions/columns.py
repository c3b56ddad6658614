"""Finding the four required columns under their usual names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted header names, most preferred first.
ALIASES = {
    "event_time": ("timestamp", "time", "event_time"),
    "device_id": ("deviceid", "device_id", "device"),
    "sensor": ("sensor", "sensor_type"),
    "value": ("value", "val", "reading"),
}
_SPOKEN = {
    "event_time": "timestamp",
    "device_id": "device",
    "sensor": "sensor",
    "value": "value",
}


def resolve_columns(columns: Sequence[str]) -> dict[str, str]:
    """Canonical name to actual column, ignoring case and surrounding blanks."""
    present = {c.strip().lower(): c for c in columns}
    mapping = {}
    for wanted, names in ALIASES.items():
        hit = next((present[a] for a in names if a in present), None)
        if hit is None:
            raise ValueError(
                f"Missing required {_SPOKEN[wanted]} column "
                f"(one of {', '.join(names)}); found {list(columns)}"
            )
        mapping[wanted] = hit
    return mapping


def with_canonical_names(df: DataFrame) -> DataFrame:
    """Project the four required columns under their canonical names."""
    mapping = resolve_columns(df.columns)
    return df.select(*[F.col(f"`{actual}`").alias(name) for name, actual in mapping.items()])
