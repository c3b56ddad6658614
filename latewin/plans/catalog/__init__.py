"""All named queries. Importing the modules registers them."""

from latewin.plans.catalog import (  # noqa: F401
    basics,
    lateness,
    lifecycle,
    compare,
    matrix,
    anomalies,
    tables,
    streams,
)
from latewin.plans.catalog.registry import ENTRIES

__all__ = ["ENTRIES"]
