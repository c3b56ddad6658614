"""Event-time analytics for sensor streams that arrive out of order, on Spark."""

from latewin.schema import (
    GuardConfig,
    LatenessConfig,
    Mechanism,
    WindowConfig,
)
from latewin.session import build_session

__all__ = [
    "GuardConfig",
    "LatenessConfig",
    "Mechanism",
    "WindowConfig",
    "build_session",
]
