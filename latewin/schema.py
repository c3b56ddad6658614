"""Table schemas and validated settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

CANONICAL = T.StructType(
    [
        T.StructField("Time", T.LongType()),
        T.StructField("DeviceId", T.StringType()),
        T.StructField("Sensor", T.StringType()),
        T.StructField("Value", T.DoubleType()),
    ]
)

ARRIVAL = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("event_time", T.LongType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("sensor", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_time", T.LongType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("sensor", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("arrival_sequence", T.LongType()),
        T.StructField("scenario", T.StringType()),
    ]
)

RESULT = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("DeviceId", T.StringType()),
        T.StructField("Sensor", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("sum", T.DoubleType()),
        T.StructField("avg", T.DoubleType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
    ]
)

RESULT_KEYS = ("start", "DeviceId", "Sensor")
RESULT_FIELDS = ("count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class WindowConfig:
    """Half-open event-time windows ``[start, start + window)`` every ``slide``."""

    window: int = 60
    slide: int = 10

    def __post_init__(self):
        if self.window <= 0:
            raise ValueError("window must be positive")
        if self.slide <= 0:
            raise ValueError("slide must be positive")
        if self.window % self.slide:
            raise ValueError("window must be divisible by slide")


@dataclass(frozen=True)
class LatenessConfig:
    """Bounds and cadence of the adaptive allowed-lateness budget, in seconds."""

    initial: int = 10
    minimum: int = 2
    maximum: int = 20
    history: int = 100
    percentile: float = 0.95
    min_observations: int = 100
    interval: int = 100

    def __post_init__(self):
        if self.history <= 0:
            raise ValueError("history must be positive")
        if not 0 <= self.minimum <= self.maximum:
            raise ValueError("lateness bounds must satisfy 0 <= minimum <= maximum")
        if not self.minimum <= self.initial <= self.maximum:
            raise ValueError("initial lateness lies outside the bounds")
        if not 0 < self.percentile < 1:
            raise ValueError("percentile must lie strictly between 0 and 1")
        if int(self.percentile * 100) < 1:
            raise ValueError("percentile below 0.01 selects no cut point")
        if self.min_observations <= 0:
            raise ValueError("min_observations must be positive")
        if self.interval <= 0:
            raise ValueError("interval must be positive")

    @property
    def cut(self) -> float:
        """The percentile truncated to whole hundredths."""
        return int(self.percentile * 100) / 100


@dataclass(frozen=True)
class GuardConfig:
    """When archived summaries may be released.

    A cycle fires at arrival n when ``(n - offset) % cycle_events == 0`` and
    once more after the last arrival.
    """

    policy: str = "fixed"
    seconds: int = 20
    cycle_events: int = 100
    offset: int = 0

    def __post_init__(self):
        if self.policy not in ("fixed", "adaptive"):
            raise ValueError("guard policy must be 'fixed' or 'adaptive'")
        if self.cycle_events <= 0:
            raise ValueError("cycle_events must be positive")


@dataclass(frozen=True)
class Mechanism:
    """One way of running the stream: a budget source and an optional guard."""

    name: str
    budget: str = "none"
    fixed_seconds: int = 0
    guard: GuardConfig | None = None
    accounting: bool = False
    lateness: LatenessConfig = field(default_factory=LatenessConfig)
    #: A fixed budget is taken off the maximum before the arrival, not after it.
    lagged: bool = False
    #: Arrivals between two accounting cycles.
    cycle_events: int = 100

    def __post_init__(self):
        if self.cycle_events <= 0:
            raise ValueError("cycle_events must be positive")
        if self.lagged and self.budget != "fixed":
            raise ValueError("only a fixed budget can lag")
        if self.budget not in ("none", "fixed", "adaptive"):
            raise ValueError("budget must be 'none', 'fixed' or 'adaptive'")
        if self.budget == "none" and self.guard is not None:
            raise ValueError("a guard needs a watermark")
        if self.fixed_seconds < 0:
            raise ValueError("fixed lateness must not be negative")
