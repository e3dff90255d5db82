"""Plain types of the engine: time ranges, matchers, metadata, results."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

METRIC_NAME = "__name__"
#: Five minutes: how long a sample stays valid for a selector.
DEFAULT_LOOKBACK_NS = 300_000_000_000


@dataclass(frozen=True)
class TimeRange:
    """Inclusive bounds in ns; None is open."""

    start_ns: int | None = None
    end_ns: int | None = None


@dataclass(frozen=True)
class Matcher:
    """A label matcher; op is one of =, !=, =~, !~.  Regular expressions match the whole value."""

    label: str
    op: str
    value: str

    def matches(self, value: str) -> bool:
        if self.op in ("=", "!="):
            return (value == self.value) == (self.op == "=")
        return (re.fullmatch(self.value, value) is not None) == (self.op == "=~")


@dataclass(frozen=True)
class ExtraColumn:
    name: str
    type: str


@dataclass(frozen=True)
class MetricMeta:
    name: str
    label_names: tuple[str, ...] = ()
    extra_columns: tuple[ExtraColumn, ...] = ()


@dataclass(frozen=True)
class Sample:
    timestamp_ns: int
    value: float


@dataclass
class InstantSample:
    labels: dict[str, str]
    timestamp_ns: int
    value: float


@dataclass
class RangeSamples:
    labels: dict[str, str]
    samples: list[Sample] = field(default_factory=list)


@dataclass
class Vector:
    """Result of an instant query."""

    samples: list[InstantSample]


@dataclass
class Matrix:
    """Result of a range query: series sorted by labels, samples by time."""

    series: list[RangeSamples]
