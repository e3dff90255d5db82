"""The one intermediate form: a DataFrame of samples with an ordered list of label columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.types import METRIC_NAME


def q(name: str) -> Column:
    """A column by name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_part(a: Column, b: int) -> Column:
    """Quotient of whole numbers, truncated towards 0."""
    return F.call_function("div", a, F.lit(b))


@dataclass
class Grid:
    """Evaluation times start, start + step, ... <= end (ns); an instant query has one."""

    start: int
    end: int
    step: int
    instant: bool = False

    @property
    def last(self) -> int:
        """Number of the last step; -1 if there is none."""
        return (self.end - self.start) // self.step if self.end >= self.start else -1


@dataclass
class SeriesFrame:
    """Columns ``timestamp`` (bigint, ns), ``value`` (double) and the labels (strings, '' for absent)."""

    df: DataFrame
    labels: list[str]

    @property
    def kept(self) -> list[str]:
        """Labels without the metric name."""
        return [x for x in self.labels if x != METRIC_NAME]

    def label(self, name: str) -> Column:
        return q(name) if name in self.labels else F.lit("")

    def with_value(self, value: Column, labels: Sequence[str] | None = None, time: Column | None = None) -> SeriesFrame:
        labels = list(self.labels if labels is None else labels)
        return SeriesFrame(self.df.select((F.col("timestamp") if time is None else time).alias("timestamp"), *[q(x) for x in labels], value.alias("value")), labels)
