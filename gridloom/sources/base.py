"""What a metric source has to offer, and the sources over DataFrames."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import DataSourceError
from gridloom.plans.frame import q
from gridloom.types import METRIC_NAME, Matcher, MetricMeta, TimeRange


class MetricSource(ABC):
    """Gives the samples of a metric as a long table.

    The table has ``timestamp`` (whole number, ns), ``value`` (number) and one string column per label; a
    source may apply the matchers and the time range but need not.
    """

    spark: SparkSession

    @abstractmethod
    def table_for_metric(self, name: str, matchers: Sequence[Matcher], time: TimeRange) -> DataFrame: ...

    @abstractmethod
    def list_metrics(self, matcher: Matcher | None = None) -> list[MetricMeta]: ...


class InMemorySource(MetricSource):
    """Several metrics, each in a long DataFrame of its own."""

    def __init__(self, spark: SparkSession, metrics: Mapping[str, DataFrame]):
        self.spark, self._metrics = spark, dict(metrics)

    def table_for_metric(self, name: str, matchers: Sequence[Matcher] = (), time: TimeRange = TimeRange()) -> DataFrame:
        if name not in self._metrics:
            raise DataSourceError(f"no metric {name!r}")
        return self._metrics[name]

    def list_metrics(self, matcher: Matcher | None = None) -> list[MetricMeta]:
        names = [n for n in sorted(self._metrics) if matcher is None or matcher.matches(n)]
        return [MetricMeta(n, tuple(c for c in self._metrics[n].columns if c not in ("timestamp", "value", METRIC_NAME))) for n in names]


class LongTableSource(MetricSource):
    """All metrics in one long table, with their names in a column.

    A metric that does not occur is an empty series: looking for it would cost a scan.
    """

    def __init__(self, df: DataFrame, timestamp: str = "timestamp", value: str = "value", name: str = METRIC_NAME, labels: Sequence[str] | None = None):
        self.spark = df.sparkSession
        self._labels = [c for c in df.columns if c not in (timestamp, value, name)] if labels is None else list(labels)
        self._df = df.select(q(name).alias(METRIC_NAME), q(timestamp).alias("timestamp"), q(value).alias("value"), *[q(x) for x in self._labels])

    def table_for_metric(self, name: str, matchers: Sequence[Matcher] = (), time: TimeRange = TimeRange()) -> DataFrame:
        return self._df.where(q(METRIC_NAME) == name)

    def list_metrics(self, matcher: Matcher | None = None) -> list[MetricMeta]:
        """One row for each metric name comes to the driver."""
        shown = self._df.groupBy(q(METRIC_NAME)).agg(*[F.max(q(x).isNotNull() & (q(x) != "")).alias(f"__g_{i}") for i, x in enumerate(self._labels)])
        rows = shown.where(q(METRIC_NAME).isNotNull()).orderBy(METRIC_NAME).toLocalIterator()
        return [MetricMeta(r[0], tuple(x for i, x in enumerate(self._labels) if r[i + 1])) for r in rows if matcher is None or matcher.matches(r[0])]
