"""The query engine: text in, DataFrame (or collected result) out."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row

from gridloom.errors import ExecutionError, PlanError
from gridloom.lang.nodes import Node
from gridloom.lang.parser import parse
from gridloom.plans.frame import Grid, SeriesFrame
from gridloom.plans.planner import Planner
from gridloom.sources.base import MetricSource
from gridloom.types import DEFAULT_LOOKBACK_NS, InstantSample, Matrix, RangeSamples, Sample, Vector


def nanoseconds(time: int | datetime) -> int:
    """A time in ns since 1970; datetimes without a zone are UTC."""
    if isinstance(time, int):
        return time
    time = time if time.tzinfo else time.replace(tzinfo=timezone.utc)
    since = time - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (since.days * 86_400_000_000 + since.seconds * 1_000_000 + since.microseconds) * 1000


class Engine:
    """Instant and range queries over a source.  ``*_df`` are lazy; the others collect their result."""

    def __init__(self, source: MetricSource, lookback_ns: int = DEFAULT_LOOKBACK_NS, strict: bool = False):
        self.source, self.lookback_ns, self.strict = source, lookback_ns, strict

    def instant_frame(self, query: str | Node, time: int | datetime) -> SeriesFrame:
        t = nanoseconds(time)
        return self._planner(Grid(t, t, 1, instant=True)).plan(self._tree(query))

    def range_frame(self, query: str | Node, start: int | datetime, end: int | datetime, step_ns: int) -> SeriesFrame:
        if step_ns <= 0:
            raise PlanError("the step must be positive")
        return self._planner(Grid(nanoseconds(start), nanoseconds(end), step_ns)).plan(self._tree(query))

    def instant_df(self, query: str | Node, time: int | datetime) -> DataFrame:
        return self.instant_frame(query, time).df

    def range_df(self, query: str | Node, start: int | datetime, end: int | datetime, step_ns: int) -> DataFrame:
        return self.range_frame(query, start, end, step_ns).df

    def instant_query(self, query: str | Node, time: int | datetime) -> Vector:
        frame = self.instant_frame(query, time)
        return self.vector(frame, self.execute(frame))

    def range_query(self, query: str | Node, start: int | datetime, end: int | datetime, step_ns: int) -> Matrix:
        frame = self.range_frame(query, start, end, step_ns)
        return self.matrix(frame, self.execute(frame))

    # -- the steps of a query one by one: a frame is the logical plan

    @staticmethod
    def plans(frame: SeriesFrame) -> dict[str, str]:
        """The texts of a frame's logical, optimized and physical plan; nothing runs."""
        q = frame.df._jdf.queryExecution()
        return {"logical": q.analyzed().toString(), "optimized": q.optimizedPlan().toString(), "physical": q.executedPlan().toString()}

    @staticmethod
    def execute(frame: SeriesFrame) -> list[Row]:
        """The result's rows, on the driver; for results too large for it, use the frame's ``df``."""
        try:
            return frame.df.collect()
        except PySparkException as e:
            raise ExecutionError(str(e)) from e

    @staticmethod
    def vector(frame: SeriesFrame, rows: Iterable[Row]) -> Vector:
        """Rows of an instant frame as a vector, without empty labels."""
        return Vector([InstantSample({x: r[x] for x in frame.labels if r[x]}, r["timestamp"], r["value"]) for r in rows])

    @staticmethod
    def matrix(frame: SeriesFrame, rows: Iterable[Row]) -> Matrix:
        """Rows of a range frame as a matrix: series sorted by labels, samples by time."""
        series: dict[tuple, RangeSamples] = {}
        for s in Engine.vector(frame, rows).samples:
            series.setdefault(tuple(sorted(s.labels.items())), RangeSamples(s.labels)).samples.append(Sample(s.timestamp_ns, s.value))
        for r in series.values():
            r.samples.sort(key=lambda x: x.timestamp_ns)
        return Matrix([series[k] for k in sorted(series)])

    def _planner(self, grid: Grid) -> Planner:
        return Planner(self.source, grid, self.lookback_ns, self.strict)

    @staticmethod
    def _tree(query: str | Node) -> Node:
        return parse(query) if isinstance(query, str) else query
