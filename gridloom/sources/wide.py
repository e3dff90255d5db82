"""Wide tables: one row per time, one column per series; also as Parquet files.

A column stands for one series, whose metric name and labels come from the column's
metadata or from its name.  Only the matching columns are read; they are unpivoted in one scan.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.errors import DataSourceError
from gridloom.plans.frame import q
from gridloom.sources.base import MetricSource
from gridloom.types import METRIC_NAME, Matcher, MetricMeta, TimeRange

#: Metadata keys that are no labels, and the ending of histogram columns.
RESERVED_KEYS = ("metric", "unit", "grouping_power", "max_value_power")
BUCKETS = ":buckets"

Parsed = tuple[str, dict[str, str]]


def parse_slash_name(column: str) -> Parsed:
    """metric, metric/op, metric/op/id, metric//cgroup/path/id or metric///id."""
    metric, slash, rest = column.removesuffix(BUCKETS).partition("/")
    if not slash:
        return metric, {}
    if rest.startswith("/"):
        group, cut, ident = rest[1:].rpartition("/")
        return metric, ({"cgroup": "/" + group, "id": ident} if cut else {})
    op, cut, ident = rest.partition("/")
    return metric, ({"op": op, "id": ident} if cut else {"op": op})


def parse_column(column: str, metadata: dict[str, str] | None) -> Parsed:
    """Metric and labels of a column: by its metadata if it has any, else by the slash convention."""
    if not metadata:
        return parse_slash_name(column)
    name = metadata.get("metric") or column.removesuffix(BUCKETS)
    return name, {k: v for k, v in metadata.items() if k not in RESERVED_KEYS}


@dataclass
class ColumnMapping:
    """How the columns of a wide table are to be read."""

    timestamp_column: str = "timestamp"
    ignore_columns: tuple[str, ...] = ("duration",)
    parse: Callable[[str, dict[str, str] | None], Parsed] = parse_column
    metadata: dict[str, dict[str, str]] = field(default_factory=dict)


def _is_number(kind: T.DataType) -> bool:
    """Doubles, signed 64-bit numbers, and unsigned ones, which Spark reads as decimal(20,0)."""
    return isinstance(kind, (T.DoubleType, T.LongType)) or kind == T.DecimalType(20, 0)


class WideSource(MetricSource):
    """A wide DataFrame."""

    def __init__(self, df: DataFrame, mapping: ColumnMapping | None = None):
        self.spark, self._df, self.mapping = df.sparkSession, df, mapping or ColumnMapping()
        m = self.mapping
        fields = [f for f in df.schema if f.name != m.timestamp_column and f.name not in m.ignore_columns and _is_number(f.dataType)]
        self._series = {f.name: m.parse(f.name, m.metadata.get(f.name)) for f in fields}

    def has(self, name: str) -> bool:
        return any(metric == name for metric, _ in self._series.values())

    def table_for_metric(self, name: str, matchers: Sequence[Matcher] = (), time: TimeRange = TimeRange()) -> DataFrame:
        mine = {c: labels for c, (metric, labels) in self._series.items() if metric == name}
        if not mine:
            raise DataSourceError(f"no metric {name!r}")
        keys = sorted({k for labels in mine.values() for k in labels})
        wanted = {c: labels for c, labels in mine.items() if all(m.matches(name if m.label == METRIC_NAME else labels.get(m.label, "")) for m in matchers)}
        stamp = q(self.mapping.timestamp_column)
        rows = self._df
        if time.start_ns is not None:  # on the raw column, so that row groups are skipped
            rows = rows.where(stamp >= time.start_ns)
        if time.end_ns is not None:
            rows = rows.where(stamp <= time.end_ns)
        if not wanted:
            nothing = rows.where(F.lit(False)).select(stamp.cast("long").alias("timestamp"), F.lit(0.0).alias("value"))
            return nothing.select("timestamp", "value", F.lit(name).alias(METRIC_NAME), *[F.lit("").alias(k) for k in keys])
        picked = rows.select(stamp.cast("long").alias("timestamp"), *[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(wanted)])
        long = picked.unpivot(["timestamp"], [f"c{i}" for i in range(len(wanted))], "__g_c", "value")
        # the labels of the columns are known to the driver: a constant map, no join
        out = long.select("timestamp", "value", F.lit(name).alias(METRIC_NAME), *[self._label(k, list(wanted.values())).alias(k) for k in keys])
        return out

    @staticmethod
    def _label(key: str, series: list[dict[str, str]]):
        values = [s.get(key, "") for s in series]
        if len(set(values)) == 1:
            return F.lit(values[0])
        pairs = [x for i, v in enumerate(values) for x in (F.lit(f"c{i}"), F.lit(v))]
        return F.create_map(*pairs)[F.col("__g_c")]

    def list_metrics(self, matcher: Matcher | None = None) -> list[MetricMeta]:
        names: dict[str, set[str]] = {}
        for metric, labels in self._series.values():
            names.setdefault(metric, set()).update(labels)
        return [MetricMeta(n, tuple(sorted(names[n]))) for n in sorted(names) if matcher is None or matcher.matches(n)]


def _footers(spark: SparkSession, path: str | Sequence[str]) -> list[tuple[str, object]]:
    """The Parquet files below some paths (files, folders, globs, on any file system Spark knows) and their footers.

    Only footers are read, several at once.
    """
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    try:
        files = sorted(spark.read.parquet(*([path] if isinstance(path, str) else path)).inputFiles())

        def footer(file: str):
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)), hadoop))
            try:
                return reader.getFooter()
            finally:
                reader.close()

        with ThreadPoolExecutor(16) as pool:
            return list(zip(files, pool.map(footer, files), strict=True))
    except (PySparkException, Py4JError) as e:
        raise DataSourceError(f"cannot read {path}: {str(e).splitlines()[0]}") from None


def _column_metadata(footer) -> dict[str, dict[str, str]]:
    """Metadata of the columns, from the Arrow schema that writers of Arrow tables keep in the footer."""
    stored = footer.getFileMetaData().getKeyValueMetaData().get("ARROW:schema")
    if stored is None:
        return {}
    schema = pa.ipc.read_schema(pa.py_buffer(base64.b64decode(stored)))
    return {f.name: {k.decode(): v.decode() for k, v in f.metadata.items() if not k.startswith(b"PARQUET:")} for f in schema if f.metadata}


class WideParquetSource(MetricSource):
    """Wide Parquet files, with the metadata of their columns.

    Files in which a column stands for another series, or has another type, are read apart and put together as samples; there is one
    scan for each such layout.  Metadata given in the mapping take precedence over those of the files.
    """

    def __init__(self, spark: SparkSession, path: str | Sequence[str], mapping: ColumnMapping | None = None):
        self.spark, self.path, mapping = spark, path, mapping or ColumnMapping()
        layouts: dict[tuple, tuple[dict, list[str]]] = {}
        for file, footer in _footers(spark, path):
            told = _column_metadata(footer) | mapping.metadata
            key = footer.getFileMetaData().getSchema().toString(), tuple(sorted((c, *sorted(m.items())) for c, m in told.items()))
            layouts.setdefault(key, (told, []))[1].append(file)
        self.parts = [WideSource(spark.read.parquet(*files), replace(mapping, metadata=told)) for told, files in layouts.values()]

    def table_for_metric(self, name: str, matchers: Sequence[Matcher] = (), time: TimeRange = TimeRange()) -> DataFrame:
        mine = [p.table_for_metric(name, matchers, time) for p in self.parts if p.has(name)]
        if not mine:
            raise DataSourceError(f"no metric {name!r}")
        labels = sorted({c for df in mine for c in df.columns if c not in ("timestamp", "value")})
        full = [df.select("timestamp", "value", *[q(c) if c in df.columns else F.lit("").alias(c) for c in labels]) for df in mine]
        out = full[0]
        for df in full[1:]:
            out = out.unionAll(df)
        return out

    def list_metrics(self, matcher: Matcher | None = None) -> list[MetricMeta]:
        names: dict[str, set[str]] = {}
        for part in self.parts:
            for m in part.list_metrics(matcher):
                names.setdefault(m.name, set()).update(m.label_names)
        return [MetricMeta(n, tuple(sorted(names[n]))) for n in sorted(names)]


def parquet_time_range(path: str | Sequence[str], timestamp_column: str = "timestamp", spark: SparkSession | None = None) -> TimeRange:
    """First and last time in Parquet files, from the statistics in their footers; no data is read."""
    ends = []
    for file, footer in _footers(spark or SparkSession.builder.getOrCreate(), path):
        for block in footer.getBlocks():
            chunks = [c for c in block.getColumns() if c.getPath().toDotString() == timestamp_column]
            if not chunks:
                raise DataSourceError(f"no column {timestamp_column!r} in {file}")
            stats = chunks[0].getStatistics()
            if block.getRowCount() == 0 or (stats is not None and stats.isNumNullsSet() and stats.getNumNulls() == block.getRowCount()):
                continue
            if stats is None or not stats.hasNonNullValue():
                raise DataSourceError(f"no statistics for {timestamp_column!r} in {file}")
            ends.append((int(stats.genericGetMin()), int(stats.genericGetMax())))
    if not ends:
        raise DataSourceError(f"no statistics for {timestamp_column!r}")
    return TimeRange(min(a for a, _ in ends), max(b for _, b in ends))
