"""Window functions over a stream of samples.

The engine itself is a batch engine; this gives the summaries of sliding windows continuously, with
a watermark for late samples.  Windows here are half-open, [t - width, t), as Structured Streaming has them; the batch
engine's are closed at both ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.frame import q


def sliding(stream: DataFrame, labels: Sequence[str], width: str, step: str, late: str, time: str = "ts", value: str = "value") -> DataFrame:
    """Per series and window: timestamp (its end, ns), n, sum, avg, min, max, and delta (last minus first).

    ``stream`` has a timestamp column ``time``; samples later than ``late`` are dropped, as are those without a
    value.  Absent labels count as ''.  Works on a static table too.
    """
    rows = stream.select(q(time).alias("__g_ts"), q(value).cast("double").alias("__g_v"), *[F.coalesce(q(x), F.lit("")).alias(x) for x in labels])
    rows = rows.withWatermark("__g_ts", late).where(F.col("__g_v").isNotNull())
    grouped = rows.groupBy(F.window("__g_ts", width, step).alias("__g_w"), *[q(x) for x in labels])
    v, ts = F.col("__g_v"), F.col("__g_ts")
    out = grouped.agg(F.count(v).alias("n"), F.sum(v).alias("sum"), F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max_by(v, ts) - F.min_by(v, ts)).alias("delta"))
    return out.select((F.unix_micros("__g_w.end") * 1000).alias("timestamp"), *[q(x) for x in labels], "n", "sum", "avg", "min", "max", "delta")
