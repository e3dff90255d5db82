"""Irregular readings onto a regular grid.

Readings are first reduced to the last one of each grid interval (a map-side
combined aggregation on (source, interval), which also spreads a hot source);
each source then gets its own sequence of steps, left-joined with those buckets,
and the last observation is carried forward as long as it is no older than the
look-back.  After the first aggregation a source has at most one row per step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OBSERVED, CARRIED, MISSING = "observed", "carried", "missing"


def regular_grid(
    readings: DataFrame,
    start_ns: int,
    end_ns: int,
    step_ns: int,
    lookback_ns: int,
    source: str = "series_id",
    time: str = "timestamp_ns",
    value: str = "value",
    arrival: str = "ingested_at",
    tie: str = "sample_id",
) -> DataFrame:
    """One row per source and step of the grid.

    A reading counts if its value is neither null nor NaN, its source is not null
    and its time lies in [start, end].  The steps of a source are the times
    start + k*step from its first to its last reading, both included.  A step t
    takes the last reading in [t - lookback, t], both ends included; of readings
    at the same instant the one that arrived last (then the greater tie column,
    then the greater value).  Status: ``observed`` (the reading lies within one
    step before t), ``carried`` (older) or ``missing`` (value and reading null).
    Sources without a counting reading give no rows.
    """
    if step_ns <= 0 or lookback_ns < 0:
        raise ValueError("the step must be positive, the look-back not negative")
    r = readings.select(
        F.col(f"`{source}`").alias("s"), F.col(f"`{time}`").cast("long").alias("ts"), F.col(f"`{value}`").cast("double").alias("v"), F.col(f"`{arrival}`").alias("a"), F.col(f"`{tie}`").alias("i")
    ).where(F.col("s").isNotNull() & F.col("ts").between(start_ns, end_ns) & F.col("v").isNotNull() & ~F.isnan("v"))
    # the first step at or after a reading; its distance from the start is never negative
    r = r.withColumn("k", F.expr(f"(ts - {start_ns}L + {step_ns - 1}L) div {step_ns}L"))
    buckets = r.groupBy("s", "k").agg(F.max(F.struct("ts", "a", "i", "v")).alias("last")).where(F.col("k").isNotNull()).select("s", "k", F.col("last.ts").alias("ts"), F.col("last.v").alias("v"))
    # the first bucket is the first step, the last reading of all decides on the last one; the shuffled buckets are read twice, the table once
    spans = buckets.groupBy("s").agg(F.min("k").alias("k0"), F.max("ts").alias("l"))
    spans = spans.selectExpr("s", "k0", f"(l - {start_ns}L) div {step_ns}L AS k1").where("k1 >= k0")
    steps = spans.select("s", F.explode(F.sequence("k0", "k1")).alias("k"))
    joined = steps.join(buckets, ["s", "k"], "left")
    over = Window.partitionBy("s").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    reading = F.when(F.col("ts").isNotNull(), F.struct("ts", "v"))
    carried = joined.select("s", "k", (F.col("k") * step_ns + start_ns).alias("t"), F.last(reading, ignorenulls=True).over(over).alias("r"))
    alive = F.col("r").isNotNull() & (F.col("t") - F.col("r.ts") <= lookback_ns)
    return carried.select(
        F.col("s").alias(source),
        F.col("t").alias("step_ts_ns"),
        F.when(alive, F.col("r.v")).alias("value"),
        F.when(alive, F.col("r.ts")).alias("reading_ts_ns"),
        F.when(alive & (F.col("t") - F.col("r.ts") < step_ns), OBSERVED).when(alive, CARRIED).otherwise(MISSING).alias("status"),
    )


def missing_steps(grid: DataFrame, source: str = "series_id") -> DataFrame:
    """The steps without a reading within the look-back."""
    return grid.where(F.col("status") == MISSING).select(source, "step_ts_ns")
