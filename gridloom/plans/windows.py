"""Time alignment and range functions.

Both reduce the samples before anything is sorted per series.  For a selector, samples that first serve the
same step compete, and only the latest can win: one row per series and step is left.  For range
functions, samples that serve exactly the same windows form a slice; a slice is summarised
(count, ends, increase within), and windows are sums of slices.  So a series with a third of all samples is
spread over as many tasks as it has steps (an instant query: parts of its window), and what is sorted per series is bounded by
the steps or parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.plans.frame import Grid, SeriesFrame, q, whole_part

#: Parts into which the window of an instant query is cut.
INSTANT_PARTS = 256
RANGE_FUNCTIONS = ("rate", "increase", "irate", "delta", "idelta")


def _ceil_step(ts: Column, grid: Grid) -> Column:
    """Number of the first step at or after ts, 0 at least."""
    d = ts - F.lit(grid.start)
    return F.greatest(F.lit(0), whole_part(d + F.pmod(-d, F.lit(grid.step)), grid.step))


def _floor_step(ts: Column, grid: Grid) -> Column:
    """Number of the last step at or before ts; negative before the start."""
    d = ts - F.lit(grid.start)
    return F.least(F.lit(grid.last), whole_part(d - F.pmod(d, F.lit(grid.step)), grid.step))


def _at(k: Column, grid: Grid) -> Column:
    return (k * F.lit(grid.step) + F.lit(grid.start)).cast("long")


def align(samples: DataFrame, labels: list[str], grid: Grid, lookback: int) -> SeriesFrame:
    """For each series and step t, the last sample in [t - lookback, t] (both ends included), reported at t.

    Samples must be shifted by the offset already.  Of samples at one instant the greater value wins.
    """
    names = [q(x) for x in labels]
    newest = F.max(F.struct("timestamp", "value"))
    if grid.instant:
        near = samples.where(F.col("timestamp").between(grid.start - lookback, grid.start))
        out = near.groupBy(*names).agg(newest.alias("__g_last")).select(F.lit(grid.start).cast("long").alias("timestamp"), *names, F.col("__g_last.value").alias("value"))
        return SeriesFrame(out, labels)
    ranged = samples.withColumn("__g_k", _ceil_step(F.col("timestamp"), grid)).where((F.col("__g_k") <= grid.last) & (_floor_step(F.col("timestamp") + F.lit(lookback), grid) >= F.col("__g_k")))
    best = ranged.groupBy(*names, "__g_k").agg(newest.alias("__g_s"))
    following = F.lead("__g_k").over(Window.partitionBy(*names).orderBy("__g_k"))
    until = F.least(_floor_step(F.col("__g_s.timestamp") + F.lit(lookback), grid), F.coalesce(following - 1, F.lit(grid.last)))
    spans = best.withColumn("__g_u", until).where(F.col("__g_u") >= F.col("__g_k"))
    steps = spans.select(*names, F.col("__g_s.value").alias("value"), F.explode(F.sequence("__g_k", "__g_u")).alias("__g_k"))
    return SeriesFrame(steps.select(_at(F.col("__g_k"), grid).alias("timestamp"), *names, "value"), labels)


def _gain(now: Column, before: Column) -> Column:
    """Increase of a counter between two samples; after a reset it is the new value."""
    gain = now - before
    return F.when((gain >= 0) & ~F.isnan(gain), gain).otherwise(now)


def range_function(name: str, samples: DataFrame, labels: list[str], grid: Grid, width: int) -> SeriesFrame:
    """``name`` over the window [t - width, t] (both ends included) of each series and step.

    Windows with fewer than two samples give nothing; rate and irate give nothing over no time.
    """
    names = [q(x) for x in labels]
    ts, value = F.col("timestamp"), F.col("value")
    # the one window of an instant query is cut into parts, or each series would be sorted as a whole
    part = whole_part(ts - F.lit(grid.start - width), max(width // INSTANT_PARTS, 1)) if grid.instant else F.lit(0).cast("long")
    served = samples.select(*names, ts, value, _ceil_step(ts, grid).alias("__g_a"), _floor_step(ts + F.lit(width), grid).alias("__g_b"), part.alias("__g_c"))
    served = served.where(F.col("__g_b") >= F.col("__g_a")).where(F.col("__g_a") <= grid.last)
    within = Window.partitionBy(*names, "__g_a", "__g_b", "__g_c").orderBy("timestamp", "value")
    before = F.lag(F.struct("timestamp", "value")).over(within)
    paired = served.withColumn("__g_p", before)
    sample = F.struct("timestamp", "value")
    slices = paired.groupBy(*names, "__g_a", "__g_b", "__g_c").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(sample).alias("first"),
        F.max(F.struct("timestamp", "value", F.col("__g_p").alias("prev"))).alias("last"),
        F.coalesce(F.sum(F.when(F.col("__g_p").isNotNull(), _gain(value, F.col("__g_p.value")))), F.lit(0.0)).alias("gain"),
    )
    ordered = Window.partitionBy(*names).orderBy("__g_a", "__g_b", "__g_c")
    linked = slices.select("*", F.lag("__g_b").over(ordered).alias("__g_pb"), F.lag(F.struct("last.timestamp", "last.value")).over(ordered).alias("__g_pl"))
    windows = linked.select(*names, "n", "first", "last", "gain", "__g_pb", "__g_pl", F.explode(F.sequence("__g_a", "__g_b")).alias("__g_k"))
    joined = F.col("__g_pb") >= F.col("__g_k")  # the slice before belongs to this window too
    across = F.when(joined, _gain(F.col("first.value"), F.col("__g_pl.value"))).otherwise(F.lit(0.0))
    # a slice of one sample has its predecessor in the slice before
    previous = F.coalesce(F.col("last.prev"), F.when(joined, F.col("__g_pl")))
    aggregates = {
        "n": F.sum("n"),
        "first": F.min("first"),
        "last": F.max(F.struct(F.col("last.timestamp").alias("timestamp"), F.col("last.value").alias("value"), previous.alias("prev"))),
    }
    if name in ("rate", "increase"):
        aggregates["gain"] = F.sum(F.col("gain") + across)
    out = windows.groupBy(*names, "__g_k").agg(*[c.alias(f"__g_{k}") for k, c in aggregates.items()]).where(F.col("__g_n") >= 2)
    first, last, prev = F.col("__g_first"), F.col("__g_last"), F.col("__g_last")["prev"]
    if name == "rate":
        out = out.where(last["timestamp"] > first["timestamp"])
        result = F.col("__g_gain") / ((last["timestamp"] - first["timestamp"]) / F.lit(1e9))
    elif name == "increase":
        result = F.col("__g_gain")
    elif name == "irate":
        out = out.where(last["timestamp"] > prev["timestamp"])
        result = _gain(last["value"], prev["value"]) / ((last["timestamp"] - prev["timestamp"]) / F.lit(1e9))
    elif name == "delta":
        result = last["value"] - first["value"]
    else:
        result = last["value"] - prev["value"]
    return SeriesFrame(out.select(_at(F.col("__g_k"), grid).alias("timestamp"), *names, result.alias("value")), labels)


def time_series(spark, grid: Grid) -> DataFrame:
    """The evaluation times, one row each."""
    return spark.range(0, grid.last + 1).select(_at(F.col("id"), grid).alias("timestamp"))


__all__ = ["RANGE_FUNCTIONS", "align", "range_function", "time_series"]
