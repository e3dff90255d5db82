"""Rolling totals over trailing periods by binary doubling.

The daily totals of each entity are laid on a dense calendar (days without any
activity included).  From them the sums over 1, 2, 4, 8, ... days are built, each
as the sum of the previous block and the same block shifted by its own length; a
window of any length is then the sum of the blocks of its binary digits, each
shifted past those already added.  A window of w days costs O(log w) additions a
day instead of w, and no range join.

Scale: samples are counted once by an aggregation on (entity, instant), whose key
spreads a hot entity over all tasks; everything after the daily aggregation has at
most one row per entity and calendar day, so no group grows with the samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000


def unpack_blocks(blocks: DataFrame, entity: str = "series_id", samples: str = "samples", written: str = "written_at", block: str = "block_id") -> DataFrame:
    """One row per active sample of ``blocks``, however often it was sent.

    Active: value neither null nor NaN (0 counts), timestamp and entity not null.
    Null and empty lists give nothing.  Samples of one entity with the same
    timestamp are one sample; if their values differ, the block written last
    decides (ties: the greater block id, then the greater value).
    """
    flat = blocks.select(
        F.col(f"`{entity}`").alias("entity"),
        F.col(f"`{written}`").alias("w"),
        F.col(f"`{block}`").alias("b"),
        F.explode(F.col(f"`{samples}`")).alias("s"),
    ).select("entity", F.col("s.timestamp_ns").alias("ts"), F.col("s.value").cast("double").alias("value"), "w", "b")
    flat = flat.where(F.col("entity").isNotNull() & F.col("ts").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    return flat.groupBy("entity", "ts").agg(F.max(F.struct("w", "b", "value")).alias("last")).select("entity", "ts", F.col("last.value").alias("value"))


def doubling_windows(dense: DataFrame, entity: str, day: str, columns: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """Adds ``{column}_{w}`` for each column and window to a table dense in ``day``.

    ``dense`` must have exactly one row per entity and day between the entity's
    first and last day; days before the first count as empty.
    """
    if any(w < 1 for w in windows):
        raise ValueError("a window must be at least one day")
    over = Window.partitionBy(entity).orderBy(day)
    shifted = lambda c, n: F.col(c) if n == 0 else F.lag(c, n, 0).over(over)
    out, length = dense, 1
    blocks = {c: {1: c} for c in columns}
    while length * 2 <= max(windows, default=1):
        out = out.select("*", *[(F.col(blocks[c][length]) + shifted(blocks[c][length], length)).alias(f"__{c}_{length * 2}") for c in columns])
        length *= 2
        for c in columns:
            blocks[c][length] = f"__{c}_{length}"
    wanted = []
    for w in dict.fromkeys(windows):
        for c in columns:
            total, offset = None, 0
            for bit in sorted((b for b in blocks[c] if w & b), reverse=True):
                part = shifted(blocks[c][bit], offset)
                total = part if total is None else total + part
                offset += bit
            wanted.append(total.alias(f"{c}_{w}"))
    return out.select(*dense.columns, *wanted)


def trailing_totals(blocks: DataFrame, last_day_ns: int, windows: Sequence[int] = (7, 30), entity: str = "series_id") -> DataFrame:
    """Trailing totals and averages for each entity, UTC day and window.

    Returns entity, ``day`` (date), ``window_days``, ``n_samples`` (active samples in
    the window), ``total`` (0.0 where there is none), ``average`` (of the samples; null
    where there is none) and ``daily_average`` (total over the window's days).  The days of an
    entity run from its first active day to the day of ``last_day_ns``; entities
    without active samples, or with none up to that day, give no rows.
    """
    last_day = last_day_ns // DAY_NS
    daily = (
        unpack_blocks(blocks, entity)
        .select("entity", F.expr(f"CAST((ts - pmod(ts, {DAY_NS}L)) div {DAY_NS}L AS INT)").alias("d"), "value")
        .where(F.col("d") <= last_day)
        .groupBy("entity", "d")
        .agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    )
    # the calendar: each active day and the quiet ones up to the next
    until = F.coalesce(F.lead("d").over(Window.partitionBy("entity").orderBy("d")) - 1, F.lit(last_day).cast("int"))
    spans = daily.withColumn("until", until).select("entity", "d", "total", "n", F.posexplode(F.sequence("d", "until")).alias("quiet", "day"))
    active = lambda c, nothing: F.when(F.col("quiet") == 0, F.col(c)).otherwise(F.lit(nothing)).alias(c)
    dense = spans.select("entity", F.col("day").alias("d"), active("total", 0.0), active("n", 0))
    rolled = doubling_windows(dense, "entity", "d", ["total", "n"], windows)
    rows = F.array(*[F.struct(F.lit(w).cast("int").alias("w"), F.col(f"total_{w}").alias("total"), F.col(f"n_{w}").alias("n")) for w in dict.fromkeys(windows)])
    flat = rolled.select("entity", "d", F.inline(rows))
    return flat.select(
        F.col("entity").alias(entity),
        F.date_from_unix_date("d").alias("day"),
        F.col("w").alias("window_days"),
        F.col("n").alias("n_samples"),
        F.col("total"),
        F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("average"),
        (F.col("total") / F.col("w")).alias("daily_average"),
    )


def silent_windows(totals: DataFrame, entity: str = "series_id") -> DataFrame:
    """The days whose trailing window holds no active sample."""
    return totals.where(F.col("n_samples") == 0).select(entity, F.date_format("day", "yyyy-MM-dd").alias("day_utc"), "window_days")
