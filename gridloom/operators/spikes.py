"""Implausible readings: spikes, frozen stretches and impossible values, per source.

1. Profile.  Readings are averaged into half-hour cells; each source's cells form
   matrices of days by time of day (at most PROFILE_DAYS rows each).  Robust
   principal components (principal component pursuit by an augmented Lagrangian, all
   matrices of a batch at once) split each into a low-rank part, the normal daily
   behaviour, and a sparse part.
2. Sparse component.  A reading's is what is left of it without the low-rank part at its own time.  Only a reading
   whose sparse component exceeds a few robust deviations of its source's rest can be a spike.  A counter's profile
   is that of its increments, its low-rank part their path.
3. Veto.  Lasting changes of level, slow swells and cycles that don't keep to the day have a sparse component too.  A reading is
   cleared if it agrees with the readings before or after it, or with its nearest unsuspected neighbours.
4. Constant runs and ranges are tested separately.

Scale: after the profile (a combined aggregation on source, day and cell) every source is a few
hundred numbers a week.  The checks run on blocks of one source and half a day, each with a halo of
neighbouring readings, so a hot source is spread over as many tasks as it has
blocks; blocks are read in order and in bounded batches, all sources of a batch at once in NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.shared import nanoseconds

DAY_NS = 86_400_000_000_000
CELL_NS = 1_800_000_000_000
CELLS = DAY_NS // CELL_NS
BLOCK_NS = DAY_NS // 2
HALO_NS = 5 * 3_600_000_000_000
#: A clock ahead of arrival by more than this is wrong.
CLOCK_SLACK_NS = 120_000_000_000
PROFILE_DAYS = 28

#: What a unit can take, where metric_meta gives no limit.
UNIT_LIMITS = {
    "ratio": (0.0, 1.0),
    "percent": (0.0, 100.0),
    "celsius": (-273.15, None),
    "rpm": (0.0, None),
    "seconds": (0.0, None),
    "bytes": (0.0, None),
    "count": (0.0, None),
}

#: Readings on either side that show what the source does around a reading.
SIDE = 7
#: Deviations (in robust standard deviations of neighbouring differences) of a spike.
SPIKE_SIGMAS, NEAREST_SIGMAS, LOG_SIGMAS, COUNTER_STEPS = 7.4, 5.0, 6.4, 40.0
#: Deviations from the daily profile beyond which a reading has a sparse component.
SPARSE_SIGMAS = 3.0
#: Readings next to a counter's jump that belong to it.
SPREAD = 5
#: A frozen stretch has at least so many readings, whose steps are at most so much of the source's usual step.
FROZEN_READINGS, FROZEN_STEP = 10, 0.1
#: A source keeps varying if at least this share of its half-hours differ from the one before.
VARIES = 0.25
#: The least standard deviation of a source that never varies, relative to its level.
SETTING_SLACK = 0.005
#: Rows judged at once, and the rows of context kept where a block is cut between two turns.
BATCH_ROWS, CONTEXT_ROWS = 100_000, 512

GAUGE, LOG, COUNTER = 0, 1, 2


# -- 1. profile -------------------------------------------------------------------------


def robust_pca(m: np.ndarray, known: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Low-rank parts of a stack of matrices (n, days, cells) by principal component pursuit.

    ``known`` marks the observed entries; the others are free (their sparse part
    costs nothing).  Singular values are shrunk through the small days-by-days Gram matrices.
    """
    n, days, cells = m.shape
    weight = 1.0 / np.sqrt(max(days, cells))
    x = np.where(known, m, 0.0)
    norm = np.sqrt((x * x).sum(axis=(1, 2))) + 1e-12
    spectral = np.sqrt(np.linalg.eigvalsh(x @ x.transpose(0, 2, 1))[:, -1]) + 1e-12
    dual = x / np.maximum(spectral, np.abs(x).max(axis=(1, 2)) / weight + 1e-12)[:, None, None]
    mu = 1.25 / spectral
    sparse, low = np.zeros_like(x), np.zeros_like(x)
    for _ in range(rounds):
        a = x - sparse + dual / mu[:, None, None]
        values, vectors = np.linalg.eigh(a @ a.transpose(0, 2, 1))
        s = np.sqrt(np.maximum(values, 1e-24))
        shrink = np.maximum(s - 1.0 / mu[:, None], 0.0) / s
        low = (vectors * shrink[:, None, :]) @ vectors.transpose(0, 2, 1) @ a
        b = x - low + dual / mu[:, None, None]
        cut = (weight / mu)[:, None, None]
        sparse = np.where(known, np.sign(b) * np.maximum(np.abs(b) - cut, 0.0), b)
        rest = x - low - sparse
        dual = np.where(known, dual + mu[:, None, None] * rest, 0.0)
        mu = np.minimum(mu * 1.5, 1e7 / spectral)
        if (np.sqrt((rest * rest).sum(axis=(1, 2))) < 1e-6 * norm).all():
            break
    return low


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (source, mode, chunk, cells as lists) to rows (source, mode, chunk, low-rank cells, deviation)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        index, value, within = batch.column("c"), batch.column("v"), batch.column("w")
        owner = np.repeat(np.arange(batch.num_rows), np.asarray(pa.compute.list_value_length(index)))
        pos = np.asarray(index.flatten())
        val = np.asarray(value.flatten(), dtype="float64")
        mode = np.asarray(batch.column("mode"))
        wit = np.asarray(within.flatten().cast("float64").fill_null(np.nan))
        wit = np.where(mode[owner] == LOG, wit / np.maximum(val, 1e-12), wit)
        val = np.where(mode[owner] == LOG, np.log(np.maximum(val, 1e-12)), val)
        days = int(pos.max()) // CELLS + 1
        m = np.full((batch.num_rows, days * CELLS), np.nan)
        m[owner, pos] = val
        steps = np.full(m.shape, np.nan)
        steps[owner, pos] = wit
        usual = _nanmedian(steps)
        counters = mode == COUNTER
        if counters.any():  # their daily profile is that of their increments
            d = pd.DataFrame(m[counters].T).ffill().to_numpy().T
            m[counters] = np.where(np.isnan(m[counters]), np.nan, np.diff(d, axis=1, prepend=np.nan))
        with np.errstate(all="ignore"):
            middle = _nanmedian(m)
            off = m - middle[:, None]
            spread = 1.4826 * _nanmedian(np.abs(off)) + 1e-9 * np.abs(middle) + 1e-12
        known = ~np.isnan(m)
        scaled = np.clip(np.where(known, off / spread[:, None], 0.0), -50, 50)
        low = robust_pca(scaled.reshape(-1, days, CELLS), known.reshape(-1, days, CELLS)).reshape(len(m), -1)
        rest = np.where(known, scaled - low, np.nan)
        filled = pd.DataFrame(m.T).ffill().to_numpy().T
        moves = known & (np.abs(np.diff(filled, axis=1, prepend=np.nan)) > 0)
        varies = moves.sum(axis=1) / np.maximum(known.sum(axis=1) - 1, 1)
        sigma = 1.4826 * _nanmedian(np.abs(rest)) * spread
        low = low * spread[:, None] + middle[:, None]
        yield pa.RecordBatch.from_pydict(
            {"s": batch.column("s"), "mode": batch.column("mode"), "chunk": batch.column("chunk"), "low": pa.array(list(low)), "sigma": pa.array(np.nan_to_num(sigma)), "varies": pa.array(varies), "usual": pa.array(usual)},
        )


def _nanmedian(m: np.ndarray) -> np.ndarray:
    """Medians of the rows without NaN (NaN sorts last); 0 for empty rows."""
    s = np.sort(m, axis=1)
    n = (~np.isnan(m)).sum(axis=1)
    rows = np.arange(len(m))
    a, b = s[rows, np.maximum(n - 1, 0) // 2], s[rows, np.minimum(n // 2, m.shape[1] - 1)]
    return np.where(n > 0, (a + b) / 2, 0.0)


def _floor_div(x: str, n: int) -> str:
    return f"(({x}) - pmod({x}, {n}L)) div {n}L"


def prepared(samples: DataFrame, meta: DataFrame) -> DataFrame:
    """Readings with what the tests need: s, id, v, t (a credible time), mode, lo, hi.

    Null and NaN values, and rows without a source, take no part.  A time that is not positive, or ahead of
    arrival, is replaced by the time of arrival (a wrong clock alone is no case).  Metrics
    missing from ``meta`` count as gauges without limits.
    """
    unit = F.col("unit")
    lo, hi = F.col("lower_limit"), F.col("upper_limit")
    for name, (low, high) in UNIT_LIMITS.items():
        lo = F.coalesce(lo, F.when(unit == name, F.lit(low).cast("double")))
        hi = F.coalesce(hi, F.when(unit == name, F.lit(high).cast("double")))
    mode = F.when(F.col("kind") == "counter", COUNTER).when(unit == "seconds", LOG).otherwise(GAUGE)
    kinds = meta.select(F.col("`__name__`").alias("m"), mode.alias("mode"), lo.alias("lo"), hi.alias("hi")).dropDuplicates(["m"])
    arrival = nanoseconds("ingested_at")
    time = F.col("timestamp_ns")
    credible = time.isNotNull() & (time > 0) & (arrival.isNull() | (time <= arrival + CLOCK_SLACK_NS))
    r = samples.select(
        F.col("series_id").alias("s"), F.col("sample_id").alias("id"), F.col("`__name__`").alias("m"), F.col("value").cast("double").alias("v"), F.when(credible, time).otherwise(F.coalesce(arrival, time, F.lit(0))).alias("t")
    ).where(F.col("s").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    return r.join(kinds, "m", "left").select("s", "id", "v", "t", F.coalesce("mode", F.lit(GAUGE)).cast("int").alias("mode"), "lo", "hi")


def daily_profiles(readings: DataFrame) -> DataFrame:
    """Low-rank daily behaviour of each source: s, mode, chunk (of PROFILE_DAYS days), low (cells), sigma, varies (share of cells unlike the one before), usual (step between readings)."""
    usable = readings.where((F.abs("v") < 1e300) & (F.col("lo").isNull() | (F.col("v") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") <= F.col("hi"))))
    cells = usable.groupBy("s", "mode", F.expr(_floor_div("t", CELL_NS)).alias("cell")).agg(F.avg("v").alias("v"), ((F.max("v") - F.min("v")) / F.nullif(F.least(F.count("v"), F.lit(8)) - 1, F.lit(0))).alias("w"))
    chunk = PROFILE_DAYS * CELLS
    lists = cells.groupBy("s", "mode", F.expr(_floor_div("cell", chunk)).alias("chunk")).agg(F.collect_list(F.struct(F.expr(f"CAST(pmod(cell, {chunk}) AS INT)").alias("c"), "v", "w")).alias("l"))
    return lists.select("s", "mode", "chunk", F.col("l.c").alias("c"), F.col("l.v").alias("v"), F.col("l.w").alias("w")).mapInArrow(_profile, "s long, mode int, chunk long, low array<double>, sigma double, varies double, usual double")


# -- 2. to 4. checks on blocks ------------------------------------------------------------


def _segments(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and length of each run of equal keys."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return starts, np.diff(np.r_[starts, len(key)])


def _side_medians(v: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Medians of the up to SIDE values before and after each value of its segment (NaN where there is none)."""
    n = len(v)
    sides = []
    for sign in (1, -1):
        w = np.full((n, SIDE), np.nan)
        for k in range(1, min(SIDE, n - 1) + 1):
            if sign > 0:
                w[k:, k - 1] = np.where(seg[k:] == seg[:-k], v[:-k], np.nan)
            else:
                w[:-k, k - 1] = np.where(seg[k:] == seg[:-k], v[k:], np.nan)
        empty = np.isnan(w).all(axis=1)
        sides.append(np.where(empty, np.nan, _nanmedian(w)))
    return sides[0], sides[1]


def _group_quantile(x: np.ndarray, seg: np.ndarray, n_seg: int) -> np.ndarray:
    """Median of x (NaN left out) per segment number; NaN where there is none."""
    ok = ~np.isnan(x)
    xs, gs = x[ok], seg[ok]
    order = np.lexsort((xs, gs))
    xs, gs = xs[order], gs[order]
    count = np.bincount(gs, minlength=n_seg)
    end = np.cumsum(count)
    out = np.full(n_seg, np.nan)
    has = count > 0
    out[has] = xs[(end - count + (count - 1) // 2)[has]]
    return out


def _nearest_unsuspected(v: np.ndarray, seg: np.ndarray, suspect: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest value before and after each one, in its segment, that is not suspect (NaN: none)."""
    n, i = len(v), np.arange(len(v))
    good = ~suspect
    before = np.maximum.accumulate(np.where(good, i, -1))
    before = np.r_[-1, before[:-1]]
    after = np.minimum.accumulate(np.where(good, i, n)[::-1])[::-1]
    after = np.r_[after[1:], n]
    left = np.where((before >= 0) & (seg[np.maximum(before, 0)] == seg), v[np.maximum(before, 0)], np.nan)
    a = np.minimum(after, n - 1)
    right = np.where((after < n) & (seg[a] == seg), v[a], np.nan)
    return left, right


def _sparse(own: np.ndarray, x: np.ndarray, t: np.ndarray, seg: np.ndarray, position: np.ndarray, mode: np.ndarray, block: dict[str, np.ndarray]) -> np.ndarray:
    """The readings with a sparse component: what is left of ``own`` without the low-rank part exceeds the source's usual rest.

    A counter's rest has no level of its own: the readings near one of its jumps count.  Without a profile every reading counts.
    ``x``, ``t`` and ``seg`` are of the first copies, whose number each row has in ``position``.
    """
    sigma = np.nan_to_num(block["sigma"])
    out = ~(np.abs(own - block["low"]) <= SPARSE_SIGMAS * sigma)
    counters = mode == COUNTER
    if counters.any():
        lead = np.r_[True, position[1:] != position[:-1]]
        rest = x - block["low"][lead]
        since = np.clip(np.diff(t, prepend=0) / CELL_NS, 0, 1)  # the usual rest is that of a cell
        jump = np.abs(np.diff(rest, prepend=np.nan)) > SPARSE_SIGMAS * sigma[lead] * np.sqrt(since)
        jump[np.r_[True, seg[1:] != seg[:-1]]] = False
        near = jump | np.isnan(rest)
        for k in range(1, min(SPREAD, len(jump) - 1) + 1):
            near[k:] |= jump[:-k]
            near[:-k] |= jump[k:]
        out = np.where(counters, near[position], out)
    return out


def judge(block: dict[str, np.ndarray]) -> np.ndarray:
    """Marks the implausible rows of whole blocks: bit 1 spike, 2 frozen, 4 out of range.

    Rows are ordered by block (``g``), then time; rows of equal block and time are copies.
    """
    g, t, v, mode = block["g"], block["t"], block["v"], block["mode"]
    flags = np.zeros(len(v), dtype="int8")
    with np.errstate(all="ignore"):
        flags[(v < block["lo"]) | (v > block["hi"]) | np.isinf(v)] |= 4
        # one row for each instant: the first copy
        lead = np.r_[True, (g[1:] != g[:-1]) | (t[1:] != t[:-1])]
        position = np.cumsum(lead) - 1
        raw, seg_key, pm = v[lead], g[lead], mode[lead]
        seg = np.cumsum(np.r_[False, seg_key[1:] != seg_key[:-1]])
        n_seg = int(seg[-1]) + 1
        logged = pm == LOG
        change = lambda x, m: np.where(m == LOG, np.log(np.maximum(x, 1e-9)), np.clip(x, -1e300, 1e300))
        x = change(raw, pm)
        step = np.abs(np.diff(x, prepend=np.nan))
        step[np.r_[True, seg[1:] != seg[:-1]]] = np.nan
        profile_sigma = np.nan_to_num(block["sigma"][lead], nan=0.0)
        profile_step = np.fmin(profile_sigma, np.nan_to_num(block["usual"][lead], nan=0.0))
        # stretches that stand still, in sources that otherwise keep varying
        still = step <= FROZEN_STEP * profile_step
        _, length = _segments(np.cumsum(~still))
        frozen = (np.repeat(length, length) >= FROZEN_READINGS) & (pm != COUNTER) & (block["varies"][lead] >= VARIES)
        flags[frozen[position]] |= 2
        # the usual step of the block, of its profile where it hardly moves
        moved = (step > 0) & ~(frozen & still)
        enough = np.bincount(seg[moved], minlength=n_seg)[seg] >= FROZEN_READINGS
        usual = np.where(enough, _group_quantile(np.where(moved, step, np.nan), seg, n_seg)[seg], profile_step)
        usual = np.where(pm == COUNTER, usual, np.fmax(usual, 0.3 * profile_step))
        mL, mR = _side_medians(x, seg)
        lo, hi = np.fmin(mL, mR), np.fmax(mL, mR)
        sigma = np.where(pm == COUNTER, usual, usual / 0.954)
        level = np.abs(np.fmin(np.abs(mL), np.abs(mR)))
        sigma = np.fmax(np.nan_to_num(sigma, nan=0.0), np.where((profile_sigma == 0) & (pm == GAUGE), SETTING_SLACK, 1e-6) * np.nan_to_num(level) + 1e-12)
        limit = np.where(pm == COUNTER, COUNTER_STEPS, np.where(logged, LOG_SIGMAS, SPIKE_SIGMAS)) * sigma
        sparse = _sparse(change(v, mode), x, t[lead], seg, position, mode, block)
        suspect = sparse[lead] & ((x > hi + limit) | (x < lo - limit))
        left, right = _nearest_unsuspected(x, seg, suspect)
        # each copy by its own value
        xv = change(v, mode)
        p = position
        outside = np.where(xv > hi[p], xv - hi[p], lo[p] - xv) > limit[p]
        nearest = np.where(mode == COUNTER, limit[p], NEAREST_SIGMAS * sigma[p])
        apart = ~(np.abs(xv - left[p]) <= nearest) & ~(np.abs(xv - right[p]) <= nearest)
        both = ~np.isnan(mL[p]) | ~np.isnan(mR[p])
        flags[sparse & outside & apart & both] |= 1
    return flags


_FOUND = "sample_id long, series_id long, value double, spike boolean, frozen boolean, out_of_range boolean"


def _ingest(batch: pa.RecordBatch, header: dict | None) -> tuple[dict[str, np.ndarray], dict | None]:
    """A batch's readings with the profile of their block, which precedes them; the profile still open at its end."""
    col = {c: batch.column(c) for c in batch.schema.names}
    number = lambda c, kind="float64": np.asarray(col[c].cast(kind).fill_null(np.nan if kind == "float64" else 0))
    s, b, t = (np.asarray(col[c]) for c in ("s", "b", "t"))
    head = np.asarray(pa.compute.is_valid(col["low"]))
    at = np.flatnonzero(head)
    length = np.asarray(pa.compute.list_value_length(col["low"]).fill_null(0))[at]
    heads = {"s": s[at], "b": b[at], "c0": np.asarray(col["c0"].fill_null(0))[at], "n": length, "sigma": number("sigma")[at], "varies": number("varies")[at], "usual": number("usual")[at], "flat": np.asarray(col["low"].flatten().cast("float64").fill_null(np.nan))}
    if header is not None:
        heads = {k: np.concatenate([header[k], heads[k]]) for k in heads}
    rows = np.flatnonzero(~head)
    mine = np.cumsum(head)[rows] - (header is None)
    out = {"s": s[rows], "b": b[rows], "t": t[rows], "id": np.asarray(col["id"].fill_null(-1))[rows], "none": np.asarray(col["id"].is_null())[rows], "v": number("v")[rows], "mode": np.asarray(col["mode"].fill_null(0))[rows], "lo": number("lo")[rows], "hi": number("hi")[rows]}
    for k in ("low", "sigma", "varies", "usual"):
        out[k] = np.full(len(rows), np.nan)
    if len(heads["s"]):
        h = np.maximum(mine, 0)
        right = (mine >= 0) & (heads["s"][h] == out["s"]) & (heads["b"][h] == out["b"])
        offset = np.cumsum(heads["n"]) - heads["n"]
        # the low-rank part at the reading's own time: between the middles of its cell and the nearest other one
        place = np.clip((out["t"] - heads["c0"][h] * CELL_NS) / CELL_NS - 0.5, 0, np.maximum(heads["n"][h] - 1, 0))
        cell = np.minimum(place.astype("int64"), np.maximum(heads["n"][h] - 2, 0))
        inside = right & (heads["n"][h] > 0)
        # a counter's is the path of its increments
        path = np.cumsum(np.nan_to_num(heads["flat"]))
        for flat, mine in ((heads["flat"], inside & (out["mode"] != COUNTER)), (path, inside & (out["mode"] == COUNTER))):
            a = (offset[h] + cell)[mine]
            b = np.minimum(a + 1, (offset[h] + heads["n"][h])[mine] - 1)
            out["low"][mine] = flat[a] + (flat[b] - flat[a]) * (place - cell)[mine]
        for k in ("sigma", "varies", "usual"):
            out[k] = np.where(right, heads[k][h], np.nan)
        last = len(heads["s"]) - 1
        header = {k: v[last:] for k, v in heads.items() if k != "flat"} | {"flat": heads["flat"][offset[last] :]}
    return out, header


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Implausible readings of blocks that come in order of source, block and time."""
    held: dict[str, np.ndarray] | None = None
    header, context, waiting = None, 0, []

    def turn(rows: dict[str, np.ndarray], context: int, last: bool):
        key = np.cumsum(np.r_[True, (rows["s"][1:] != rows["s"][:-1]) | (rows["b"][1:] != rows["b"][:-1])])
        flags = judge(rows | {"g": key})
        n = len(key)
        cut = n if last else int(np.searchsorted(key, key[-1]))
        keep = cut
        if not last and cut <= context:  # one block fills it all: go on with a context of its last rows
            cut, keep = n - CONTEXT_ROWS, n - 2 * CONTEXT_ROWS
        i = np.arange(n)
        hit = (flags > 0) & (i >= context) & (i < cut) & (rows["t"] // BLOCK_NS == rows["b"])
        f = flags[hit]
        out = pa.RecordBatch.from_pydict(
            {"sample_id": pa.array(rows["id"][hit], mask=rows["none"][hit]), "series_id": rows["s"][hit], "value": rows["v"][hit], "spike": (f & 1) > 0, "frozen": (f & 2) > 0, "out_of_range": (f & 4) > 0}
        )
        return out, {k: v[keep:] for k, v in rows.items()}, cut - keep

    for batch in batches:
        if not batch.num_rows:
            continue
        rows, header = _ingest(batch, header)
        waiting.append(rows)
        if sum(len(w["t"]) for w in waiting) >= BATCH_ROWS:
            parts = ([held] if held is not None else []) + waiting
            out, held, context = turn({k: np.concatenate([p[k] for p in parts]) for k in rows}, context, False)
            waiting = []
            yield out
    parts = ([held] if held is not None else []) + waiting
    if parts and sum(len(p["t"]) for p in parts):
        yield turn({k: np.concatenate([p[k] for p in parts]) for k in parts[0]}, context, True)[0]


def implausible(samples: DataFrame, meta: DataFrame) -> DataFrame:
    """The implausible readings of ``samples``: sample_id, series_id, value and the three kinds of fault.

    Null and NaN values are never faults.  Copies of a reading are judged each by its own value.
    Infinite values are out of range.  An empty table gives no rows; extra columns are ignored.
    """
    readings = prepared(samples, meta)
    per_block, halo = BLOCK_NS // CELL_NS, HALO_NS // CELL_NS
    chunk = PROFILE_DAYS * CELLS
    profiles = daily_profiles(readings).select("s", "chunk", "low", "sigma", "varies", "usual", F.explode(F.sequence(F.lit(0), ((F.size("low") - 1) / per_block).cast("int"))).alias("j"))
    start = F.greatest(F.lit(0), F.col("j") * per_block - halo)
    heads = profiles.select(
        "s",
        (F.col("chunk") * (chunk // per_block) + F.col("j")).alias("b"),
        F.lit(-(2**63) + 1).cast("long").alias("t"),
        *[F.lit(None).cast(k).alias(c) for c, k in (("id", "long"), ("v", "double"), ("mode", "int"), ("lo", "double"), ("hi", "double"))],
        F.slice("low", start + 1, F.lit(per_block + 2 * halo)).alias("low"),
        (F.col("chunk") * chunk + start).alias("c0"),
        "sigma",
        "varies",
        "usual",
    )
    block = lambda t: F.expr(_floor_div(t, BLOCK_NS))
    spread = readings.select("s", F.explode(F.array_distinct(F.array(block(f"t - {HALO_NS}L"), block("t"), block(f"t + {HALO_NS}L")))).alias("b"), "t", "id", "v", "mode", "lo", "hi")
    empty = [F.lit(None).cast(k).alias(c) for c, k in (("low", "array<double>"), ("c0", "long"), ("sigma", "double"), ("varies", "double"), ("usual", "double"))]
    rows = spread.select("*", *empty)
    ordered = heads.unionByName(rows).repartition("s", "b").sortWithinPartitions("s", "b", "t", "id")
    return ordered.mapInArrow(_checked, _FOUND)
