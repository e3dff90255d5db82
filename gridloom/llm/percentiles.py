"""Exact percentiles of very large numeric columns by distributed multi-select.

All requested percentiles of all grouping sets are sought at once, in rounds over the groups' open ranges:

1. Propose.  Each task sorts its values in chunks, cuts each group's into pieces of equal length and proposes the median of each piece,
   weighted by its length.  Proposals are thinned in levels (task, salt, group) by the same rule, so no list is longer than a
   bound that depends neither on the rows nor on the tasks.  With ``pieces=1`` it is the textbook method: one local median a run.
2. Pivot.  The proposal at which the weight reaches the sought rank (for a median: the weighted median) becomes the pivot.  The
   thinning adds up a bound on the rank error; pivots at the rank plus and minus that bound, and between them, make sure that the rank
   lies within.
3. Count three ways.  All values below, at and above each pivot are counted; the ranges ruled out are discarded.  Only what lies
   within the bounds is written down for the next round, typically a few percent of the values in the first and few of these later.

A rank that falls on a pivot's own values is found, so the result has rank error 0; once a range is short enough that its proposals are all of its
values, the pivot is the answer, and the count confirms it.  Nothing is fetched, and no path depends on the size of a group.

Scale: the input is read twice, its values are neither shuffled nor written as a whole.  What is shuffled are
proposals and counts, a bounded number per task and group.  A hot group is spread over all tasks that hold it.

Results of days or partitions combine: :func:`equi_rank_summary` keeps, per group, K+1
exact order statistics, and :func:`combine_summaries` merges any of them with a rank
error of at most n/K.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from fractions import Fraction
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.shared import broadcast_if_small, release, settle

#: Pieces into which the values of a run are cut (an eighth of it in the gaps between pivots); as many proposals at most leave a task.
PIECES = 256
#: Proposals at most that leave a level above the tasks.
UPPER_PIECES = 1024
#: Values sorted at once in a task, and values in a run that is handed on (short, since whole Arrow batches of them are held).
CHUNK_ROWS, RUN_LENGTH = 1 << 18, 1 << 11
#: Proposals held in a task before they are handed on, whatever the number of groups.
HELD = 1 << 21

_RUN = "kind int, key string, run array<double>"
_PROPOSED = "kind int, key string, seg int, salt int, m array<double>, w array<long>, e long"
_COUNTED = "kind int, key string, run array<double>, below array<long>, equal array<long>, seg int, salt int, m array<double>, w array<long>, e long"
_COUNTS = "array<struct<i: int, below: long, equal: long>>"
_STATE_TYPES = {
    "kind": "int",
    "key": "string",
    "n": "long",
    "segments": "array<struct<lo: double, hi: double, left: long, ranks: array<struct<q: double, rank: long>>>>",
    "found": "array<struct<q: double, value: double>>",
    "seg": "array<int>",
    "base": "array<double>",
    "pivots": "array<double>",
    "glo": "array<double>",
    "ghi": "array<double>",
}
_STATE = ", ".join(f"{c} {kind}" for c, kind in _STATE_TYPES.items())


# -- proposals ------------------------------------------------------------------------------


def proposals_of(run: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Medians of the pieces of a sorted run, the pieces' lengths, and the greatest error of a rank taken from them."""
    edges = len(run) * np.arange(min(pieces, len(run)) + 1) // max(min(pieces, len(run)), 1)
    length = np.diff(edges)
    return run[edges[:-1] + (length - 1) // 2], length, int(length.max(initial=0)) // 2


def thinned(m: np.ndarray, w: np.ndarray, e: int, pieces: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The proposals in order, at most ``pieces`` of them: of more, pieces of equal weight propose their weighted median.

    ``e`` bounds by how much the weight up to any value is off its rank, before and after.
    """
    order = np.argsort(m, kind="stable")
    m, w = m[order], w[order]
    if len(m) <= pieces:
        return m, w, e
    reached = np.cumsum(w)
    edges = int(reached[-1]) * np.arange(pieces + 1, dtype=object) // pieces  # whole numbers of any size
    edges = edges.astype("int64")
    weight = np.diff(edges)
    at = np.searchsorted(reached, edges[:-1] + (weight + 1) // 2)
    return m[at], weight, e + int(weight.max()) // 2


class _Proposals:
    """The proposals of one range in one task, thinned level by level."""

    def __init__(self, pieces: int):
        self.pieces, self.levels, self.size = pieces, [], 0

    def add(self, m: np.ndarray, w: np.ndarray, e: int, level: int = 0) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        own = self.levels[level]
        own.append((m, w, e))
        self.size += len(m)
        if (many := sum(len(x[0]) for x in own)) >= 16 * max(self.pieces, 16):
            self.levels[level] = []
            self.size -= many
            self.add(*_merged(own, self.pieces), level + 1)

    def all(self) -> tuple[np.ndarray, np.ndarray, int]:
        return _merged([x for own in self.levels for x in own], self.pieces)


def _merged(lists: list[tuple[np.ndarray, np.ndarray, int]], pieces: int) -> tuple[np.ndarray, np.ndarray, int]:
    m, w, e = zip(*lists, strict=True)
    return thinned(np.concatenate(m), np.concatenate(w), sum(e), pieces)


def _lists(arrays: Sequence[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype("int32")
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


class _Table:
    """Proposals of many ranges, handed on whenever too many are held."""

    def __init__(self, pieces: int):
        self.pieces, self.own, self.size = pieces, {}, 0

    def add(self, key: tuple[int, str, int], m: np.ndarray, w: np.ndarray, e: int) -> None:
        mine = self.own.setdefault(key, _Proposals(self.pieces))
        before = mine.size
        mine.add(m, w, e)
        self.size += mine.size - before

    def batch(self) -> pa.RecordBatch:
        salt = isqrt(TaskContext.get().partitionId())
        rows = [(*k, *p.all()) for k, p in self.own.items()]
        self.own, self.size = {}, 0
        kind, key, seg, m, w, e = zip(*rows, strict=True) if rows else [()] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(key, pa.string()), pa.array(seg, pa.int32()), pa.array([salt] * len(rows), pa.int32()), _lists(m, pa.float64()), _lists(w, pa.int64()), pa.array(e, pa.int64())],
            names=["kind", "key", "seg", "salt", "m", "w", "e"],
        )


# -- the input ------------------------------------------------------------------------------


def _sorted_groups(batches: Iterator[pa.RecordBatch], sets: Sequence[Sequence[int]]) -> Iterator[tuple[int, str, np.ndarray]]:
    """(set, group, sorted values) for each group of each set of the columns by number, chunk by chunk."""

    def chunk(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held)
        v = np.asarray(table.column("v")) + 0.0  # -0.0 is 0.0
        order = np.argsort(v)
        coded = [table.column(i).combine_chunks().dictionary_encode(null_encoding="encode") for i in range(table.num_columns - 1)]
        codes = [np.asarray(c.indices).astype("int64")[order] for c in coded]
        v = v[order]
        for kind, columns in enumerate(sets):
            code = np.zeros(len(v), dtype="int64")
            for c in columns:
                code = code * len(coded[c].dictionary) + codes[c]
                if len(coded[c].dictionary) > 1:
                    code = np.unique(code, return_inverse=True)[1]
            small = len(code) == 0 or code.max() < 1 << 16
            by = np.argsort(code.astype("uint16") if small else code, kind="stable")
            code, values = code[by], v[by]
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(code)], strict=True):
                key = [coded[c].dictionary[int(codes[c][by[a]])].as_py() for c in columns]
                yield kind, json.dumps(key, ensure_ascii=False), values[a:b]

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            yield from chunk(held)
            held, rows = [], 0
    if rows:
        yield from chunk(held)


def _first_proposals(sets: Sequence[Sequence[int]], pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = _Table(pieces)
        for kind, key, values in _sorted_groups(batches, sets):
            told.add((kind, key, 0), *proposals_of(values, pieces))
            if told.size > HELD:
                yield told.batch()
        yield told.batch()

    return run


def _runs(sets: Sequence[Sequence[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, keys, runs, size = [], [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.string()), _lists(runs, pa.float64())], names=["kind", "key", "run"])

        for kind, key, values in _sorted_groups(batches, sets):
            for a in range(0, len(values), RUN_LENGTH):
                kinds.append(kind)
                keys.append(key)
                runs.append(values[a : a + RUN_LENGTH])
            size += len(values)
            if size >= CHUNK_ROWS:
                yield batch()
                kinds, keys, runs, size = [], [], [], 0
        yield batch()

    return run


# -- rounds ---------------------------------------------------------------------------------


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (null as NaN) and offsets of a column of lists."""
    return column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))].astype("int64")


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The proposals of each range and salt, thinned where they are many."""
    for batch in batches:
        (m, at), (w, _) = _flat(batch.column("m")), _flat(batch.column("w"))
        errors = batch.column("e").to_pylist()
        lists = [(m[a:b], w[a:b], e) for a, b, e in zip(at, at[1:], errors, strict=False)]
        lists = [thinned(*x, UPPER_PIECES) if len(x[0]) > UPPER_PIECES else x for x in lists]
        told = [_lists([x[0] for x in lists], pa.float64()), _lists([x[1] for x in lists], pa.int64()), pa.array([x[2] for x in lists], pa.int64())]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("kind", "key", "seg", "salt")], *told], names=["kind", "key", "seg", "salt", "m", "w", "e"])


def _count(pieces: int):
    """Rows (kind, key, run, base, pivots, glo, ghi): what lies below and at each pivot (once a task and group), the values within the gaps
    that stay in play, and the proposals for each of these gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[tuple[int, str], list[np.ndarray]] = {}
        kept: dict[tuple[int, str], list[np.ndarray]] = {}
        proposed, size = _Table(pieces), 0

        def rows(keys: list[tuple[int, str]], **columns: pa.Array) -> pa.RecordBatch:
            nothing = {"run": pa.list_(pa.float64()), "below": pa.list_(pa.int64()), "equal": pa.list_(pa.int64()), "seg": pa.int32(), "salt": pa.int32(), "m": pa.list_(pa.float64()), "w": pa.list_(pa.int64()), "e": pa.int64()}
            arrays = {"kind": pa.array([k for k, _ in keys], pa.int32()), "key": pa.array([k for _, k in keys], pa.string())}
            arrays |= {c: columns.get(c, pa.nulls(len(keys), kind)) for c, kind in nothing.items()}
            return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

        def counts() -> pa.RecordBatch:
            return rows(list(told), below=_lists([x[0] for x in told.values()], pa.int64()), equal=_lists([x[1] for x in told.values()], pa.int64()))

        def rest() -> pa.RecordBatch:
            parts = [(k, part) for k, own in kept.items() for whole in [np.sort(np.concatenate(own))] for part in np.split(whole, range(RUN_LENGTH, len(whole), RUN_LENGTH))]
            return rows([k for k, _ in parts], run=_lists([x for _, x in parts], pa.float64()))

        def proposals() -> pa.RecordBatch:
            b = proposed.batch()
            return rows(list(zip(b.column("kind").to_pylist(), b.column("key").to_pylist(), strict=True)), **{c: b.column(c) for c in ("seg", "salt", "m", "w", "e")})

        for batch in batches:
            kinds, keys = batch.column("kind").to_pylist(), batch.column("key").to_pylist()
            (run, r), (base, a), (pivots, _), (glo, b), (ghi, _) = (_flat(batch.column(c)) for c in ("run", "base", "pivots", "glo", "ghi"))
            for i in range(batch.num_rows):
                own, key = run[r[i] : r[i + 1]], (kinds[i], keys[i])
                p, low = pivots[a[i] : a[i + 1]], base[a[i] : a[i + 1]]
                start = np.where(np.isnan(low), 0, np.searchsorted(own, low, "right"))
                left, right = np.searchsorted(own, p, "left"), np.searchsorted(own, p, "right")
                found = [np.maximum(left - start, 0), right - left]
                told[key] = [x + y for x, y in zip(told[key], found, strict=True)] if key in told else found
                lo, hi = glo[b[i] : b[i + 1]], ghi[b[i] : b[i + 1]]
                begin = np.where(np.isnan(lo), 0, np.searchsorted(own, lo, "right"))
                end = np.where(np.isnan(hi), len(own), np.searchsorted(own, hi, "left"))
                for gap in np.flatnonzero(end > begin):
                    part = own[begin[gap] : end[gap]].copy()
                    kept.setdefault(key, []).append(part)
                    size += len(part)
                    proposed.add((*key, int(gap)), *proposals_of(part, pieces))
            if size >= CHUNK_ROWS:
                yield rest()
                kept, size = {}, 0
            if proposed.size > HELD:
                yield proposals()
            if len(told) * max((len(x[0]) for x in told.values()), default=0) > HELD:
                yield counts()
                told = {}
        yield rest()
        yield proposals()
        yield counts()

    return run


def rank_of(q: float, n: int) -> int:
    """ceil(q * n), 1 at least, for q as written (0.07 is 7/100)."""
    return max(1, min(n, ceil(Fraction(repr(float(q))) * n)))


def choose_pivots(m: np.ndarray, w: np.ndarray, e: int, rank: int) -> tuple[list[float], float | None, float | None]:
    """The pivots for a rank: the proposal whose weight reaches it, flanked by others up to the rank's error bound.

    Also the bounds between which the rank lies for sure, ends included (None: that end of the range).
    """
    reached = np.cumsum(w)
    total = int(reached[-1])
    at = lambda r: float(m[np.searchsorted(reached, r)])
    out, off = [at(min(rank, total))], e
    while off >= 1:
        out += [at(r) for r in (rank - off, rank + off) if 1 <= r <= total]
        off //= 4
    return out, at(rank - e) if rank - e >= 1 else None, at(rank + e) if rank + e <= total else None


def narrow(segments: list[dict], seg: list[int], pivots: list[float], below: list[int], equal: list[int]) -> tuple[list[dict], list[dict]]:
    """The ranges that remain open after the counts, in order, and the ranks found (q, value)."""
    out: list[dict] = []
    found: list[dict] = []
    for s, part in enumerate(segments):
        a, b = bisect_left(seg, s), bisect_right(seg, s)
        upto = [x + y for x, y in zip(below[a:b], equal[a:b], strict=True)]
        for r in part["ranks"]:
            i = bisect_left(upto, r["rank"])
            if i < len(upto) and r["rank"] > below[a + i]:
                found.append({"q": r["q"], "value": pivots[a + i]})
                continue
            hi, cap = (pivots[a + i], below[a + i]) if i < len(upto) else (part["hi"], part["left"])
            lo, skipped = (pivots[a + i - 1], upto[i - 1]) if i else (part["lo"], 0)
            target = {"q": r["q"], "rank": r["rank"] - skipped}
            if out and (out[-1]["lo"], out[-1]["hi"]) == (lo, hi):
                out[-1]["ranks"].append(target)
            else:
                out.append({"lo": lo, "hi": hi, "left": cap - skipped, "ranks": [target]})
    return out, found


def gaps_between(bounds: list[tuple[float | None, float | None]], segments: list[dict], seg: list[int], pivots: list[float]) -> list[tuple[float | None, float | None]]:
    """The gaps between neighbouring pivots (or ends of their range) in which a rank may lie: ``bounds`` has those of each rank of each range."""
    out, k = [], 0
    for s, part in enumerate(segments):
        own = pivots[bisect_left(seg, s) : bisect_right(seg, s)]
        ends, wanted = [part["lo"], *own, part["hi"]], set()
        for lo, hi in bounds[k : k + len(part["ranks"])]:
            wanted.update(range(0 if lo is None else bisect_right(own, lo), (len(own) if hi is None else bisect_left(own, hi)) + 1))
        k += len(part["ranks"])
        out += [(ends[j], ends[j + 1]) for j in sorted(wanted)]
    return out


def _step(probabilities: Sequence[float]):
    """Rows (kind, key, n, segments, seg, pivots, glo, ghi, c = counts, l = proposals): narrows each group's ranges and picks the next pivots.

    In the first round there are but the proposals, for the one range of all values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                lists: dict[int, list] = {}
                for p in row["l"] or []:
                    lists.setdefault(p["seg"], []).append((np.array(p["m"], dtype="float64"), np.array(p["w"], dtype="int64"), p["e"]))
                n, found = row["n"], []
                if row["segments"] is None:
                    n = sum(int(w.sum()) for _, w, _ in lists[0])
                    segments = [{"lo": None, "hi": None, "left": n, "ranks": [{"q": float(q), "rank": rank_of(q, n)} for q in probabilities]}]
                    gap = {(None, None): 0}
                else:
                    told = {c["i"]: c for c in row["c"]}
                    below, equal = ([told[i][x] for i in range(len(row["pivots"]))] for x in ("below", "equal"))
                    segments, found = narrow(row["segments"], row["seg"], row["pivots"], below, equal)
                    gap = {x: i for i, x in enumerate(zip(row["glo"], row["ghi"], strict=True))}
                seg, base, pivots, bounds = [], [], [], []
                for s, part in enumerate(segments):
                    merged = _merged(lists[gap[part["lo"], part["hi"]]], UPPER_PIECES)
                    mine: set[float] = set()
                    for r in part["ranks"]:
                        chosen, lo, hi = choose_pivots(*merged, r["rank"])
                        mine |= set(chosen)
                        bounds.append((lo, hi))
                    pivots += sorted(mine)
                    seg += [s] * len(mine)
                    base += [part["lo"]] * len(mine)
                gaps = gaps_between(bounds, segments, seg, pivots)
                out.append({"kind": row["kind"], "key": row["key"], "n": n, "segments": segments, "found": found, "seg": seg, "base": base, "pivots": pivots, "glo": [x[0] for x in gaps], "ghi": [x[1] for x in gaps]})
            yield pa.RecordBatch.from_pylist(out, schema=_arrow_state())

    return run


def _arrow_state() -> pa.Schema:
    numbers = pa.list_(pa.float64())
    ranks = pa.list_(pa.struct([("q", pa.float64()), ("rank", pa.int64())]))
    segments = pa.list_(pa.struct([("lo", pa.float64()), ("hi", pa.float64()), ("left", pa.int64()), ("ranks", ranks)]))
    found = pa.list_(pa.struct([("q", pa.float64()), ("value", pa.float64())]))
    return pa.schema([("kind", pa.int32()), ("key", pa.string()), ("n", pa.int64()), ("segments", segments), ("found", found), ("seg", pa.list_(pa.int32())), ("base", numbers), ("pivots", numbers), ("glo", numbers), ("ghi", numbers)])


def grouped_percentiles(values: DataFrame, sets: Sequence[Sequence[str]], probabilities: Sequence[float], value: str = "value", pieces: int | None = None) -> DataFrame:
    """Exact percentiles (the value of rank ceil(q*n), 1 at least) for each group of each grouping set.

    Returns ``kind`` (position in ``sets``), one string column per grouping column (null
    where it is not part of the set or is itself null), ``q``, ``n`` and ``value``.  Nulls and
    NaN are not counted; a group without any number gives no row.  Ties and
    repeated rows count as often as they occur; infinite values sort to the ends; -0.0 counts as 0.0.
    A probability is read as it is written (0.07 is 7/100); one given twice counts once.

    The search runs when this is called; the result reads what it settled in the shared folder.
    """
    probabilities = sorted({float(p) for p in probabilities})
    if not probabilities:
        raise ValueError("no probability is given")
    pieces = pieces or max(PIECES, 4 * len(probabilities))
    cell = list(dict.fromkeys(k for keys in sets for k in keys))
    number = F.col(f"`{value}`").cast("double")
    source = values.where(number.isNotNull() & ~F.isnan(number)).select(*[F.col(f"`{c}`").cast("string").alias(f"cell{i}") for i, c in enumerate(cell)], number.alias("v"))
    columns = [[cell.index(k) for k in keys] for keys in sets]
    group = ["kind", "key"]
    runs = source.mapInArrow(_runs(columns), _RUN)
    proposed = source.mapInArrow(_first_proposals(columns, pieces), _PROPOSED)
    told, answers, counted = None, None, None
    while True:
        few = proposed.groupBy(*group, "seg", "salt").agg(F.collect_list(F.struct("m", "w")).alias("l"), F.sum("e").alias("e"))
        few = few.select(*group, "seg", "salt", F.flatten("l.m").alias("m"), F.flatten("l.w").alias("w"), "e").mapInArrow(_thin, _PROPOSED)
        lists = few.groupBy(*group).agg(F.collect_list(F.struct("seg", "m", "w", "e")).alias("l"))
        if told is None:
            wanted = lists.select(*group, *[F.lit(None).cast(_STATE_TYPES[c]).alias(c) for c in ("n", "segments", "seg", "pivots", "glo", "ghi")], F.lit(None).cast(_COUNTS).alias("c"), "l")
        else:
            wanted = told.join(lists, group, "left").select(*group, "n", "segments", "seg", "pivots", "glo", "ghi", "c", "l")
        state = settle(wanted.mapInArrow(_step(probabilities), _STATE))
        found = state.select(*group, "n", F.inline("found"))
        answers = found if answers is None else answers.unionByName(found)
        open_groups = state.where(F.size("pivots") > 0)
        joined, n_open = broadcast_if_small(open_groups.select(*group, "base", "pivots", "glo", "ghi"), F.lit(64) + 16 * F.size("pivots") + 16 * F.size("glo"))
        spent = [] if counted is None else [counted]
        if not n_open:
            release(*spent)
            break
        counted = settle(runs.join(joined, group).mapInArrow(_count(max(pieces // 8, 1)), _COUNTED))
        release(*spent)
        each = counted.where(F.col("below").isNotNull()).select(*group, F.posexplode(F.arrays_zip("below", "equal")).alias("i", "c"))
        sums = each.groupBy(*group, "i").agg(F.sum("c.below").alias("below"), F.sum("c.equal").alias("equal"))
        told = open_groups.join(sums.groupBy(*group).agg(F.collect_list(F.struct("i", "below", "equal")).alias("c")), group)
        # the values still in play; the next count reads them again
        runs = counted.where(F.col("run").isNotNull()).select(*group, "run")
        proposed = counted.where(F.col("m").isNotNull()).select(*group, "seg", "salt", "m", "w", "e")
    parts = answers.withColumn("k", F.from_json("key", "array<string>"))
    wanted = []
    for c in cell:
        picked = F.lit(None).cast("string")
        for kind, keys in enumerate(sets):
            if c in keys:
                picked = F.when(F.col("kind") == kind, F.get("k", F.lit(list(keys).index(c)))).otherwise(picked)
        wanted.append(picked.alias(c))
    return parts.select("kind", *wanted, "q", "n", "value")


# -- summaries ------------------------------------------------------------------------------


def equi_rank_summary(values: DataFrame, keys: Sequence[str], parts: int, value: str = "value") -> DataFrame:
    """Mergeable summary of each group: its exact order statistics at ranks ceil(i*n/parts), i = 1..parts, and its least value.

    Returns the keys (as strings), ``n``, ``parts`` and ``points`` (parts + 1 sorted values).
    """
    grid = [i / parts for i in range(parts + 1)]
    points = grouped_percentiles(values, [list(keys)], grid, value)
    packed = points.groupBy(*keys, "n").agg(F.sort_array(F.collect_list(F.struct("q", "value"))).alias("p"))
    return packed.select(*keys, "n", F.lit(parts).alias("parts"), F.transform("p", lambda x: x["value"]).alias("points"))


def combine_summaries(summaries: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Percentiles of the union of many summarised groups, from the summaries alone.

    Each point i >= 1 of a summary stands for its n/parts values up to it.  The answer is
    the smallest point at which the summed weight reaches q*n; its rank is off by at
    most n/parts plus the number of summaries, given as ``rank_error``.
    """
    weighted = summaries.select(*keys, "n", "parts", F.posexplode("points").alias("i", "x")).where(F.col("i") > 0)
    weighted = weighted.withColumn("w", F.col("n") / F.col("parts"))
    points = weighted.groupBy(*keys, "x").agg(F.sum("w").alias("w"))
    totals = summaries.groupBy(*keys).agg(F.sum("n").alias("n"), F.ceil(F.sum(F.col("n") / F.col("parts")) + F.count(F.lit(1))).alias("rank_error"))
    over = Window.partitionBy(*keys)
    running = points.withColumn("c", F.sum("w").over(over.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("w").over(over))
    asked = running.withColumn("q", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    # a tolerance for the rounding of the weights' sum
    reached = asked.where(F.col("c") >= F.col("q") * F.col("all") - F.lit(1e-6)).groupBy(*keys, "q").agg(F.min("x").alias("value"))
    condition = [reached[k].eqNullSafe(totals[k]) for k in keys]
    return reached.join(totals, condition).select(*[reached[k] for k in keys], "q", totals["n"], "value", "rank_error")
