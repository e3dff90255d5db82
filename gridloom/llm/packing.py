"""Filling fixed-capacity containers with items by bulk-synchronous best fit.

Documents and gaps are both lists sorted by size, kept run-length encoded: how many
items have each size, how many open containers have each gap.  One superstep a
size, largest first: all its items look for the smallest gap that holds them (the
successor in the sorted gaps), the k-th item of the size goes to the k-th container
of the matched run (rank settles every conflict), the runs' gaps are updated, and what found
no gap opens new containers.  Sizes are bounded by the capacity, so the sweep runs on at most
``capacity`` runs of items, however many documents there are: one task per capacity.

Distributed around it: token counts, the rank of each item among those of its size (counted within each part of the table, with the
counts of the parts before as offset: nothing is sorted, and a size shared by a third of all rows is spread over its parts),
the histogram, and the application of the matched runs, of which each part gets those its ranks fall into.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.encoding import TOKENIZERS, count_tokens
from gridloom.shared import settle


def best_fit_runs(sizes: Sequence[int], counts: Sequence[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Matched runs (size, first rank, last rank, first container, items per container).

    The items of ranks first..last of a size go, in this order, into containers from the first
    one on, ``per`` into each.  Ranks and containers count from 0.
    """
    gaps: list[int] = []  # sorted gaps of open containers
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first container, how many)
    opened, out = 0, []

    def put(gap: int, first: int, many: int) -> None:
        if gap not in runs:
            runs[gap] = []
            insort(gaps, gap)
        runs[gap].append((first, many))

    for size, count in sorted(zip(sizes, counts, strict=True), reverse=True):
        rank = 0
        if size == 0:
            if count and not opened:
                put(capacity, 0, 1)
                opened = 1
            if count:
                out.append((0, 0, count - 1, 0, count))
            continue
        while rank < count:
            at = bisect_left(gaps, size)
            if at == len(gaps):
                gap, first = capacity, opened
                many = -(-(count - rank) // (capacity // size))
                opened += many
            else:
                gap = gaps[at]
                first, many = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            per = gap // size
            full = min(many, (count - rank) // per)
            if full:
                out.append((size, rank, rank + full * per - 1, first, per))
                put(gap - per * size, first, full)
                rank += full * per
            rest = count - rank
            if rest and full < many:
                out.append((size, rank, count - 1, first + full, rest))
                put(gap - rest * size, first + full, 1)
                rank, full = count, full + 1
            if full < many:
                put(gap, first + full, many - full)
    return out


def _sweep(capacities: list[int]):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        kind = int(frame["kind"].iloc[0])
        rows = best_fit_runs(frame["size"].tolist(), frame["n"].tolist(), capacities[kind])
        out = pd.DataFrame(rows, columns=["size", "from", "to", "container", "per"])
        out.insert(0, "kind", kind)
        return out

    return run


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item with its part (of the table) and its rank among the part's items of its kind and size, in the order they come.

    What is kept is one number for each kind and size.
    """
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        kind, size = (np.asarray(batch.column(c)).astype("int64") for c in ("kind", "size"))
        group, at, n = np.unique(kind << 40 | size, return_inverse=True, return_counts=True)
        order = np.argsort(at, kind="stable")
        start = np.cumsum(n) - n
        i = np.empty(len(at), dtype="int64")
        i[order] = np.arange(len(at)) - start[at[order]]
        i += np.array([seen.get(g, 0) for g in group.tolist()], dtype="int64")[at] if len(at) else 0
        for g, k in zip(group.tolist(), n.tolist(), strict=True):
            seen[g] = seen.get(g, 0) + k
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part, dtype="int32")), pa.array(i)], names=[*batch.schema.names, "part", "i"])


def fill_containers(sizes: DataFrame, capacities: dict[str, int], key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Each document's container, for each kind of container.

    Returns bin_kind, key, part_no, n_tokens (of the part), container_id (from 0 on, per kind).
    A document is split only if it exceeds the capacity: into full containers and one
    rest, which is packed like any other item.  Documents without tokens take no
    room and go to container 0.  Repeated and null keys are items of their own; null sizes count as 0.
    """
    if any(c < 1 for c in capacities.values()):
        raise ValueError("a capacity must be positive")
    names = list(capacities)
    if not names:
        raise ValueError("no kind of container is given")
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(int(capacities[k])).cast("long").alias("capacity")) for i, k in enumerate(names)])
    # settled, so that every reading of it has the same rows in the same parts and order
    whole = settle(sizes.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("all")))
    items = whole.select("key", "all", F.inline(kinds))
    last = F.greatest(F.lit(0), F.floor((F.col("all") - 1) / F.col("capacity"))).cast("int")
    items = items.select("kind", "key", "all", "capacity", F.explode(F.sequence(F.lit(0), last)).alias("part_no"))
    items = items.select("kind", "key", "part_no", F.least(F.col("capacity"), F.col("all") - F.col("part_no") * F.col("capacity")).alias("size"))
    key_type = dict(whole.dtypes)["key"]
    ranked = items.mapInArrow(_ranked, f"kind int, key {key_type}, part_no int, size long, part int, i long")
    counts = ranked.groupBy("kind", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = counts.groupBy("kind", "size").agg(F.sum("n").alias("n"))
    runs = histogram.groupBy("kind").applyInPandas(_sweep([int(capacities[k]) for k in names]), "kind int, size long, `from` long, `to` long, container long, per long")
    before = Window.partitionBy("kind", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # of the runs of a size, each part gets those that its own ranks fall into
    lists = runs.groupBy("kind", "size").agg(F.array_sort(F.collect_list(F.struct("to", "from", "container", "per"))).alias("runs"))
    first, last = F.col("offset"), F.col("offset") + F.col("n") - 1
    mine = offsets.join(lists, ["kind", "size"]).select("kind", "size", "part", "offset", F.filter("runs", lambda r: (r["to"] >= first) & (r["from"] <= last)).alias("runs"))
    placed = ranked.join(mine, ["kind", "size", "part"]).withColumn("rank", F.col("offset") + F.col("i"))
    run = F.element_at(F.filter("runs", lambda r: (r["from"] <= F.col("rank")) & (F.col("rank") <= r["to"])), 1)
    placed = placed.withColumn("run", run)
    container = F.col("run.container") + F.floor((F.col("rank") - F.col("run.from")) / F.col("run.per")).cast("long")
    kind = F.element_at(F.array(*[F.lit(k) for k in names]), F.col("kind") + 1)
    return placed.select(kind.alias("bin_kind"), F.col("key").alias(key), "part_no", F.col("size").alias("n_tokens"), container.alias("container_id"))


def pack_documents(documents: DataFrame, bins: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Containers of every kind in ``bins`` (a table of parameters) for all documents, measured in tokens.

    Token counts are taken once for each tokenizer and settled in the shared folder.
    """
    out = None
    by_tokenizer: dict[str, dict[str, int]] = {}
    for row in bins.collect():
        by_tokenizer.setdefault(row["tokenizer"], {})[row["bin_kind"]] = row["capacity_tokens"]
    for tokenizer, capacities in by_tokenizer.items():
        part = fill_containers(count_tokens(documents, tokenizer, folder), capacities)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no kind of container is given")
    return out


def fill_report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Per kind: items, tokens, containers, the least possible number of containers, and the share of room used."""
    used = packed.groupBy("bin_kind").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("tokens"), (F.max("container_id") + 1).alias("n_containers"))
    capacity = F.create_map(*[x for k, c in capacities.items() for x in (F.lit(k), F.lit(int(c)))])[F.col("bin_kind")]
    return used.select("*", F.ceil(F.col("tokens") / capacity).alias("least_containers"), (F.col("tokens") / (F.col("n_containers") * capacity)).alias("fill"))
