import random
from collections import Counter, defaultdict

import pytest

from gridloom.llm.packing import best_fit_runs, fill_containers, fill_report


def plain_best_fit(sizes, capacity):
    """Best-fit decreasing, one item at a time."""
    gaps = []
    for s in sorted((s for s in sizes if s), reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return gaps


@pytest.mark.parametrize("seed", range(30))
def test_runs_equal_plain_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 50, 1000])
    sizes = [min(capacity, int(rng.paretovariate(0.7))) if rng.random() < 0.9 else 0 for _ in range(rng.choice([0, 1, 40, 400]))]
    hist = Counter(sizes)
    used, placed = defaultdict(int), Counter()
    for size, first, last, container, per in best_fit_runs(list(hist), list(hist.values()), capacity):
        for rank in range(first, last + 1):
            used[container + (rank - first) // per] += size
            placed[size, rank] += 1
    assert placed == Counter({(s, r): 1 for s, n in hist.items() for r in range(n)})
    assert all(u <= capacity for u in used.values())
    gaps = plain_best_fit(sizes, capacity)
    if any(sizes):
        assert sorted(used) == list(range(len(used))) and sorted(capacity - u for u in used.values()) == sorted(gaps)


def test_documents(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([0, None, 5, 5, 5, 33, 100, 101, 250, rng.randrange(1, 100)]), "c", "r") for k in range(3000)] + [(None, 7, "c", "r")] * 3
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, kind string, rank string")
    capacities = {"small": 100, "large": 777}
    out = fill_containers(df, capacities).cache()
    for kind, capacity in capacities.items():
        mine = [r for r in out.collect() if r["bin_kind"] == kind]
        load, parts = Counter(), defaultdict(list)
        for r in mine:
            load[r["container_id"]] += r["n_tokens"]
            parts[r["doc_id"]].append((r["part_no"], r["n_tokens"]))
        assert max(load.values()) <= capacity
        for k, n, *_ in rows[:3000]:
            n = n or 0
            assert sum(t for _, t in parts[k]) == n and len(parts[k]) == max(1, -(-n // capacity))
            assert all(t == capacity for p, t in parts[k] if p < len(parts[k]) - 1)
        assert len(parts[None]) == 3
        assert sum(load.values()) / (capacity * len(load)) > 0.97
    report = {r["bin_kind"]: r for r in fill_report(out, capacities).collect()}
    assert report["small"]["n_containers"] >= report["small"]["least_containers"] > 0
    assert fill_containers(df.limit(0), capacities).count() == 0
    with pytest.raises(ValueError):
        fill_containers(df, {"none": 0})
