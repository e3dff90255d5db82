import math
import os
import random

import numpy as np
import pytest

from gridloom.llm import percentiles
from gridloom.llm.percentiles import choose_pivots, combine_summaries, equi_rank_summary, grouped_percentiles, proposals_of, rank_of, thinned


def test_percentiles_against_sorting(spark):
    rng = random.Random(3)
    rows = []
    for g, n in (("hot", 3000), ("b", 700), ("one", 1), (None, 30)):
        for _ in range(n):
            rows.append((g, rng.choice("xy"), rng.choice([rng.gauss(0, 1), 7.0, 7.0, None, float("nan"), math.inf]), "clash", 1))
    rows.append(("void", "x", None, "clash", 1))
    df = spark.createDataFrame(rows, "v string, part string, run double, kind string, n long").repartition(5)
    probs = [0.0, 0.01, 0.5, 0.9, 1.0]
    want = {}
    for kind, key in ((0, lambda r: (r[0], None)), (1, lambda r: (r[0], r[1])), (2, lambda r: (None, None))):
        groups = {}
        for r in rows:
            if r[2] is not None and not math.isnan(r[2]):
                groups.setdefault(key(r), []).append(r[2])
        for (a, b), vs in groups.items():
            vs.sort()
            for q in probs:
                want[kind, a, b, q] = (len(vs), vs[max(1, min(len(vs), math.ceil(round(q * len(vs), 9)))) - 1])
    for pieces in (1, 8, 256):
        got = {(r["kind"], r["v"], r["part"], r["q"]): (r["n"], r["value"]) for r in grouped_percentiles(df, [["v"], ["part", "v"], []], probs, "run", pieces=pieces).collect()}
        assert got == want
    assert grouped_percentiles(df.limit(0), [["v"]], probs, "run").count() == 0


def test_summaries_combine_within_the_stated_error(spark):
    rng = random.Random(4)
    rows = [("a" if rng.random() < 0.7 else "b", str(d), rng.lognormvariate(d, 1)) for d in range(4) for _ in range(800)]
    df = spark.createDataFrame(rows, "name string, day string, value double")
    daily = equi_rank_summary(df, ["name", "day"], 40)
    for r in combine_summaries(daily, ["name"], [0.1, 0.5, 0.95]).collect():
        vs = sorted(v for n, _, v in rows if n == r["name"])
        assert r["n"] == len(vs) and r["rank_error"] <= len(vs) / 40 + 6
        assert abs(vs.index(r["value"]) + 1 - r["q"] * len(vs)) <= r["rank_error"]


def test_every_group_takes_several_rounds(spark, monkeypatch):
    """With short chunks and few pieces no group is done in the first round, and all checkpoints but those the result reads are gone."""
    rng = random.Random(5)
    rows = [(g, rng.gauss(0, 1)) for g in "abc" for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    rounds = []
    real = percentiles.settle
    monkeypatch.setattr(percentiles, "settle", lambda d: (rounds.append(d.columns), real(d))[1])
    monkeypatch.setattr(percentiles, "UPPER_PIECES", 16)
    got = {(r["g"], r["q"]): r["value"] for r in grouped_percentiles(df, [["g"]], [0.07, 0.5], "x", pieces=8).collect()}
    assert sum("below" in c for c in rounds) >= 2
    for g in "abc":
        vs = sorted(x for k, x in rows if k == g)
        assert got[g, 0.07] == vs[279] and got[g, 0.5] == vs[1999]


def test_the_error_bound_of_thinned_proposals_holds():
    rng = np.random.default_rng(6)
    for _ in range(30):
        parts = [np.sort(rng.choice([rng.normal(size=500), rng.integers(0, 9, 500).astype(float)])[: rng.integers(1, 500)]) for _ in range(rng.integers(1, 12))]
        lists = [proposals_of(p, 8) for p in parts]
        m, w, e = thinned(np.concatenate([x[0] for x in lists]), np.concatenate([x[1] for x in lists]), sum(x[2] for x in lists), 16)
        values = np.sort(np.concatenate(parts))
        assert w.sum() == len(values) and len(m) <= max(16, len(lists[0][0]))
        for x in m:
            assert abs(int(w[m <= x].sum()) - int((values <= x).sum())) <= e
        for rank in {1, len(values), len(values) // 2 + 1}:
            chosen, lo, hi = choose_pivots(m, w, e, rank)
            assert (lo is None or lo <= values[rank - 1]) and (hi is None or hi >= values[rank - 1]) and {lo, hi} - {None} <= set(chosen)


def test_ranks_are_exact_at_any_size():
    assert rank_of(0.07, 9_734_898_200) == 681_442_874 and rank_of(0.07, 10**13) == 7 * 10**11 and rank_of(0.0, 5) == 1 and rank_of(1.0, 5) == 5
    rng = random.Random(7)
    for _ in range(2000):
        n = rng.randrange(10**9, 10**13)
        assert rank_of(0.07, n) == -(-7 * n // 100)


def test_groups_with_odd_names(spark):
    rows = [(k, float(i)) for k in (None, "", "a,b", 'x"y', "null", "ü\n") for i in range(5)]
    got = {r["__name__"]: r["value"] for r in grouped_percentiles(spark.createDataFrame(rows, "`__name__` string, value double"), [["__name__"]], [0.5]).collect()}
    assert got == {k: 2.0 for k, _ in rows}
    with pytest.raises(ValueError):
        grouped_percentiles(spark.createDataFrame(rows, "k string, value double"), [["k"]], [])


def test_checkpoints_are_removed(spark):
    def files() -> int:
        return sum(len(f) for _, _, f in os.walk(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")))

    df = spark.range(20_000).selectExpr("cast(rand(1) as double) AS value")
    before = files()
    grouped_percentiles(df, [[]], [0.5], pieces=4).collect()
    assert files() - before < 40
