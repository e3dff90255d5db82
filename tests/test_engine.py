import math
import random

import pytest
from pyspark.sql import types as T

from gridloom.engine import Engine
from gridloom.errors import DataSourceError, ExecutionError, PlanError, UnsupportedError
from gridloom.sources.base import InMemorySource, LongTableSource
from gridloom.types import Matcher

S = 10**9


def long(spark, name, labels, rows):
    schema = T.StructType([T.StructField("__name__", T.StringType()), T.StructField("timestamp", T.LongType()), T.StructField("value", T.DoubleType()), *[T.StructField(x, T.StringType()) for x in labels]])
    return spark.createDataFrame([(name, t, None if v is None else float(v), *ls) for t, v, *ls in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def engine(spark):
    counter = [(i * S, 30 * i, "n1", "batch") for i in range(11)] + [(i * S, 12 * i, "n2", "batch") for i in range(11)] + [(i * S, 4 * i, "n3", "ui") for i in range(11)]
    temperature = [7, 3, 9, 4, 4, 8]
    metrics = {
        "load": long(spark, "load", ["instance", "job"], [((i + 1) * S, v, h, "n") for h, vs in (("n1", (11, 13, 17, 19)), ("n2", (23, 29, 31, 37))) for i, v in enumerate(vs)]),
        "frames_total": long(spark, "frames_total", ["instance", "job"], counter),
        "temperature": long(spark, "temperature", ["sensor"], [(i * S, v, "cellar") for i, v in enumerate(temperature)]),
        "resets_total": long(spark, "resets_total", ["instance"], [(i * S, v, "n1") for i, v in enumerate((6, 14, 2, 9, 30))]),
        "cpu": long(spark, "cpu", ["instance"], [(1000 * (i + 1) * S, 3 ** (i + 1), "n1") for i in range(5)]),
        "bent": long(spark, "bent", ["instance"], [(1000 * (i + 1) * S, v, "n1") for i, v in enumerate((1, 2, 4, 8, 16))]),
        "gauge3": long(spark, "gauge3", ["instance"], [(i * S, v, h) for h, vs in (("n1", (4, 8, 12, 16, 20)), ("n2", (20, 16, 12, 8, 4)), ("n3", (5, 9, 17, 13, 21))) for i, v in enumerate(vs)]),
        "metric_a": long(spark, "metric_a", ["instance"], [(5 * S, 90, "n1"), (5 * S, 240, "n2"), (5 * S, 7, "n9")]),
        "metric_b": long(spark, "metric_b", ["instance"], [(5 * S, 6, "n1"), (5 * S, 8, "n2")]),
        "doubled": long(spark, "doubled", ["instance", "k"], [(5 * S, 5, "n1", "x"), (5 * S, 11, "n1", "y")]),
        "strange": long(spark, "strange", ["instance"], [(S, float("nan"), "nan"), (S, float("inf"), "inf"), (S, float("-inf"), "ninf"), (S, 0.0, "zero"), (S, -1.5, "minus"), (S, 2.5, "plus"), (S, None, "null")]),
        "labelled": long(spark, "labelled", ["instance", "job", "t", "k"], [(S, 1, "n1.west.test:71", "scribe", "u", None), (S, 2, "n2.east.test:72", "ledger", "v", "w")]),
        "dated": long(spark, "dated", ["instance"], [(1_709_248_025 * S, 100, "n1"), (1_709_248_025 * S, 200, "n2")]),
        "empty": long(spark, "empty", ["instance"], []),
    }
    return Engine(InMemorySource(spark, metrics))


def instant(engine, query, t):
    return {tuple(sorted((k, v) for k, v in s.labels.items() if k != "__name__")): s.value for s in engine.instant_query(query, t).samples}


def by(label, result):
    return {dict(k).get(label, ""): v for k, v in result.items()}


def test_selector_and_lookback(engine):
    v = engine.instant_query("load", int(3.5 * S)).samples
    assert {(s.labels["instance"], s.value, s.timestamp_ns) for s in v} == {("n1", 17.0, 3500000000), ("n2", 31.0, 3500000000)}
    assert len(instant(engine, "load", 304 * S)) == 2 and instant(engine, "load", 305 * S) == {}
    assert by("instance", instant(engine, "cpu offset 2000s", 5000 * S)) == {"n1": 27}
    assert instant(engine, "cpu offset 10000s", 5000 * S) == {} and instant(engine, "empty", S) == {}
    m = engine.range_query("cpu offset 1000s", 3000 * S, 5000 * S, 1000 * S)
    assert [(s.timestamp_ns, s.value) for s in m.series[0].samples] == [(3000 * S, 9), (4000 * S, 27), (5000 * S, 81)]
    assert engine.range_query("cpu", 2 * S, S, S).series == []


def test_matchers(engine):
    pick = lambda m: set(by("instance", instant(engine, f"load{{{m}}}", 3 * S)))
    assert pick('instance="n1"') == {"n1"} and pick('instance!="n1"') == {"n2"}
    assert pick('instance=~"n1|x"') == {"n1"} and pick('instance=~"n"') == set() and pick('instance!~".*1"') == {"n2"}
    assert pick('absent=""') == {"n1", "n2"} and pick('absent!=""') == set()
    assert by("k", instant(engine, 'labelled{k=""}', S)) == {"": 1}


def test_range_functions(engine):
    at = lambda q, t: list(instant(engine, q, t).values())
    assert sorted(at("rate(frames_total[5s])", 10 * S)) == [4, 12, 30]
    assert at("delta(temperature[3s])", 3 * S) == [-3] and at("idelta(temperature[3s])", 3 * S) == [-5]
    assert at("rate(resets_total[5s])", 4 * S) == [9.5] and at("increase(resets_total[5s])", 4 * S) == [38] and at("irate(resets_total[5s])", 3 * S) == [7]
    assert at("rate(cpu[2000s] offset 1000s)", 5000 * S) == [0.036]
    assert at("delta(bent[2000s] offset 1000s)", 5000 * S) == [6] and at("delta(bent[2000s])", 5000 * S) == [12]
    m = engine.range_query("increase(frames_total{job='batch'}[5s])", 5 * S, 10 * S, 5 * S)
    assert [[x.value for x in s.samples] for s in m.series] == [[150, 150], [60, 60]]
    assert at("rate(temperature[500ms])", 3 * S) == []


def test_random_windows_against_plain_python(spark):
    rng = random.Random(5)
    rows, series = [], {}
    for s in range(6):
        t, pts = rng.randrange(-50, 50), []
        for _ in range(rng.choice([0, 1, 3, 40, 90])):
            t += rng.choice([1, 2, 7, 40])
            pts.append((t, float(rng.randrange(0, 30))))
        series[f"s{s}"] = pts
        rows += [(a, v, f"s{s}") for a, v in pts]
    engine = Engine(InMemorySource(spark, {"m": long(spark, "m", ["x"], rows)}), lookback_ns=13)
    for start, end, step, width, offset in [(0, 400, 10, 25, 0), (3, 401, 7, 40, 9), (-20, 300, 50, 11, -15)]:
        grid = range(start, end + 1, step)
        suffix = f" offset {'-' if offset < 0 else ''}{abs(offset)}ms" if offset else ""
        scaled = Engine(InMemorySource(spark, {"m": long(spark, "m", ["x"], [(a * 10**6, v, x) for a, v, x in rows])}), lookback_ns=13 * 10**6)
        run = lambda q: {(s.labels["x"], p.timestamp_ns // 10**6): p.value for s in scaled.range_query(q, start * 10**6, end * 10**6, step * 10**6).series for p in s.samples}
        want = {}
        for x, pts in series.items():
            for t in grid:
                near = [v for a, v in pts if t - 13 <= a + offset <= t]
                if near:
                    want[x, t] = near[-1]
        assert run(f"m{suffix}") == want
        for name in ("rate", "increase", "irate", "delta", "idelta"):
            want = {}
            for x, pts in series.items():
                for t in grid:
                    w = [(a, v) for a, v in pts if t - width <= a + offset <= t]
                    if len(w) < 2:
                        continue
                    gain = lambda a, b: b[1] - a[1] if b[1] >= a[1] else b[1]
                    total = sum(gain(a, b) for a, b in zip(w, w[1:]))
                    want[x, t] = {"increase": total, "rate": total / ((w[-1][0] - w[0][0]) / 1e3), "irate": gain(w[-2], w[-1]) / ((w[-1][0] - w[-2][0]) / 1e3), "delta": w[-1][1] - w[0][1], "idelta": w[-1][1] - w[-2][1]}[name]
            got = run(f"{name}(m[{width}ms]{suffix})")
            assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want), name
    assert engine.lookback_ns == 13


def test_ieee(engine):
    f = lambda q: by("instance", instant(engine, q, S))
    r = f("strange / 0")
    assert math.isnan(r["zero"]) and r["plus"] == math.inf and r["minus"] == -math.inf and math.isnan(r["nan"]) and "null" not in r
    assert math.isnan(f("strange % 0")["plus"]) and f("strange % 2")["plus"] == 0.5
    assert f("ln(strange)")["zero"] == -math.inf and math.isnan(f("ln(strange)")["minus"])
    assert f("ceil(strange)")["plus"] == 3 and math.isnan(f("ceil(strange)")["nan"]) and f("floor(strange)")["inf"] == math.inf
    assert f("round(strange)")["minus"] == -1 and f("round(strange, 0)")["plus"] == 2.5
    assert f("sgn(strange)")["minus"] == -1 and math.isnan(f("sqrt(strange)")["minus"])
    assert f("clamp_max(strange, 1)")["nan"] == 1 and f("clamp_min(strange, 1)")["nan"] == 1 and math.isnan(f("clamp(strange, 0, 1)")["nan"]) and math.isnan(f("clamp(strange, 2, 1)")["plus"])
    assert set(f("strange > 1")) == {"inf", "plus"} and set(f("strange == strange")) == {"inf", "ninf", "zero", "minus", "plus"} and "nan" in f("strange != strange")
    assert f("strange > bool 1")["nan"] == 0 and f("1 ^ strange")["nan"] == 1 and f("(-1) ^ strange")["inf"] == 1
    assert f("5 < strange") == {"inf": 5}


def test_aggregations(engine):
    at = lambda q, t=2 * S: instant(engine, q, t)
    assert by("job", at("sum(rate(frames_total[5s])) by (job)", 10 * S)) == {"ui": 4, "batch": 42}
    assert at("avg(gauge3)") == {(): 41 / 3} and at("count(gauge3)") == {(): 3} and at("group(gauge3)") == {(): 1} and at("quantile(0.5, gauge3)") == {(): 12}
    assert at("quantile(2, gauge3)") == {(): math.inf} and at("quantile(-1, gauge3)") == {(): -math.inf}
    assert by("v", at('count_values("v", gauge3)')) == {"12.0": 2, "17.0": 1}
    assert by("instance", at("topk(1, gauge3)")) == {"n3": 17} and len(at("bottomk(2, gauge3)")) == 2 and at("topk(0, gauge3)") == {}
    assert len(at("limitk(2, gauge3)")) == 2 and len(at("limit_ratio(0.5, gauge3)")) == 2 and len(at("limit_ratio(-0.5, gauge3)")) == 1
    assert set(at("limit_ratio(0.5, gauge3)")) | set(at("limit_ratio(-0.5, gauge3)")) == set(at("gauge3"))
    assert at("sum(empty)") == {} and at("stdvar(gauge3)")[()] == pytest.approx(50 / 9)
    assert set(by("job", at("sum without (instance) (frames_total)"))) == {"batch", "ui"}


def test_binary(engine):
    at = lambda q: by("instance", instant(engine, q, 5 * S))
    assert at("metric_a / on(instance) metric_b") == {"n1": 15, "n2": 30} and at("metric_a + metric_b") == {"n1": 96, "n2": 248}
    assert at("metric_a > 100") == {"n2": 240} and at("-metric_b") == {"n1": -6, "n2": -8}
    assert at("metric_a and metric_b") == {"n1": 90, "n2": 240} and at("metric_a unless metric_b") == {"n9": 7}
    assert at("metric_b or metric_a") == {"n1": 6, "n2": 8, "n9": 7}
    assert at("metric_a * on(instance) doubled") == {"n1": 990}
    left = instant(engine, "doubled * on(instance) group_left metric_a", 5 * S)
    assert by("k", left) == {"x": 450, "y": 990}
    right = instant(engine, "metric_a - on(instance) group_right doubled", 5 * S)
    assert by("k", right) == {"x": 85, "y": 79}
    copied = instant(engine, "metric_a * on(instance) group_left(k) doubled{k='x'}", 5 * S)
    assert copied == {(("instance", "n1"), ("k", "x")): 450}
    assert instant(engine, "sum(metric_a) + on() sum(metric_b)", 5 * S) == {(): 351}
    assert at("metric_a + ignoring(k) doubled") == {"n1": 101}
    with pytest.raises(ExecutionError):
        Engine(engine.source, strict=True).instant_query("metric_a * on(instance) doubled", 5 * S)


def test_labels_sorts_and_times(engine):
    at = lambda q, t=S: instant(engine, q, t)
    assert set(by("node", at('label_replace(labelled, "node", "$1", "instance", "([^.]+)\\\\..*")'))) == {"n1", "n2"}
    assert set(by("x", at('label_replace(labelled, "x", "$2|$$1|$9", "job", "(l)(e)?.*")'))) == {"", "e|$l|"}
    assert set(by("job", at('label_replace(labelled, "job", "new", "nothing", "")'))) == {"new"}
    assert set(by("r", at('label_join(labelled, "r", "-", "job", "nonexistent")'))) == {"ledger-", "scribe-"}
    assert set(by("r", at('label_join(labelled, "r", "-", "job", "t", "k")'))) == {"scribe-u-", "ledger-v-w"}
    order = lambda q: [s.value for s in engine.instant_query(q, 2 * S).samples]
    assert order("sort(gauge3)") == [12, 12, 17] and order("sort_desc(gauge3)") == [17, 12, 12]
    names = lambda q: [s.labels["instance"] for s in engine.instant_query(q, 2 * S).samples]
    assert names('sort_by_label(gauge3, "instance")') == ["n1", "n2", "n3"] and names('sort_by_label_desc(gauge3, "instance")') == ["n3", "n2", "n1"]
    t = 1_709_248_025 * S
    want = {"year": 2024, "month": 2, "day_of_month": 29, "day_of_week": 4, "day_of_year": 60, "days_in_month": 29, "hour": 23, "minute": 7, "timestamp": 1709248025}
    for name, value in want.items():
        assert set(at(f"{name}(dated)", t).values()) == {value} and at(f"{name}()", t) == {(): value}
    assert [p.value for p in engine.range_query("time()", 0, 30 * S, 15 * S).series[0].samples] == [0, 15, 30]


def test_names_are_kept_or_dropped(engine):
    name = lambda q: {s.labels.get("__name__") for s in engine.instant_query(q, 4 * S).samples}
    for q in ("gauge3", "rate(gauge3[3s])", "topk(1, gauge3)", 'label_join(gauge3, "a", "", "instance")', "sort(gauge3)", "gauge3 and gauge3"):
        assert name(q) == {"gauge3"}, q
    for q in ("abs(gauge3)", "gauge3 > 1", "gauge3 + gauge3", "-gauge3", "sum by (__name__) (gauge3)", "hour(gauge3)"):
        assert name(q) == {None}, q


def test_errors(engine):
    for query, kind in [
        ("cpu[5s]", PlanError), ("rate(cpu)", PlanError), ("5", UnsupportedError), ('"x"', UnsupportedError), ("nothing", DataSourceError), ("foo(cpu)", UnsupportedError), ("abs()", PlanError), ("time(cpu)", PlanError),
        ("sort_by_label(cpu)", PlanError), ("clamp(cpu, 1)", PlanError), ("clamp(cpu, cpu, cpu)", UnsupportedError), ("rate(cpu[1m:])", PlanError), ("cpu[1m:1s]", UnsupportedError), ('{job="x"}', PlanError),
        ('label_replace(cpu, "a", "b", "c", "(")', PlanError), ('label_join(cpu, "a", "b")', PlanError), ("topk(cpu, cpu)", PlanError), ("1 + 2", UnsupportedError), ("cpu atan2 cpu", UnsupportedError),
    ]:
        with pytest.raises(kind):
            engine.instant_query(query, S)
    with pytest.raises(PlanError):
        engine.range_query("cpu", 0, S, 0)


def test_long_table(spark):
    df = long(spark, "a", ["x", "__g_k"], [(S, 1, "u", "q"), (S, 2, "v", None)]).unionByName(long(spark, "b", ["x", "__g_k"], [(S, 5, None, None)]))
    source = LongTableSource(df)
    assert [(m.name, m.label_names) for m in source.list_metrics()] == [("a", ("x", "__g_k")), ("b", ())]
    assert [m.name for m in source.list_metrics(Matcher("__name__", "=~", "b|c"))] == ["b"]
    assert {s.value for s in Engine(source).instant_query("a", S).samples} == {1, 2}
    assert Engine(source).instant_query("zzz", S).samples == []


def test_label_matchers_reach_the_scan(spark, tmp_path):
    long(spark, "a", ["x", "y"], [(S, 1, "u", "q"), (S, 2, "v", None), (S, 3, None, "r"), (S, 4, "", "s")]).write.parquet(str(tmp_path / "long"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    engine = Engine(LongTableSource(spark.read.parquet(str(tmp_path / "long"))))
    for matchers, filters, values in [
        ('x="u"', ["EqualTo(x,u)"], {1}), ('x=~"u|v"', ["In(x, [u,v])"], {1, 2}), ('x!="u"', ["Not(EqualTo(x,u))", "IsNull(x)"], {2, 3, 4}), ('x=""', ["EqualTo(x,)", "IsNull(x)"], {3, 4}),
        ('x!=""', ["Not(EqualTo(x,))"], {1, 2}), ('y!~"q|r"', ["IsNull(y)", "Not(In(y, [q,r]))"], {2, 4}), ('x=~"u?"', [], {1, 3, 4}), ('x!~".+"', [], {3, 4}), ('z=""', [], {1, 2, 3, 4}), ('z="1"', [], set()),
    ]:
        df = engine.instant_df(f"a{{{matchers}}}", S)
        assert {r["value"] for r in df.collect()} == values, matchers
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert all(f in plan.partition("PushedFilters")[2] for f in filters), (matchers, plan)


def test_counters_with_nan(spark):
    engine = Engine(InMemorySource(spark, {"m": long(spark, "m", ["x"], [(S, 5, "a"), (2 * S, float("nan"), "a"), (3 * S, 9, "a"), (4 * S, 11, "a")])}))
    # after NaN a counter starts anew
    assert instant(engine, "irate(m[2s])", 4 * S) == {(("x", "a"),): 2} and instant(engine, "increase(m[1s])", 3 * S) == {(("x", "a"),): 9}


def test_a_query_step_by_step(engine):
    frame = engine.range_frame("sum by (job) (frames_total)", 5 * S, 6 * S, S)
    plans = engine.plans(frame)
    assert set(plans) == {"logical", "optimized", "physical"} and "Aggregate" in plans["logical"] and "HashAggregate" in plans["physical"]
    rows = engine.execute(frame)
    assert engine.matrix(frame, rows) == engine.range_query("sum by (job) (frames_total)", 5 * S, 6 * S, S)
    assert {s.labels["job"]: s.value for s in engine.vector(frame, [r for r in rows if r["timestamp"] == 6 * S]).samples} == {"batch": 252, "ui": 24}
