"""From a syntax tree to a DataFrame.

Every node becomes a :class:`SeriesFrame`; Catalyst optimizes the whole.  Scans get the label matchers and the time
range they need, so both reach the Parquet reader.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.errors import PlanError, UnsupportedError
from gridloom.functions import ieee
from gridloom.functions.pointwise import MATH, TIME, anchored, label_join, label_replace
from gridloom.lang.nodes import Aggregate, Binary, Call, Matching, Negation, Node, Number, Paren, Selector, String, Subquery
from gridloom.lang.parser import COMPARISONS, SET_OPERATORS
from gridloom.plans.frame import Grid, SeriesFrame, q
from gridloom.plans.windows import RANGE_FUNCTIONS, align, range_function, time_series
from gridloom.sources.base import MetricSource
from gridloom.types import METRIC_NAME, Matcher, TimeRange

SORTS = {"sort": False, "sort_desc": True, "sort_by_label": False, "sort_by_label_desc": True}
SIMPLE = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_pop, "stdvar": F.var_pop}
_MOST = 2**63 - 1


def strip(node: Node) -> Node:
    """A node without its parentheses, with arithmetic between numbers done."""
    while isinstance(node, Paren):
        node = node.expr
    if isinstance(node, Negation) and isinstance(inner := strip(node.expr), Number):
        return Number(-inner.value)
    if isinstance(node, Binary) and node.op not in SET_OPERATORS and node.op != "atan2":
        a, b = strip(node.left), strip(node.right)
        if isinstance(a, Number) and isinstance(b, Number):
            return Number(ieee.fold(node.op, a.value, b.value))
    return node


@dataclass
class Planner:
    source: MetricSource
    grid: Grid
    lookback_ns: int
    strict: bool = False

    def plan(self, node: Node) -> SeriesFrame:
        node = strip(node)
        match node:
            case Selector(range_ns=None):
                return align(*self.samples(node, self.lookback_ns), self.grid, self.lookback_ns)
            case Selector():
                raise PlanError("a range vector must be the argument of a range function")
            case Number() | String():
                raise UnsupportedError("a query that is a number or a string")
            case Call():
                return self.call(node)
            case Aggregate():
                return self.aggregate(node)
            case Negation():
                v = self.plan(node.expr)
                return v.with_value(F.lit(-1.0) * F.col("value"), v.kept)
            case Binary():
                return self.binary(node)
            case Subquery():
                raise UnsupportedError("subqueries")
        raise UnsupportedError(type(node).__name__)

    # -- selectors

    def samples(self, node: Selector, width: int) -> tuple[DataFrame, list[str]]:
        """The samples a selector may need, shifted by its offset, and its labels."""
        name, matchers = node.name, list(node.matchers)
        if name is None:
            equal = [m for m in matchers if m.label == METRIC_NAME and m.op == "=" and m.value]
            if not equal:
                raise PlanError("a selector needs a metric name")
            name = equal[0].value
        span = TimeRange(max(self.grid.start - width - node.offset_ns, -_MOST), min(max(self.grid.end, self.grid.start) - node.offset_ns, _MOST))
        df = self.source.table_for_metric(name, matchers, span)
        labels = [c for c in df.columns if c not in ("timestamp", "value")]
        time, value = q("timestamp").cast("long"), q("value").cast("double")
        df = df.where(time.between(span.start_ns, span.end_ns) & value.isNotNull())
        if METRIC_NAME in labels:
            df = df.where(q(METRIC_NAME) == name)
        for m in matchers:
            if m.label in labels:
                df = df.where(self.matcher(m, q(m.label)))
            elif not m.matches(name if m.label == METRIC_NAME else ""):
                df = df.where(F.lit(False))
        out = df.select((time + F.lit(node.offset_ns)).alias("timestamp"), *[F.coalesce(q(x), F.lit("")).alias(x) for x in labels], value.alias("value"))
        return out, labels

    @staticmethod
    def matcher(m: Matcher, label: Column) -> Column:
        """A matcher on a label column in which null stands for '' too, on the plain column, so that scans can use it."""
        if m.op in ("=", "!="):
            hit = (label == m.value) if m.op == "=" else (label != m.value)
        else:
            parts = m.value.split("|")
            plain = all(p.replace("_", "").replace("-", "").isalnum() for p in parts)  # alternatives without any special character
            hit = label.isin(parts) if plain else label.rlike(anchored(m.value))
            hit = hit if m.op == "=~" else ~hit
        return hit | label.isNull() if m.matches("") else hit

    # -- functions

    def call(self, node: Call) -> SeriesFrame:
        name, args = node.name, [strip(a) for a in node.args]
        if name in RANGE_FUNCTIONS:
            if len(args) != 1 or not isinstance(args[0], Selector) or args[0].range_ns is None:
                raise PlanError(f"{name} needs one range vector")
            df, labels = self.samples(args[0], args[0].range_ns)
            return range_function(name, df, labels, self.grid, args[0].range_ns)
        if name in MATH:
            return self.pointwise(name, args)
        if name in TIME:
            return self.time(name, args)
        if name in SORTS:
            return self.sort(name, args)
        if name in ("label_replace", "label_join"):
            return self.relabel(name, args)
        raise UnsupportedError(f"function {name!r}")

    def pointwise(self, name: str, args: list[Node]) -> SeriesFrame:
        build, least, most = MATH[name]
        if not args:
            raise PlanError(f"{name} needs an instant vector")
        if not all(isinstance(a, Number) for a in args[1:]):
            raise UnsupportedError(f"{name} with other than literal arguments")
        if not least <= len(args) - 1 <= most:
            raise PlanError(f"wrong number of arguments for {name}")
        v = self.plan(args[0])
        return v.with_value(build(F.col("value"), *[a.value for a in args[1:]]), v.kept)

    def time(self, name: str, args: list[Node]) -> SeriesFrame:
        if len(args) > (name != "time"):
            raise PlanError(f"wrong number of arguments for {name}")
        v = self.plan(args[0]) if args else SeriesFrame(time_series(self.source.spark, self.grid), [])
        return v.with_value(TIME[name](F.col("timestamp")).cast("double"), v.kept)

    def sort(self, name: str, args: list[Node]) -> SeriesFrame:
        if not args:
            raise PlanError(f"{name} needs an instant vector")
        v, down = self.plan(args[0]), SORTS[name]
        if "label" in name:
            if len(args) < 2 or not all(isinstance(a, String) for a in args[1:]):
                raise PlanError(f"{name} needs label names")
            keys = [v.label(a.value) for a in args[1:]]
            order = [k.desc() if down else k.asc() for k in keys]
        else:
            if len(args) != 1:
                raise PlanError(f"wrong number of arguments for {name}")
            order = [F.col("value").desc_nulls_last() if down else F.col("value").asc_nulls_last()]
        return SeriesFrame(v.df.orderBy(*order), v.labels)

    def relabel(self, name: str, args: list[Node]) -> SeriesFrame:
        texts = [a.value for a in args[1:] if isinstance(a, String)]
        if len(texts) != len(args) - 1 or (len(args) != 5 if name == "label_replace" else len(args) < 4):
            raise PlanError(f"wrong arguments for {name}")
        v = self.plan(args[0])
        target = texts[0]
        if name == "label_replace":
            _, replacement, origin, pattern = texts
            new = label_replace(v.label(origin), v.label(target), replacement, pattern)
        else:
            new = label_join(texts[1], [v.label(x) for x in texts[2:]])
        labels = v.labels if target in v.labels else [*v.labels, target]
        return SeriesFrame(v.df.select("timestamp", *[new.alias(x) if x == target else q(x) for x in labels], "value"), labels)

    # -- aggregations

    def aggregate(self, node: Aggregate) -> SeriesFrame:
        param = strip(node.param) if node.param is not None else None
        wanted = String if node.op == "count_values" else Number
        if node.param is not None and not isinstance(param, wanted):
            raise PlanError(f"the parameter of {node.op} must be a literal")
        v = self.plan(node.expr)
        if node.by is None:
            group = []
        elif node.by:
            group = [x for x in dict.fromkeys(node.labels) if x in v.kept]
        else:
            group = [x for x in v.kept if x not in node.labels]
        keys, value = ["timestamp", *[q(x) for x in group]], F.col("value")
        if node.op in ("topk", "bottomk", "limitk"):
            k = 0 if math.isnan(param.value) else int(max(min(param.value, 2**31 - 1), -1))
            tie = [q(x) for x in v.labels]
            order = tie if node.op == "limitk" else [value.desc_nulls_last() if node.op == "topk" else value.asc_nulls_last(), *tie]
            ranked = v.df.withColumn("__g_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order or [value])))
            return SeriesFrame(ranked.where(F.col("__g_r") <= k).drop("__g_r"), v.labels)
        if node.op == "limit_ratio":
            return self.limit_ratio(v, keys, param.value)
        if node.op == "count_values":
            target = param.value
            kept = [x for x in group if x != target]
            text = v.df.select("timestamp", *[q(x) for x in kept], value.cast("string").alias("__g_v"))
            out = text.groupBy("timestamp", *[q(x) for x in kept], "__g_v").agg(F.count(F.lit(1)).cast("double").alias("value"))
            return SeriesFrame(out.select("timestamp", *[q(x) for x in kept], F.col("__g_v").alias(target), "value"), [*kept, target])
        if node.op == "quantile":
            phi = param.value
            if not 0 <= phi <= 1:
                result = F.min(F.lit(ieee.NAN if math.isnan(phi) else math.copysign(ieee.INF, phi - 0.5)))
            else:
                result = F.percentile(value, F.lit(phi))
        elif node.op in SIMPLE:
            result = SIMPLE[node.op](value)
        elif node.op == "count":
            result = F.count(value).cast("double")
        else:
            result = F.max(F.lit(1.0))
        return SeriesFrame(v.df.groupBy(*keys).agg(result.alias("value")).select("timestamp", *[q(x) for x in group], "value"), group)

    @staticmethod
    def limit_ratio(v: SeriesFrame, keys: list, ratio: float) -> SeriesFrame:
        """The first ceil(ratio * count) series by labels; of a negative ratio the complement of the first ceil((1 + ratio) * count)."""
        ratio = max(min(ratio, 1.0), -1.0)
        over = Window.partitionBy(*keys)
        ranked = v.df.withColumn("__g_r", F.row_number().over(over.orderBy(*[q(x) for x in v.labels] or [F.col("value")]))).withColumn("__g_n", F.count(F.lit(1)).over(over))
        # a tolerance for the rounding of the product
        edge = F.ceil(F.col("__g_n") * F.lit(ratio if ratio >= 0 else 1 + ratio) - F.lit(1e-9))
        hit = F.col("__g_r") <= edge
        return SeriesFrame(ranked.where(hit if ratio >= 0 else ~hit).drop("__g_r", "__g_n"), v.labels)

    # -- binary operators

    def binary(self, node: Binary) -> SeriesFrame:
        left, right = strip(node.left), strip(node.right)
        if node.op == "atan2":
            raise UnsupportedError("atan2")
        if isinstance(left, Number) or isinstance(right, Number):
            if node.op in SET_OPERATORS or (isinstance(left, Number) and isinstance(right, Number)):
                raise UnsupportedError(f"{node.op} between scalars")
            v = self.plan(right if isinstance(left, Number) else left)
            number, value = F.lit(float(left.value if isinstance(left, Number) else right.value)), F.col("value")
            a, b = (number, value) if isinstance(left, Number) else (value, number)
            return self.combined(node, v.df, a, b, [(x, q(x)) for x in v.kept])
        lv, rv = self.plan(left), self.plan(right)
        return self.set_operation(node, lv, rv) if node.op in SET_OPERATORS else self.join(node, lv, rv)

    @staticmethod
    def combined(node: Binary, df: DataFrame, a: Column, b: Column, labels: list[tuple[str, Column]]) -> SeriesFrame:
        """The result of the operator on two columns; a comparison keeps the left one where it holds."""
        if node.op in COMPARISONS:
            holds = ieee.compare(node.op, a, b)
            if node.bool_modifier:
                result = F.when(holds, F.lit(1.0)).otherwise(F.lit(0.0))
            else:
                df, result = df.where(holds), a
        else:
            result = ieee.ARITHMETIC[node.op](a, b)
        return SeriesFrame(df.select("timestamp", *[c.alias(x) for x, c in labels], result.alias("value")), [x for x, _ in labels])

    @staticmethod
    def match_labels(m: Matching, left: SeriesFrame, right: SeriesFrame) -> list[str]:
        """The labels two series must share: absent ones count as ''."""
        if m.on:
            return list(dict.fromkeys(m.labels))
        every = dict.fromkeys([*left.kept, *right.kept])
        return [x for x in every if m.on is None or x not in m.labels]

    def join(self, node: Binary, left: SeriesFrame, right: SeriesFrame) -> SeriesFrame:
        """Vector with vector: one side has one series per match key and time (of several the greatest value, unless strict)."""
        m = node.matching
        keys = self.match_labels(m, left, right)
        flipped = m.group == "right"
        many, one = (right, left) if flipped else (left, right)
        include = [x for x in m.include if x not in keys] if m.group else []
        names = [f"__g_m{i}" for i in range(len(keys))]
        lone = one.df.select(F.col("timestamp").alias("__g_t"), *[one.label(x).alias(n) for x, n in zip(keys, names, strict=True)], *[one.label(x).alias(f"__g_i{i}") for i, x in enumerate(include)], F.struct("value", *[q(x) for x in one.labels]).alias("__g_o"))
        picked = [F.max_by(F.col(f"__g_i{i}"), F.col("__g_o")).alias(f"__g_i{i}") for i in range(len(include))]
        best = lone.groupBy("__g_t", *names).agg(F.max("__g_o")["value"].alias("__g_v"), F.count(F.lit(1)).alias("__g_c"), *picked)
        if self.strict:
            best = best.withColumn("__g_v", F.when(F.col("__g_c") > 1, F.raise_error(F.lit("several series match on the one side"))).otherwise(F.col("__g_v")))
        side = many.df.select("*", *[many.label(x).alias(f"__g_l{i}") for i, x in enumerate(keys)])
        condition = [side["timestamp"] == best["__g_t"], *[side[f"__g_l{i}"] == best[n] for i, n in enumerate(names)]]
        joined = side.join(best, condition)
        value, other = F.col("value"), F.col("__g_v")
        a, b = (other, value) if flipped else (value, other)
        if m.group:
            base = [(x, q(x)) for x in many.kept if x not in include]
            labels = base + [(x, F.col(f"__g_i{i}")) for i, x in enumerate(include)]
        else:
            labels = [(x, q(x)) for x in left.kept if (x in m.labels if m.on else m.on is None or x not in m.labels)]
        return self.combined(node, joined, a, b, labels)

    def set_operation(self, node: Binary, left: SeriesFrame, right: SeriesFrame) -> SeriesFrame:
        """and, or, unless: by the series' match keys, whatever the time."""
        m = node.matching
        keys = self.match_labels(m, left, right)
        if m.on:
            visible = lambda f: [x for x in f.labels if x in m.labels]
        else:
            visible = lambda f: list(f.labels)

        def keyed(f: SeriesFrame) -> DataFrame:
            return f.df.select("*", *[f.label(x).alias(f"__g_m{i}") for i, x in enumerate(keys)], F.lit(1).alias("__g_m"))

        on = [*[f"__g_m{i}" for i in range(len(keys))], "__g_m"]
        l, r = keyed(left), keyed(right)  # noqa: E741
        if node.op in ("and", "unless"):
            out = l.join(r.select(*on).distinct(), on, "left_semi" if node.op == "and" else "left_anti")
            shown = visible(left)
            return SeriesFrame(out.select("timestamp", *[q(x) for x in shown], "value"), shown)
        rest = r.join(l.select(*on).distinct(), on, "left_anti")
        shown = list(dict.fromkeys([*visible(left), *visible(right)]))
        both = [d.select("timestamp", *[f.label(x).alias(x) for x in shown], "value") for d, f in ((l, left), (rest, right))]
        return SeriesFrame(both[0].unionAll(both[1]), shown)
