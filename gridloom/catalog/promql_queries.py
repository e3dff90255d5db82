"""Queries of the engine over the test tables, one or more for each operator, with SQL counterparts.

Each entry is a PromQL text with its evaluation times; the SQL is put together from the same parts
(metric, alignment or window, function), written independently of the engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.engine import Engine
from gridloom.shared import nanoseconds, table
from gridloom.sources.base import InMemorySource, LongTableSource, MetricSource
from gridloom.sources.wide import ColumnMapping, WideParquetSource, WideSource, parquet_time_range
from gridloom.types import Matcher

SECOND = 1_000_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR
#: 2024-01-01, the first day of events, and the time of the instant queries.
FIRST = 1_704_067_200 * SECOND
NOW = FIRST + 14 * DAY + 12 * HOUR
GRID = (FIRST, FIRST + 30 * DAY, 6 * HOUR)
LOOKBACK = 12 * HOUR
#: The days of orders and lineitem, 1995 to 2001, with some to spare at either end.
OLD = (694_224_000 * SECOND, 1_009_843_200 * SECOND, 30 * DAY)
OLD_DAILY = (OLD[0], OLD[1], DAY)
#: 2025-03-03, the first of the four days of instant_samples.
READINGS = (1_740_960_000 * SECOND, 1_741_305_600 * SECOND, HOUR)


def source(spark: SparkSession, sf_dir: str) -> InMemorySource:
    """The metrics of the test tables."""
    events = table(spark, sf_dir, "events").withColumn("timestamp", nanoseconds("ts"))
    sample = lambda value, *labels: events.select("timestamp", value.cast("double").alias("value"), "event_type", *labels)
    k = F.regexp_extract("props", r'"k": *(-?\d+)', 1)
    daily = lambda df, day, what, *labels: df.groupBy(F.date_trunc("DAY", F.col(day)).alias("d"), *labels).agg(what.cast("double").alias("value")).select(nanoseconds("d").alias("timestamp"), "value", *labels)
    orders, lineitem = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return InMemorySource(
        spark,
        {
            "event_value": sample(F.col("value")),
            "event_k": sample(k),
            "event_seq": sample(F.col("event_id")),
            "user_value": sample(F.col("value"), F.col("user_id").cast("string").alias("user_id")),
            "orders_count": daily(orders, "o_orderdate", F.count(F.lit(1)), "o_orderstatus", "o_orderpriority"),
            "lineitem_qty": daily(lineitem, "l_shipdate", F.sum("l_quantity"), "l_returnflag", "l_linestatus"),
        },
    )


def wide_source(spark: SparkSession, sf_dir: str) -> WideSource:
    """Events per hour as a wide table, one column ``event_count/<type>/1`` per type, by the slash convention."""
    return WideSource(_wide_events(spark, sf_dir))


def _wide_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = table(spark, sf_dir, "events").select(F.expr(f"({nanoseconds_sql('ts')}) div {HOUR}L * {HOUR}L").alias("timestamp"), F.concat(F.lit("event_count/"), "event_type", F.lit("/1")).alias("series"))
    counted = hours.groupBy("timestamp").pivot("series").count().na.fill(0)
    return counted.select("timestamp", *[F.col(f"`{c}`").cast("double").alias(c) for c in counted.columns[1:]], F.lit(1.0).alias("duration"))


def long_source(spark: SparkSession, sf_dir: str) -> LongTableSource:
    """instant_samples, the table in the long schema."""
    return LongTableSource(table(spark, sf_dir, "instant_samples"), timestamp="timestamp_ns", labels=["instance", "job", "op", "id"])


def wide_parquet_source(spark: SparkSession, sf_dir: str) -> WideParquetSource:
    """The same file as a wide one: its whole numbers are the columns of two metrics, one named by metadata."""
    return WideParquetSource(spark, f"{sf_dir}/instant_samples.parquet", ColumnMapping("timestamp_ns", ("value",), metadata={"sample_id": {"metric": "arrivals", "unit": "rows", "table": "instant_samples"}}))


def nanoseconds_sql(column: str) -> str:
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ)) * 1000L"


# -- SQL parts ----------------------------------------------------------------------------

_EVENT = "epoch_us(ts) * 1000 AS ts, event_type"
METRICS = {
    "event_value": (f"SELECT {_EVENT}, value FROM events WHERE value IS NOT NULL", ["event_type"]),
    "event_k": (f"SELECT {_EVENT}, CAST(regexp_extract(props, '\"k\": *(-?\\d+)', 1) AS DOUBLE) AS value FROM events", ["event_type"]),
    "event_seq": (f"SELECT {_EVENT}, CAST(event_id AS DOUBLE) AS value FROM events", ["event_type"]),
    "user_value": (f"SELECT {_EVENT}, CAST(user_id AS VARCHAR) AS user_id, value FROM events", ["event_type", "user_id"]),
    "orders_count": ("SELECT epoch_us(date_trunc('day', o_orderdate)) * 1000 AS ts, o_orderstatus, o_orderpriority, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY ALL", ["o_orderstatus", "o_orderpriority"]),
    "lineitem_qty": ("SELECT epoch_us(date_trunc('day', l_shipdate)) * 1000 AS ts, l_returnflag, l_linestatus, sum(l_quantity) AS value FROM lineitem GROUP BY ALL", ["l_returnflag", "l_linestatus"]),
    "event_count": (
        """SELECT h.ts, '1' AS id, t.event_type AS op, CAST(count(e.event_id) AS DOUBLE) AS value FROM (SELECT DISTINCT epoch_us(date_trunc('hour', ts)) * 1000 AS ts FROM events) h
CROSS JOIN (SELECT DISTINCT event_type FROM events) t LEFT JOIN events e ON e.event_type = t.event_type AND epoch_us(date_trunc('hour', e.ts)) * 1000 = h.ts GROUP BY ALL""",
        ["id", "op"],
    ),
    "arrivals": ("SELECT timestamp_ns AS ts, 'instant_samples' AS \"table\", CAST(sample_id AS DOUBLE) AS value FROM instant_samples WHERE timestamp_ns IS NOT NULL AND sample_id IS NOT NULL", ['"table"']),
}

for _m in ("cpu_busy_ratio", "frames_in_total", "call_latency_seconds", "cores_online", "rail_volts"):
    _labels = ", ".join(f"coalesce({x}, '') AS {x}" for x in ("instance", "job", "op", "id"))
    METRICS[_m] = (f"SELECT timestamp_ns AS ts, {_labels}, value FROM instant_samples WHERE __name__ = '{_m}' AND value IS NOT NULL", ["instance", "job", "op", "id"])


def _grid(grid) -> str:
    start, end, step = grid
    return f"(SELECT {start} + k * {step} AS t FROM range(0, {(end - start) // step + 1}) r(k))"


def aligned(metric: str, grid=GRID, offset: int = 0, where: str = "true", lookback: int = LOOKBACK) -> str:
    sql, labels = METRICS[metric]
    names = ", ".join(labels)
    return f"SELECT t AS timestamp, {names}, arg_max(value, (ts, value)) AS value FROM {_grid(grid)} g JOIN ({sql}) l ON ts + {offset} <= t AND ts + {offset} >= t - {lookback} WHERE {where} GROUP BY ALL"


def windowed(metric: str, function: str, width: int, grid=GRID, offset: int = 0, where: str = "true") -> str:
    sql, labels = METRICS[metric]
    names = ", ".join(labels)
    gain = "CASE WHEN value >= pv AND NOT isnan(value) THEN value - pv ELSE value END"
    formula, having = {
        "increase": (f"sum(CASE WHEN i > 1 THEN {gain} ELSE 0 END)", "true"),
        "rate": (f"sum(CASE WHEN i > 1 THEN {gain} ELSE 0 END) / ((max(ts) - min(ts)) / 1e9)", "max(ts) > min(ts)"),
        "irate": (f"arg_max({gain}, i) / (arg_max(ts - pt, i) / 1e9)", "arg_max(ts - pt, i) > 0"),
        "delta": ("arg_max(value, i) - arg_min(value, i)", "true"),
        "idelta": ("arg_max(value - pv, i)", "true"),
    }[function]
    return f"""SELECT t AS timestamp, {names}, {formula} AS value FROM (
  SELECT t, {names}, ts, value, lag(value) OVER p AS pv, lag(ts) OVER p AS pt, row_number() OVER p AS i
  FROM {_grid(grid)} g JOIN ({sql}) l ON ts + {offset} <= t AND ts + {offset} >= t - {width} WHERE {where} WINDOW p AS (PARTITION BY t, {names} ORDER BY ts, value)) w
GROUP BY t, {names} HAVING count(*) >= 2 AND {having}"""


AT = (NOW, NOW, 1)
#: name -> (query, grid, SQL giving timestamp, labels, value; digits of the comparison)
_ENTRIES: dict[str, tuple[str, tuple[int, int, int], str | None]] = {}


def _add(name: str, query: str, grid=GRID, sql: str | None = None) -> None:
    _ENTRIES[name] = (query, grid, sql)


def _value(expression: str, inner: str, labels: str = "event_type") -> str:
    names = f"{labels}, " if labels else ""
    return f"SELECT timestamp, {names}CAST({expression} AS DOUBLE) AS value FROM ({inner}) q"


_V, _VI = aligned("event_value"), aligned("event_value", AT)
_K = aligned("event_k")
_U = aligned("user_value")
_add("sel_instant", "event_value", AT, _VI)
_add("sel_range", "event_value", GRID, _V)
_add("sel_equal", 'event_value{event_type="click"}', GRID, aligned("event_value", where="event_type = 'click'"))
_add("sel_not_equal", 'event_value{event_type!="click"}', GRID, aligned("event_value", where="event_type <> 'click'"))
_add("sel_regex", 'event_value{event_type=~"c.*|view"}', GRID, aligned("event_value", where="regexp_full_match(event_type, 'c.*|view')"))
_add("sel_not_regex", 'event_value{event_type!~"c.*|vie"}', GRID, aligned("event_value", where="NOT regexp_full_match(event_type, 'c.*|vie')"))
_add("sel_offset", "event_value offset 1d", GRID, aligned("event_value", offset=DAY))
_add("sel_offset_negative", "event_value offset -2h", GRID, aligned("event_value", offset=-2 * HOUR))
_add("sel_absent_label", 'event_value{nothing=""}', AT, _VI)
_add("sel_many_series", "user_value", GRID, _U)
for _f in ("rate", "increase", "irate", "delta", "idelta"):
    _add(f"{_f}_range", f"{_f}(event_k[12h])", GRID, windowed("event_k", _f, 12 * HOUR))
    _add(f"{_f}_instant", f"{_f}(event_seq[1d])", AT, windowed("event_seq", _f, DAY, AT))
_add("rate_offset", "rate(event_k[12h] offset 1d)", GRID, windowed("event_k", "rate", 12 * HOUR, GRID, DAY))
_add("increase_uneven", "increase(event_k[7h])", (FIRST + 1, FIRST + 30 * DAY, 5 * HOUR), windowed("event_k", "increase", 7 * HOUR, (FIRST + 1, FIRST + 30 * DAY, 5 * HOUR)))
_add("increase_old", "increase(lineitem_qty[60d])", OLD, windowed("lineitem_qty", "increase", 60 * DAY, OLD))

_MATH = {
    "abs": ("abs(event_value - 20)", "abs(value - 20)"),
    "acos": ("acos(clamp(event_value / 1000, -1, 1))", "acos(least(value / 1000, 1))"),
    "acosh": ("acosh(event_value + 1)", "acosh(value + 1)"),
    "asin": ("asin(clamp(event_value / 1000, -1, 1))", "asin(least(value / 1000, 1))"),
    "asinh": ("asinh(event_value)", "asinh(value)"),
    "atan": ("atan(event_value)", "atan(value)"),
    "atanh": ("atanh(clamp(event_value / 10000, 0, 0.9))", "atanh(least(value / 10000, 0.9))"),
    "ceil": ("ceil(event_value)", "ceil(value)"),
    "floor": ("floor(-event_value)", "floor(-value)"),
    "clamp": ("clamp(event_value, 10, 20.5)", "greatest(least(value, 20.5), 10)"),
    "clamp_min": ("clamp_min(event_value, 15)", "greatest(value, 15)"),
    "clamp_max": ("clamp_max(event_value, 15)", "least(value, 15)"),
    "cos": ("cos(event_value)", "cos(value)"),
    "cosh": ("cosh(event_value / 100)", "cosh(value / 100)"),
    "deg": ("deg(event_value)", "degrees(value)"),
    "exp": ("exp(event_value / 100)", "exp(value / 100)"),
    "ln": ("ln(event_value + 1)", "ln(value + 1)"),
    "log10": ("log10(event_value + 1)", "log10(value + 1)"),
    "log2": ("log2(event_value + 1)", "log2(value + 1)"),
    "rad": ("rad(event_value)", "radians(value)"),
    "round": ("round(event_value)", "floor(value + 0.5)"),
    "round_to": ("round(event_value, 5)", "floor(value / 5 + 0.5) * 5"),
    "sgn": ("sgn(event_value - 20)", "sign(value - 20)"),
    "sin": ("sin(event_value)", "sin(value)"),
    "sinh": ("sinh(event_value / 100)", "sinh(value / 100)"),
    "sqrt": ("sqrt(event_value)", "sqrt(value)"),
    "tan": ("tan(event_value / 1000)", "tan(value / 1000)"),
    "tanh": ("tanh(event_value / 100)", "tanh(value / 100)"),
}
for _n, (_q, _e) in _MATH.items():
    _add(f"math_{_n}", _q, GRID, _value(_e, _V))

_STAMP = "make_timestamp(timestamp // 1000)"
_TIMES = {
    "timestamp": "timestamp / 1e9",
    "day_of_month": f"day({_STAMP})",
    "day_of_week": f"dayofweek({_STAMP})",
    "day_of_year": f"dayofyear({_STAMP})",
    "days_in_month": f"day(last_day({_STAMP}))",
    "hour": f"hour({_STAMP})",
    "minute": f"minute({_STAMP})",
    "month": f"month({_STAMP})",
    "year": f"year({_STAMP})",
}
for _n, _e in _TIMES.items():
    _add(f"time_{_n}", f"{_n}(event_value)", GRID, _value(_e, _V))
_add("time_time", "time()", GRID, _value("timestamp / 1e9", f"SELECT t AS timestamp FROM {_grid(GRID)} g", ""))
_add("time_no_argument", "hour()", GRID, _value("hour(make_timestamp(timestamp // 1000))", f"SELECT t AS timestamp FROM {_grid(GRID)} g", ""))

_add("label_replace", 'label_replace(event_value, "short", "$1-x", "event_type", "(.).*k|vi(ew)?")', GRID, f"SELECT timestamp, event_type, CASE WHEN regexp_full_match(event_type, '(.).*k|vi(ew)?') THEN regexp_extract(event_type, '^(?:(.).*k|vi(ew)?)$', 1) || '-x' ELSE '' END AS short, value FROM ({_V}) q")
_add("label_join", 'label_join(user_value, "both", "/", "user_id", "nothing", "event_type")', GRID, f"SELECT timestamp, event_type, user_id, user_id || '//' || event_type AS both, value FROM ({_U}) q")


def _sorted(order: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS position FROM ({_VI}) q"


_add("sort_value", "sort(event_value)", AT, _sorted("value"))
_add("sort_value_desc", "sort_desc(event_value)", AT, _sorted("value DESC"))
_add("sort_label", 'sort_by_label(event_value, "event_type")', AT, _sorted("event_type"))
_add("sort_label_desc", 'sort_by_label_desc(event_value, "event_type")', AT, _sorted("event_type DESC"))

_AGGREGATES = {"sum": "sum(value)", "avg": "avg(value)", "count": "count(value)", "min": "min(value)", "max": "max(value)", "stddev": "stddev_pop(value)", "stdvar": "var_pop(value)", "group": "1", "quantile": "quantile_cont(value, 0.3)"}
for _n, _e in _AGGREGATES.items():
    _p = "0.3, " if _n == "quantile" else ""
    _add(f"agg_{_n}", f"{_n}({_p}user_value)", GRID, f"SELECT timestamp, CAST({_e} AS DOUBLE) AS value FROM ({_U}) q GROUP BY ALL" if _n != "group" else f"SELECT timestamp, 1.0::DOUBLE AS value FROM ({_U}) q GROUP BY timestamp")
    _group = "timestamp, event_type"
    _add(f"agg_{_n}_by", f"{_n} by (event_type) ({_p}user_value)", GRID, f"SELECT {_group}, CAST({_e} AS DOUBLE) AS value FROM ({_U}) q GROUP BY {_group}")
    _add(f"agg_{_n}_without", f"{_n}({_p}user_value) without (user_id)", GRID, f"SELECT {_group}, CAST({_e} AS DOUBLE) AS value FROM ({_U}) q GROUP BY {_group}")
_rank = "row_number() OVER (PARTITION BY timestamp, event_type ORDER BY {}event_type, user_id)"
_add("agg_topk", "topk(3, user_value)", GRID, f"SELECT timestamp, event_type, user_id, value FROM ({_U}) q QUALIFY row_number() OVER (PARTITION BY timestamp ORDER BY value DESC, event_type, user_id) <= 3")
_add("agg_topk_by", "topk by (event_type) (3, user_value)", GRID, f"SELECT timestamp, event_type, user_id, value FROM ({_U}) q QUALIFY {_rank.format('value DESC, ')} <= 3")
_add("agg_bottomk", "bottomk by (event_type) (2, user_value)", GRID, f"SELECT timestamp, event_type, user_id, value FROM ({_U}) q QUALIFY {_rank.format('value, ')} <= 2")
_add("agg_limitk", "limitk by (event_type) (4, user_value)", GRID, f"SELECT timestamp, event_type, user_id, value FROM ({_U}) q QUALIFY {_rank.format('')} <= 4")
_add("agg_limit_ratio", "limit_ratio by (event_type) (0.25, user_value)", GRID, f"SELECT timestamp, event_type, user_id, value FROM ({_U}) q QUALIFY {_rank.format('')} <= ceil(count(*) OVER (PARTITION BY timestamp, event_type) * 0.25)")
_add("agg_count_values", 'count_values("v", event_k)', GRID, f"SELECT timestamp, CAST(value AS VARCHAR) AS v, CAST(count(*) AS DOUBLE) AS value FROM ({_K}) q GROUP BY timestamp, q.value")
_add("agg_of_rate", "sum by (event_type) (rate(event_seq[1d]))", GRID, windowed("event_seq", "rate", DAY))

for _n, _op, _e in (("add", "+", "value + 3"), ("sub", "-", "value - 3"), ("mul", "*", "value * 3"), ("div", "/", "value / 3"), ("mod", "%", "value % 3"), ("pow", "^", "pow(value, 3)")):
    _add(f"bin_{_n}_scalar", f"event_value {_op} 3", GRID, _value(_e, _V))
_add("bin_scalar_left", "100 - event_value", GRID, _value("100 - value", _V))
for _n, _op, _sql in (("eq", "==", "="), ("ne", "!=", "<>"), ("lt", "<", "<"), ("gt", ">", ">"), ("le", "<=", "<="), ("ge", ">=", ">=")):
    _add(f"bin_{_n}_filter", f"event_k {_op} 50", GRID, f"SELECT * FROM ({_K}) q WHERE value {_sql} 50")
    _add(f"bin_{_n}_bool", f"event_k {_op} bool 50", GRID, _value(f"CASE WHEN value {_sql} 50 THEN 1 ELSE 0 END", _K))
_add("bin_scalar_filter", "50 < event_k", GRID, f"SELECT timestamp, event_type, 50.0::DOUBLE AS value FROM ({_K}) q WHERE 50 < value")
_pair = f"({_V}) a JOIN ({_K}) b USING (timestamp, event_type)"
for _n, _op, _e in (("add", "+", "a.value + b.value"), ("sub", "-", "a.value - b.value"), ("mul", "*", "a.value * b.value"), ("div", "/", "a.value / (b.value + 1)")):
    _add(f"bin_{_n}_vector", f"event_value {_op} {'(event_k + 1)' if _n == 'div' else 'event_k'}", GRID, f"SELECT timestamp, event_type, {_e} AS value FROM {_pair}")
_add("bin_gt_vector", "event_value > event_k", GRID, f"SELECT timestamp, event_type, a.value AS value FROM {_pair} WHERE a.value > b.value")
_add("bin_on", "event_value * on (event_type) event_k", GRID, f"SELECT timestamp, event_type, a.value * b.value AS value FROM {_pair}")
_sums = f"SELECT timestamp, event_type, sum(value) AS value FROM ({_U}) q GROUP BY timestamp, event_type"
_add("bin_group_left", "user_value / on (event_type) group_left sum by (event_type) (user_value)", GRID, f"SELECT timestamp, event_type, user_id, a.value / b.value AS value FROM ({_U}) a JOIN ({_sums}) b USING (timestamp, event_type)")
_add("bin_group_right", "sum by (event_type) (user_value) - ignoring (user_id) group_right user_value", GRID, f"SELECT timestamp, event_type, user_id, b.value - a.value AS value FROM ({_U}) a JOIN ({_sums}) b USING (timestamp, event_type)")
_add("bin_ignoring", 'label_replace(event_value, "side", "left", "event_type", ".*") + ignoring (side) label_replace(event_k, "side", "right", "event_type", ".*")', GRID, f"SELECT timestamp, event_type, a.value + b.value AS value FROM {_pair}")
_add("bin_group_left_label", 'user_value * on (event_type) group_left (side) label_replace(event_k, "side", "$1", "event_type", "(..).*")', GRID, f"SELECT timestamp, event_type, user_id, left(event_type, 2) AS side, a.value * b.value AS value FROM ({_U}) a JOIN ({_K}) b USING (timestamp, event_type)")
# what IEEE-754 says and SQL mostly doesn't
_ieee = {
    "div_zero": ("(event_k - 50) / (event_k - event_k)", "CASE WHEN value > 50 THEN 'inf'::DOUBLE WHEN value < 50 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END"),
    "mod_zero": ("event_k % 0", "'nan'::DOUBLE"),
    "ln": ("ln(event_k - 50)", "CASE WHEN value > 50 THEN ln(value - 50) WHEN value = 50 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END"),
    "sqrt": ("sqrt(event_k - 50)", "CASE WHEN value >= 50 THEN sqrt(value - 50) ELSE 'nan'::DOUBLE END"),
    "acosh": ("acosh(event_k - 50)", "CASE WHEN value >= 51 THEN acosh(value - 50) ELSE 'nan'::DOUBLE END"),
    "ceil_inf": ("ceil(event_k / 0)", "CASE WHEN value = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END"),
    "clamp_nan": ("clamp_min(sqrt(event_k - 50), 3)", "CASE WHEN value < 50 THEN 3 ELSE greatest(sqrt(greatest(value - 50, 0)), 3) END"),
    "nan_equal": ("sqrt(event_k - 50) == bool sqrt(event_k - 50)", "CASE WHEN value >= 50 THEN 1 ELSE 0 END"),
    "nan_greater": ("sqrt(event_k - 50) > bool 2", "CASE WHEN value > 54 THEN 1 ELSE 0 END"),
}
for _n, (_q, _e) in _ieee.items():
    _add(f"ieee_{_n}", _q, GRID, _value(_e, _K))
_add("ieee_sum", "sum(sqrt(event_k - 50))", GRID, f"SELECT timestamp, CASE WHEN min(value) < 50 THEN 'nan'::DOUBLE ELSE sum(sqrt(greatest(value - 50, 0))) END AS value FROM ({_K}) q GROUP BY timestamp")
_add("fold_scalars", "event_value * (2 ^ 3 - 7 % 4)", GRID, _value("value * 5", _V))
_add("bin_and", 'event_value and event_k{event_type=~"c.*"}', GRID, f"SELECT * FROM ({_V}) q WHERE event_type LIKE 'c%'")
_add("bin_unless", 'event_value unless event_k{event_type=~"c.*"}', GRID, f"SELECT * FROM ({_V}) q WHERE event_type NOT LIKE 'c%'")
_add("bin_or", 'event_value{event_type="view"} or event_k', GRID, f"SELECT * FROM ({_V}) q WHERE event_type = 'view' UNION ALL SELECT * FROM ({_K}) q WHERE event_type <> 'view'")
_add("bin_unary_minus", "-event_value", GRID, _value("-value", _V))
_add("old_orders", "sum by (o_orderstatus) (orders_count)", OLD_DAILY, f"SELECT timestamp, o_orderstatus, sum(value) AS value FROM ({aligned('orders_count', OLD_DAILY)}) q GROUP BY ALL")

_WIDE: dict[str, tuple[str, tuple[int, int, int], str]] = {
    "wide_select": ("event_count", GRID, aligned("event_count")),
    "wide_regex": ('event_count{op=~"c.*"}', GRID, aligned("event_count", where="op LIKE 'c%'")),
    "wide_increase": ("increase(event_count[12h])", GRID, windowed("event_count", "increase", 12 * HOUR)),
    "wide_sum": ("sum by (op) (event_count)", GRID, f"SELECT timestamp, op, value FROM ({aligned('event_count')}) q"),
}
_cpu = aligned("cpu_busy_ratio", READINGS)
_LONG: dict[str, tuple[str, tuple[int, int, int], str]] = {
    "long_select": ("cpu_busy_ratio", READINGS, _cpu),
    "long_equal": ('cpu_busy_ratio{job="edge_agent"}', READINGS, aligned("cpu_busy_ratio", READINGS, where="job = 'edge_agent'")),
    "long_not_equal": ('cpu_busy_ratio{job!="edge_agent"}', READINGS, aligned("cpu_busy_ratio", READINGS, where="job <> 'edge_agent'")),
    "long_absent": ('cpu_busy_ratio{job="",op=""}', READINGS, aligned("cpu_busy_ratio", READINGS, where="job = '' AND op = ''")),
    "long_present": ('call_latency_seconds{op!=""}', READINGS, aligned("call_latency_seconds", READINGS, where="op <> ''")),
    "long_alternatives": ('call_latency_seconds{op=~"read|write|merge"}', READINGS, aligned("call_latency_seconds", READINGS, where="op IN ('read', 'write', 'merge')")),
    "long_regex_absent": ('call_latency_seconds{job!~"edge.+"}', READINGS, aligned("call_latency_seconds", READINGS, where="NOT regexp_full_match(job, 'edge.+')")),
    "long_rate": ("sum by (instance, op) (rate(frames_in_total[30m]))", READINGS, f"SELECT timestamp, instance, op, sum(value) AS value FROM ({windowed('frames_in_total', 'rate', HOUR // 2, READINGS)}) q GROUP BY ALL"),
    "long_delta": ('delta(rail_volts{job="sensor_hub"}[1h])', READINGS, windowed("rail_volts", "delta", HOUR, READINGS, where="job = 'sensor_hub'")),
    "long_max": ("max by (instance) (cores_online)", READINGS, f"SELECT timestamp, instance, max(value) AS value FROM ({aligned('cores_online', READINGS)}) q GROUP BY ALL"),
}
_PARQUET: dict[str, tuple[str, tuple[int, int, int], str]] = {
    "wide_parquet_select": ("arrivals", READINGS, aligned("arrivals", READINGS)),
    "wide_parquet_idelta": ('idelta(arrivals{table="instant_samples"}[2h])', READINGS, windowed("arrivals", "idelta", 2 * HOUR, READINGS)),
}
#: Values are compared to so many significant digits; the cut between two roundings is off the ties, where the order of a sum decides.
_DIGITS, _CUT = 10, 0.4837261


def comparable(value: Column) -> Column:
    """A value rounded to _DIGITS significant digits, the whole part's counted; what is not finite stays as it is."""
    scale = F.pow(F.lit(10.0), F.lit(_DIGITS) - F.length(F.abs(value).cast("decimal(38,0)").cast("string")))
    return F.when(F.isnan(value) | (F.abs(value) > 1e15), value).otherwise(F.floor(value * scale + F.lit(_CUT)) / scale)


_COMPARABLE = f"CASE WHEN isnan(value) OR abs(value) > 1e15 THEN value ELSE floor(value * pow(10.0, {_DIGITS} - length(CAST(CAST(abs(value) AS DECIMAL(38,0)) AS VARCHAR))) + {_CUT}) / pow(10.0, {_DIGITS} - length(CAST(CAST(abs(value) AS DECIMAL(38,0)) AS VARCHAR))) END"


def _query(query: str, grid: tuple[int, int, int], make: Callable, ordered: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(make(spark, sf_dir), LOOKBACK)
        frame = engine.instant_frame(query, grid[0]) if grid == AT else engine.range_frame(query, *grid)
        names = [x for x in frame.labels if x != "__name__"]
        # one part keeps the order of the result, so that it shows as a column
        df = frame.df.coalesce(1).withColumn("position", F.monotonically_increasing_id() + 1) if ordered else frame.df
        return df.select("timestamp", *names, comparable(F.col("value")).alias("value"), *(["position"] if ordered else []))

    return run


def _metrics(make: Callable[[SparkSession, str], MetricSource], matcher: Matcher | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """What a source lists: one row for each metric and label."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(m.name, x) for m in make(spark, sf_dir).list_metrics(matcher) for x in m.label_names or ("",)], "metric string, label string")

    return run


def footer_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = parquet_time_range(f"{sf_dir}/instant_samples.parquet", "timestamp_ns", spark)
    return spark.createDataFrame([(r.start_ns, r.end_ns)], "start_ns long, end_ns long")


_MADE = [(_ENTRIES, source), (_WIDE, wide_source), (_LONG, long_source), (_PARQUET, wide_parquet_source)]
QUERIES = {name: _query(text, grid, make, name.startswith("sort_")) for entries, make in _MADE for name, (text, grid, _) in entries.items()}
QUERIES |= {
    "list_long": _metrics(long_source),
    "list_long_regex": _metrics(long_source, Matcher("__name__", "=~", "c.*|rail_volts")),
    "list_wide": _metrics(wide_source),
    "list_wide_parquet": _metrics(wide_parquet_source, Matcher("__name__", "!=", "series_id")),
    "footer_range": footer_range,
}
ORACLE = {name: f"SELECT * REPLACE ({_COMPARABLE} AS value) FROM (SELECT * REPLACE (CAST(value AS DOUBLE) AS value) FROM ({sql}) inner_query) final" for entries, _ in _MADE for name, (_, _, sql) in entries.items() if sql}
_LISTED = " UNION ALL ".join(f"SELECT __name__ AS metric, '{x}' AS label FROM instant_samples WHERE __name__ IS NOT NULL GROUP BY __name__ HAVING max(coalesce({x}, '')) <> ''" for x in ("instance", "job", "op", "id"))
ORACLE |= {
    "list_long": _LISTED,
    "list_long_regex": f"SELECT * FROM ({_LISTED}) q WHERE regexp_full_match(metric, 'c.*|rail_volts')",
    "list_wide": "SELECT 'event_count' AS metric, unnest(['id', 'op']) AS label",
    "list_wide_parquet": "SELECT 'arrivals' AS metric, 'table' AS label",
    "footer_range": "SELECT min(timestamp_ns) AS start_ns, max(timestamp_ns) AS end_ns FROM instant_samples",
}
