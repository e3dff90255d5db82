"""Queries of the general data-processing operators, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.drift import catalogue, lifespans, long_table, numbered_files, payload_fields, schema_changes
from gridloom.operators.regular_grid import missing_steps, regular_grid
from gridloom.operators.spikes import implausible
from gridloom.operators.trailing import DAY_NS, silent_windows, trailing_totals
from gridloom.shared import table

def evaluation(spark: SparkSession, sf_dir: str, name: str) -> dict[str, int]:
    """One row of eval_params (three rows, fixed) as a dictionary."""
    row = table(spark, sf_dir, "eval_params").where(F.col("eval_name") == name).first()
    return row.asDict()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible(table(spark, sf_dir, "instant_samples"), table(spark, sf_dir, "metric_meta")).select("sample_id")


def p1_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible(table(spark, sf_dir, "instant_samples"), table(spark, sf_dir, "metric_meta"))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    week, month = (evaluation(spark, sf_dir, n) for n in ("trailing_7d", "trailing_30d"))
    windows = [p["range_ns"] // p["step_ns"] for p in (week, month)]
    totals = trailing_totals(table(spark, sf_dir, "range_samples"), max(week["end_ns"], month["end_ns"]), windows)
    # each window up to the last day of its own evaluation
    last = F.create_map(*[x for w, p in zip(windows, (week, month), strict=True) for x in (F.lit(w).cast("int"), F.lit(p["end_ns"] // DAY_NS).cast("int"))])
    return totals.where(F.unix_date("day") <= last[F.col("window_days")])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silent_windows(_totals(spark, sf_dir))


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in ("total", "average", "daily_average")]
    return _totals(spark, sf_dir).select("series_id", F.date_format("day", "yyyy-MM-dd").alias("day_utc"), "window_days", "n_samples", *rounded)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "wide_files"), table(spark, sf_dir, "wide_records"))


def p4_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_table(table(spark, sf_dir, "wide_files"), table(spark, sf_dir, "wide_records"))


def p4_lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per agent and field, the numbers of the first and the last file of each island of presence."""
    numbered = numbered_files(table(spark, sf_dir, "wide_files"))
    spans = lifespans(catalogue(numbered, payload_fields(table(spark, sf_dir, "wide_records"))))
    return spans.where(F.col("n") == F.col("life")).select("agent", "field", F.col("life").alias("first_file"), F.col("until").alias("last_file"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = evaluation(spark, sf_dir, "grid_10m")
    return regular_grid(table(spark, sf_dir, "instant_samples"), p["start_ns"], p["end_ns"], p["step_ns"], p["lookback_ns"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_steps(_grid(spark, sf_dir))


def p5_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


QUERIES = {
    "p1_found": p1_found,
    "p1_faults": p1_faults,
    "p2_found": p2_found,
    "p2_totals": p2_totals,
    "p4_found": p4_found,
    "p4_long": p4_long,
    "p4_lifespans": p4_lifespans,
    "p5_found": p5_found,
    "p5_grid": p5_grid,
}

_ACTIVE = """
WITH flat AS (SELECT series_id, written_at, block_id, unnest(samples) AS s FROM range_samples),
active AS (
  SELECT series_id, s.timestamp_ns AS ts, arg_max(s.value, (written_at, block_id, s.value)) AS v
  FROM flat WHERE series_id IS NOT NULL AND s.timestamp_ns IS NOT NULL AND s.value IS NOT NULL AND NOT isnan(s.value)
  GROUP BY 1, 2),
p AS (SELECT eval_name, end_ns // step_ns AS last_day, CAST(range_ns // step_ns AS INTEGER) AS w FROM eval_params WHERE eval_name LIKE 'trailing%'),
daily AS (SELECT series_id, ts // 86400000000000 AS d, sum(v) AS total, count(*) AS n FROM active GROUP BY 1, 2),
firsts AS (SELECT series_id, min(d) AS f FROM daily GROUP BY 1),
days AS (SELECT series_id, unnest(range(f, (SELECT max(last_day) FROM p) + 1)) AS d FROM firsts),
rolled AS (
  SELECT days.series_id, days.d, p.w, coalesce(sum(daily.n), 0) AS n, coalesce(sum(daily.total), 0) AS total
  FROM days CROSS JOIN p LEFT JOIN daily ON daily.series_id = days.series_id AND daily.d > days.d - p.w AND daily.d <= days.d
  WHERE days.d <= p.last_day GROUP BY 1, 2, 3)
"""

_GRID = """
WITH p AS (SELECT start_ns, end_ns, step_ns, lookback_ns FROM eval_params WHERE eval_name = 'grid_10m'),
r AS (
  SELECT series_id, timestamp_ns AS ts, arg_max(value, (ingested_at, sample_id, value)) AS v
  FROM instant_samples, p
  WHERE value IS NOT NULL AND NOT isnan(value) AND series_id IS NOT NULL AND timestamp_ns BETWEEN start_ns AND end_ns GROUP BY 1, 2),
span AS (SELECT series_id, min(ts) AS f, max(ts) AS l FROM r GROUP BY 1),
steps AS (
  SELECT series_id, start_ns + k * step_ns AS t
  FROM (SELECT series_id, f, l, start_ns, step_ns, unnest(range(0, (end_ns - start_ns) // step_ns + 1)) AS k FROM span, p)
  WHERE start_ns + k * step_ns BETWEEN f AND l),
g AS (SELECT steps.series_id, t, r.ts, r.v FROM steps ASOF LEFT JOIN r ON steps.series_id = r.series_id AND steps.t >= r.ts)
"""

ORACLE = {
    "p2_found": _ACTIVE + "SELECT series_id, strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') AS day_utc, w AS window_days FROM rolled WHERE n = 0",
    "p2_totals": _ACTIVE
    + """SELECT series_id, strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') AS day_utc, w AS window_days, CAST(n AS BIGINT) AS n_samples,
  round(CAST(total AS DOUBLE), 6) AS total, round(CASE WHEN n > 0 THEN total / n END, 6) AS average, round(total / w, 6) AS daily_average FROM rolled""",
    "p4_lifespans": """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY written_at NULLS FIRST, file_id) AS n FROM wide_files WHERE file_id IS NOT NULL),
k AS (
  SELECT DISTINCT file_id, unnest(json_keys(payload)) AS field FROM (SELECT file_id, payload FROM wide_records WHERE json_valid(payload)) WHERE json_type(payload) = 'OBJECT'),
c AS (
  SELECT agent, field, n, n - row_number() OVER (PARTITION BY agent, field ORDER BY n) AS island FROM k JOIN f USING (file_id)
  WHERE field IS DISTINCT FROM timestamp_column AND NOT list_contains(coalesce(ignore_columns, []), field))
SELECT agent, field, CAST(min(n) AS INTEGER) AS first_file, CAST(max(n) AS INTEGER) AS last_file FROM c GROUP BY agent, field, island""",
    "p5_found": _GRID + "SELECT series_id, t AS step_ts_ns FROM g, p WHERE ts IS NULL OR t - ts > lookback_ns",
    "p5_grid": _GRID
    + """SELECT series_id, t AS step_ts_ns, CASE WHEN t - ts <= lookback_ns THEN v END AS value, CASE WHEN t - ts <= lookback_ns THEN ts END AS reading_ts_ns,
  CASE WHEN ts IS NULL OR t - ts > lookback_ns THEN 'missing' WHEN t - ts < step_ns THEN 'observed' ELSE 'carried' END AS status FROM g, p""",
}
