"""Queries of the text operators, and their SQL counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.encoding import decode_corpus, encode_corpus
from gridloom.llm.mojibake import garbled_documents
from gridloom.llm.packing import fill_report, pack_documents
from gridloom.llm.percentiles import combine_summaries, equi_rank_summary, grouped_percentiles
from gridloom.shared import table

PROBABILITIES = (0.01, 0.25, 0.5, 0.75, 0.99)
SUMMARY_PARTS = 200


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "instant_samples").select("__name__", "job", "timestamp_ns", "value")
    return r.withColumn("day", F.expr("CAST((timestamp_ns - pmod(timestamp_ns, 86400000000000L)) div 86400000000000L AS STRING)"))


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_percentiles(_days(spark, sf_dir), [["__name__"], ["job"], ["day"]], PROBABILITIES)


def p3_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per metric over all days, from one summary for each metric and day."""
    daily = equi_rank_summary(_days(spark, sf_dir), ["__name__", "day"], SUMMARY_PARTS)
    return combine_summaries(daily, ["__name__"], PROBABILITIES)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread over all cores where the file has fewer parts than these: each row costs much more than to move it."""
    df, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_documents(spark, sf_dir))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their ids: the way back is exact."""
    return decode_corpus(encode_corpus(_documents(spark, sf_dir)))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), table(spark, sf_dir, "pack_bins"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = table(spark, sf_dir, "pack_bins")
    capacities = {r["bin_kind"]: r["capacity_tokens"] for r in bins.collect()}
    return fill_report(pack_documents(_documents(spark, sf_dir), bins), capacities)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_documents(_documents(spark, sf_dir)).select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_documents(_documents(spark, sf_dir))


QUERIES = {
    "p3_percentiles": p3_percentiles,
    "p3_combined": p3_combined,
    "p6_ids": p6_ids,
    "p6_decoded": p6_decoded,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_restored": p8_restored,
}

_READINGS = "SELECT __name__, job, CAST(timestamp_ns // 86400000000000 AS VARCHAR) AS day, value FROM instant_samples WHERE value IS NOT NULL AND NOT isnan(value)"

ORACLE: dict[str, str] = {
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p3_percentiles": f"""
WITH r AS ({_READINGS}),
q AS (SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.99]::DOUBLE[]) AS q),
g AS (
  SELECT 0 AS kind, __name__, NULL AS job, NULL AS day, value FROM r UNION ALL
  SELECT 1, NULL, job, NULL, value FROM r UNION ALL SELECT 2, NULL, NULL, day, value FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY kind, __name__, job, day ORDER BY value) AS i, count(*) OVER (PARTITION BY kind, __name__, job, day) AS n FROM g)
SELECT CAST(kind AS INTEGER) AS kind, __name__, job, day, q, n, value FROM o, q WHERE i = greatest(1, least(n, ceil(round(q * n, 9))))""",
    "p3_combined": f"""
WITH r AS ({_READINGS}),
o AS (SELECT *, row_number() OVER (PARTITION BY __name__, day ORDER BY value) AS i, count(*) OVER (PARTITION BY __name__, day) AS n FROM r),
points AS (SELECT __name__, value AS x, n / 200 AS w FROM o, range(1, 201) p(k) WHERE i = greatest(1, (k * n + 199) // 200)),
c AS (SELECT __name__, x, sum(w) OVER (PARTITION BY __name__ ORDER BY x) AS c, sum(w) OVER (PARTITION BY __name__) AS total FROM points),
t AS (SELECT __name__, CAST(sum(n) AS BIGINT) AS n, CAST(ceil(sum(n / 200) + count(*)) AS BIGINT) AS rank_error FROM (SELECT __name__, day, count(*) AS n FROM r GROUP BY ALL) GROUP BY ALL),
q AS (SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.99]::DOUBLE[]) AS q)
SELECT t.__name__, q, t.n, min(x) AS value, rank_error FROM c JOIN t ON t.__name__ IS NOT DISTINCT FROM c.__name__, q WHERE c >= q * total - 1e-6 GROUP BY ALL""",
}
