"""Small helpers shared by the operators: tables, materialisation, name clashes."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine (tests, a laptop) gets a temporary folder; on a cluster, whose
    executors could not all read one, it is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gridloom-checkpoint-"))


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and cut its lineage.

    The copy outlives the loss of any executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*settled: DataFrame) -> None:
    """Remove what :func:`settle` wrote for these tables, once nothing reads it any more."""
    for df in settled:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(settled: DataFrame, bytes_of_row: Column) -> tuple[DataFrame, int]:
    """The table, marked for broadcast if its measured size is within the session's own limit for that, and its number of rows."""
    limit = int(settled.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    size, rows = settled.select(F.sum(bytes_of_row.cast("long")), F.count(F.lit(1))).first()
    return F.broadcast(settled) if (size or 0) <= limit else settled, rows


def nanoseconds(column: str):
    """A timestamp column as ns since 1970, read as UTC whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ)) * 1000L")
