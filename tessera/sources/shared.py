"""Cutting lineage through the folder that the driver and all executors see, and dealing rows to as many tasks as they need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows that a task is given; pairs of an order's lines that are reckoned with for each of its lines, of which it has a few.
ROWS_A_TASK, PAIRS_A_LINE = 500_000, 4


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df, shuffled by its keys to one partition for each ROWS_A_TASK of its rows (or of `rows`, a bound of them), so that a task stays as large as it is however many there are; few rows are left to the session's partitions."""
    n = -(-(df.count() if rows is None else rows) // ROWS_A_TASK)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session gets a folder of its own; on a cluster that is an error, as executors would write where nobody reads."""
    context = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not told:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
    return told.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: neither plan nor lineage reaches behind it."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Set for the write of a table: what computed it gives its shuffle files back.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df, computed once and read back from Parquet in the shared folder: as cut, but packed, and what it was shuffled through takes no disk any more."""
    spark = df.sparkSession
    path, before = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}", spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before) if before is not None else spark.conf.unset(FREED)
    return spark.read.schema(df.schema).parquet(path)
