"""Storage shared by driver and executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, a temporary folder in local mode, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")


#: Fixed value: a task of that many rows takes seconds where a row takes a millisecond.
ROWS_A_TASK = 5_000


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over tasks whose number follows its rows, for work that takes far longer than reading.

    Files are cut by bytes, so that millions of short rows may be in one task; Spark counts them without reading their columns.
    The dealt rows are checkpointed, since Spark would move filters, and their work, to before the deal.
    """
    return cut(df.repartition(max(1, -(-df.count() // ROWS_A_TASK))))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder, its lineage forgotten."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
