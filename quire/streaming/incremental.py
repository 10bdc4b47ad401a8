"""Polled micro-batches: landed files are read once, replays change nothing.

The checkpoint is the progress that has been made; a failed batch is not marked as done, so
nothing is lost after a failure. A batch's snapshot is named by its number: a replay of a
batch finds its snapshot and stops, or writes it again from the one before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.schema import CATALOG, WORK_ITEM
from quire.sources.landed import read_catalog
from quire.storage import shared_folder


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def latest(spark: SparkSession, root: str, upto: int) -> DataFrame:
    """The newest complete snapshot of a batch below `upto`; an empty catalog if there is none."""
    for n in range(upto - 1, -1, -1):
        if exists(spark, f"{root}/batch={n}"):
            return read_catalog(spark, f"{root}/batch={n}")
    return spark.createDataFrame([], CATALOG)


def follow(spark: SparkSession, landed: str, root: str, checkpoint: str, step: Callable[[DataFrame, DataFrame], DataFrame], schema: T.StructType = WORK_ITEM, files_per_batch: int = 450) -> int:
    """Reads new files until none are left; step(catalog, items) gives the next catalog. Returns the last batch number.

    files_per_batch is a run's budget of landed responses (SC9, W6).
    """
    done = {"n": -1}

    def one(items: DataFrame, n: int) -> None:
        out = f"{root}/batch={n}"
        if not exists(spark, out):
            step(latest(spark, root, n), items).write.mode("overwrite").parquet(out)
        done["n"] = n

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(landed)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return done["n"]


def drained(stream: DataFrame) -> DataFrame:
    """What a stream gives until its source is read to the end, from a table in the shared folder (SK13: batches and their progress are committed together)."""
    at = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")


def fresh_events(stream: DataFrame, key: str, time: str | None = None) -> DataFrame:
    """Each key once, however late it comes: there is no watermark, whatever `time`. The keys seen are kept with the checkpoint, so polled and restarted runs know them."""
    return stream.dropDuplicates([key])


def tumbling_counts(stream: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension beyond polled batches: counts by window and kind, complete when the watermark passes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
