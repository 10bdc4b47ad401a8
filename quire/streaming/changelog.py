"""A catalog as a base and a log of keyed changes (SK6, SK13, P40).

    <root>/base=<n>     all rows as of batch n
    <root>/delta=<n>    the rows that batch n put or dropped, by key

A batch writes its changes alone, so what is written follows the batch and not the catalog. Reading takes, for
each changed key, the row of the last batch that has it, and the base's rows for all other keys: the base is not shuffled
where the changed keys are few. Compaction writes a new base; files that a base covers may then be cleared.

A folder counts once Spark's writer has marked it as complete, so a batch that broke off leaves nothing behind: it
is written again as a whole. A batch that is complete is not written twice. Columns may be added by any batch:
older rows have nulls there.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.schema import WORK_ITEM

BATCH, GONE = "_batch", "_gone"


class ChangeLog:
    def __init__(self, spark: SparkSession, root: str, key: str, schema: T.StructType):
        """schema: the columns of a catalog without any batch."""
        self.spark, self.root, self.key, self.schema = spark, root.rstrip("/"), key, schema

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), self.spark._jvm.org.apache.hadoop.fs.Path

    def complete(self) -> dict[str, list[int]]:
        """The numbers of complete bases and deltas, from one listing."""
        files, path = self._files()
        found = files.globStatus(path(f"{self.root}/*=*/_SUCCESS")) or []
        out: dict[str, list[int]] = {"base": [], "delta": []}
        for status in found:
            kind, number = re.search(r"/(base|delta)=(\d+)/_SUCCESS$", status.getPath().toString()).groups()
            out[kind].append(int(number))
        return {kind: sorted(numbers) for kind, numbers in out.items()}

    def has(self, n: int) -> bool:
        done = self.complete()
        return n in done["delta"] or any(b >= n for b in done["base"])

    def append(self, n: int, puts: DataFrame, drops: DataFrame | None = None) -> bool:
        """Batch n: puts replace the rows of their keys or add new ones; drops (the key alone) take rows away. False if it is there already.

        A batch has a key once. Numbers rise.
        """
        if self.has(n):
            return False
        rows = puts.withColumn(GONE, F.lit(False))
        if drops is not None:
            rows = rows.unionByName(drops.select(self.key, F.lit(True).alias(GONE)), allowMissingColumns=True)
        rows.withColumn(BATCH, F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{self.root}/delta={n}")
        return True

    def read(self, upto: int | None = None) -> DataFrame:
        """All rows after batch `upto` (or the last)."""
        done = self.complete()
        wanted = lambda ns: [n for n in ns if upto is None or n <= upto]
        bases = wanted(done["base"])
        base = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/base={bases[-1]}") if bases else self.spark.createDataFrame([], self.schema)
        deltas = [n for n in wanted(done["delta"]) if not bases or n > bases[-1]]
        if not deltas:
            return base
        log = self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.root}/delta={n}" for n in deltas))
        last = log.groupBy(F.col(self.key).alias("changed")).agg(F.max_by(F.struct(*log.columns), BATCH).alias("row"))
        kept = base.join(last.select("changed"), F.col(self.key).eqNullSafe(F.col("changed")), "left_anti")
        return kept.unionByName(last.select("row.*").where(f"NOT {GONE}").drop(GONE, BATCH), allowMissingColumns=True)

    def compact(self) -> int | None:
        """A new base of all complete batches."""
        done = self.complete()
        n = max(done["delta"], default=None)
        if n is not None and n not in done["base"]:
            self.read(n).write.mode("overwrite").parquet(f"{self.root}/base={n}")
        return n

    def clear(self) -> None:
        """Deletes bases and deltas that the newest base covers; readers of older states must have ended."""
        done = self.complete()
        files, path = self._files()
        for kind in ("base", "delta"):
            for n in done[kind]:
                if done["base"] and (n < done["base"][-1] or (kind == "delta" and n == done["base"][-1])):
                    files.delete(path(f"{self.root}/{kind}={n}"), True)


def follow_changes(landed: str, log: ChangeLog, checkpoint: str, step: Callable[[DataFrame, DataFrame], DataFrame], schema: T.StructType = WORK_ITEM, files_per_batch: int = 450, compact_every: int = 20) -> int:
    """Reads new files until none are left; step(catalog, items) gives the rows to put. Returns the last batch number.

    A batch that Spark plays again finds its delta and changes nothing.
    """
    done = {"n": -1}

    def one(items: DataFrame, n: int) -> None:
        if not log.has(n):
            log.append(n, step(log.read(n - 1), items))
        if n % compact_every == compact_every - 1:
            log.compact()
        done["n"] = n

    stream = log.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(landed)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return done["n"]
