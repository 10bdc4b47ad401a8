"""Stopping after N misses in a row (C2), over ordered ranges.

Lookups are given up when N of them in a row found nothing. Where the rows are many, or one group has most of them, no
task may hold a group, so a group is cut into sorted ranges. A range is told by a summary: its length, the
misses it begins with, those it ends with, and where N of its own are first complete. Summaries of neighbours merge,
so the misses that come into a range follow from the summaries before it, and with them the place where a group stops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.storage import cut

SUMMARY = "grp string, start long, n long, prefix long, suffix long, hit long"


def summaries(ranged: DataFrame, limit: int) -> DataFrame:
    """SUMMARY of every group in every range, of sorted rows (grp, at, miss). hit is the place, from 0, of the row that completes the first `limit` misses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # of the last group, which the next batch may go on with

        def told(states: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(states, schema=pa.schema([("grp", pa.string()), *((c, pa.int64()) for c in ("start", "n", "prefix", "suffix", "hit"))]))

        for batch in batches:
            k = batch.num_rows
            if not k:
                continue
            grp, at, miss = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            new = np.ones(k, bool)
            new[1:] = pc.not_equal(grp.slice(1), grp.slice(0, k - 1)).to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], k)
            goes_on = state is not None and grp[0].as_py() == state["grp"]
            place = np.arange(k)
            wall = np.where(miss, -1, place)
            wall[begin] = np.maximum(wall[begin], begin - 1)
            last = np.maximum.accumulate(wall)
            length = place - last  # misses in a row up to here
            if goes_on:
                length[: end[0]] += np.where(last[: end[0]] == -1, state["suffix"], 0)
            full = np.flatnonzero(length == limit)
            hit = full[np.minimum(np.searchsorted(full, begin), max(0, len(full) - 1))] if len(full) else np.full(len(begin), k)
            found = np.flatnonzero(~miss)
            first = found[np.minimum(np.searchsorted(found, begin), max(0, len(found) - 1))] if len(found) else np.full(len(begin), k)
            done = []
            for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist())):
                lead = int(first[i]) - a if a <= first[i] < b else b - a
                here = int(hit[i]) - a if a <= hit[i] < b else None
                one = {"grp": grp[a].as_py(), "start": int(at[a]), "n": b - a, "prefix": lead, "suffix": int(length[b - 1]), "hit": here}
                if i == 0 and goes_on:
                    one |= {"start": state["start"], "n": state["n"] + b - a, "prefix": state["n"] + lead if state["prefix"] == state["n"] else state["prefix"]}
                    one["hit"] = state["hit"] if state["hit"] is not None else None if here is None else state["n"] + here
                elif i == 0 and state is not None:
                    done.append(state)
                done.append(one)
            state = done.pop()
            if done:
                yield told(done)
        if state is not None:
            yield told([state])

    return ranged.select("grp", "at", "miss").mapInArrow(run, SUMMARY)


def attempted(rows: DataFrame, miss: Column, limit: int, order: list[str], groups: list[str] | None = None) -> DataFrame:
    """rows with `attempted`: whether a group's row comes before, or completes, its first `limit` misses in a row.

    The order must be total within a group. A null `miss` is a hit. Without groups, all rows are one.
    """
    grp = F.to_json(F.struct(*groups)) if groups else F.lit("")
    keyed = rows.select(F.struct("*").alias("row"), grp.alias("grp"), F.struct(*order).alias("place"), F.coalesce(miss, F.lit(False)).alias("miss"))
    ranged = cut(keyed.repartitionByRange("grp", "place").sortWithinPartitions("grp", "place").withColumn("at", F.monotonically_increasing_id()))
    told = summaries(ranged, limit).withColumn("part", F.shiftright("start", 33))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    upto_here = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    open_end = F.when(F.col("prefix") < F.col("n"), F.struct("suffix", F.sum("n").over(upto_here).alias("upto")))
    merged = told.withColumns({"rows_before": F.coalesce(F.sum("n").over(before), F.lit(0)), "open_end": open_end}).withColumn("broken", F.last("open_end", ignorenulls=True).over(before))
    carry = F.coalesce(F.col("rows_before") - F.col("broken.upto") + F.col("broken.suffix"), F.col("rows_before"))
    stops = merged.withColumn("carry", carry).withColumn("stop", F.when(F.col("carry") >= limit, -1).when(F.col("carry") + F.col("prefix") >= limit, limit - 1 - F.col("carry")).otherwise(F.col("hit")))
    over = F.coalesce(F.max(F.col("stop").isNotNull()).over(before), F.lit(False))
    last = stops.select("grp", "part", "start", F.when(over, -1).otherwise(F.coalesce("stop", "n")).alias("last"))
    placed = ranged.withColumn("part", F.shiftright("at", 33))
    return placed.join(last, ["grp", "part"]).select("row.*", (F.col("at") - F.col("start") <= F.col("last")).alias("attempted"))


def longest_runs(rows: DataFrame, miss: Column, order: list[str], groups: list[str] | None = None) -> DataFrame:
    """(grp, longest): the most misses in a row of each group, from the same summaries, merged in order.

    grp is the group as JSON. The longest inside a range comes with it; one that runs on over ranges is its end, whole ranges and a beginning.
    """
    grp = F.to_json(F.struct(*groups)) if groups else F.lit("")
    keyed = rows.select(grp.alias("grp"), F.struct(*order).alias("place"), F.coalesce(miss, F.lit(False)).alias("miss"))
    ranged = cut(keyed.repartitionByRange("grp", "place").sortWithinPartitions("grp", "place").withColumn("at", F.monotonically_increasing_id()))
    w = Window.partitionBy("grp", F.shiftright("at", 33)).orderBy("at")
    inside = ranged.withColumn("broken", F.count_if(~F.col("miss")).over(w)).where("miss").groupBy("grp", F.shiftright("at", 33).alias("part"), "broken").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max("n").alias("inside"))
    told = summaries(ranged, 1 << 62).withColumn("part", F.shiftright("start", 33))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    upto_here = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    open_end = F.when(F.col("prefix") < F.col("n"), F.struct("suffix", F.sum("n").over(upto_here).alias("upto")))
    merged = told.withColumns({"rows_before": F.coalesce(F.sum("n").over(before), F.lit(0)), "open_end": open_end}).withColumn("broken", F.last("open_end", ignorenulls=True).over(before))
    across = F.coalesce(F.col("rows_before") - F.col("broken.upto") + F.col("broken.suffix"), F.col("rows_before")) + F.col("prefix")
    return merged.groupBy("grp").agg(F.max(across).alias("across")).join(inside, "grp", "left").select("grp", F.greatest("across", F.coalesce("inside", F.lit(0))).alias("longest"))
