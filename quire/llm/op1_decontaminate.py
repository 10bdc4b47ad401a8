"""Benchmark decontamination by a prefix-filtered set join.

A window is `window` consecutive words of an item, or the whole of a shorter item. Its
shingles (`shingle` words) are ordered by their count over all documents; exact containment
needs every shingle, so the necessary prefix is the rarest one alone, and a window with a
shingle that no document has is out. Documents are joined on prefix shingles only. A
candidate must then fit (enough words before and after, by the shingle's place in the
window), and its words are compared with the window's, one by one.

What goes to all executors is two bitmaps of SLOTS bits, whatever the size of the
benchmark: they only keep shingles that can't match out of the shuffle. Windows and items
themselves are joined by shuffle, unless Spark finds them small enough to broadcast.

Nulls: a null text has no words; null item ids name no item (their windows still hit).
Repeated rows of documents are judged one by one, repeated items count once by id. Empty
tables give empty results, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.shared import cut
from quire.llm.words import Texts, alnum_class, ascii_lower, gram_hashes, gram_starts, owner, spans, texts_of, word_hashes

WINDOW = 10
SHINGLE = 3
SALTS = 16
SLOTS = 1 << 23  # bits of a filter: 1 MB


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 23)).astype(np.int64)


def windows_of(benchmark: DataFrame, key: str, text: str, window: int, shingle: int) -> DataFrame:
    """item, words (joined by spaces), size, k, hashes (of the shingles, by offset)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            texts = Texts(ascii_lower(texts.buf), texts.off)
            starts, ends, off = spans(texts, alnum_class())
            hashes = word_hashes(texts.buf, starts, ends)
            grams = {k: gram_hashes(hashes, k).astype(np.int64) for k in range(1, shingle + 1)}
            rows: list[tuple] = []
            items = batch.column(0).to_pylist()
            for i, item in enumerate(items):
                a, b = int(off[i]), int(off[i + 1])
                size = min(window, b - a)
                k = min(shingle, size)
                words = [texts.buf[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[a:b], ends[a:b])]
                for j in range(b - a - size + 1 if size else 0):
                    rows.append((item, " ".join(words[j : j + size]), size, k, grams[k][a + j : a + j + size - k + 1].tolist()))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.list_(pa.int64()))], names=["item", "words", "size", "k", "hashes"])

    kind = benchmark.schema[key].dataType.simpleString()
    return benchmark.select(F.col(key).alias("item"), F.col(text).alias("text")).mapInArrow(run, f"item {kind}, words string, size int, k int, hashes array<long>")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """SLOTS booleans: where a hash of the column h falls."""
    slot = F.shiftrightunsigned("h", 64 - 23) + 1  # these functions count from 1
    rows = hashes.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()  # at most SLOTS / 32768 rows of 4 KB
    out = np.zeros(SLOTS, bool)
    for b, bits in rows:
        at = (b - 1) * 32768
        out[at : at + 32768] = np.unpackbits(np.frombuffer(bytes(bits), np.uint8), bitorder="little")
    return out


def matches(texts: Texts, sizes: list[int], table: np.ndarray):
    """For each block: its first row, spans, and (k, word positions, hashes) of shingles that pass the filter."""
    for first, block in texts.blocks():
        block = Texts(ascii_lower(block.buf), block.off)
        starts, ends, off = spans(block, alnum_class())
        hashes = word_hashes(block.buf, starts, ends)
        found = []
        for k in sizes:
            h = gram_hashes(hashes, k)
            at = np.flatnonzero(table[slots(h)] & gram_starts(off, k)) if len(h) else np.zeros(0, np.int64)
            found.append((k, at, h[at]))
        yield first, block, starts, ends, off, found


def decontaminate(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """key, n_words, n_hit, n_items, items (sorted strings), spans (start, size of each hit window), contaminated."""
    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    windows = cut(windows_of(benchmark, item_key, item_text, window, shingle))
    distinct = windows.groupBy("words").agg(F.first("size").alias("size"), F.first("k").alias("k"), F.first("hashes").alias("hashes"))
    shingles = distinct.select("words", "size", "k", F.posexplode("hashes").alias("place", "h"))
    sizes = sorted(r[0] for r in windows.select("k").distinct().collect())  # 1 to `shingle`
    context = df.sparkSession.sparkContext

    table = context.broadcast(bitmap(shingles.select("h")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [h for *_, found in matches(texts_of(batch.column(0)), sizes, table.value) for _, _, h in found]
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *got]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n)], names=["h", "n"])

    counts = source.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    # the rarest shingle of each window, of windows all of whose shingles occur
    prefixes = cut(
        shingles.join(counts, "h", "left")
        .groupBy("words")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "place")).alias("least"), F.first("size").alias("size"))
        .where("least.n > 0")
        .select("words", "size", "least.h", "least.place")
    )
    rare = context.broadcast(bitmap(prefixes.select("h")))

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found_of = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for first, block, starts, ends, off, found in matches(texts_of(batch.column(1)), sizes, rare.value):
                n_words[first : first + len(block)] = np.diff(off)
                row_of = owner(off)
                for k, at, h in found:
                    reach = window if k == shingle else k  # the only shingle of a shorter item is all of it
                    for p, hash_ in zip(at.tolist(), h.astype(np.int64).tolist()):
                        row = int(row_of[p])
                        a, b = max(int(off[row]), p - reach + k), min(int(off[row + 1]), p + reach)
                        near = b" ".join(block.buf[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b]))
                        found_of[first + row].append({"h": hash_, "at": p - int(off[row]), "lead": p - a, "near": near.decode("utf-8", "replace")})
            shape = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("lead", pa.int32()), ("near", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(found_of, shape)], names=["id", "n_words", "found"])

    seen = cut(source.mapInArrow(seek, f"id {kind}, n_words long, found array<struct<h: long, at: int, lead: int, near: string>>").withColumn("row", F.monotonically_increasing_id()))
    candidates = seen.select("row", "n_words", F.inline("found"))
    # a common shingle, such as an item of one word, stands in many documents: its rows are dealt over SALTS tasks
    salted = prefixes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    start = F.col("at") - F.col("place")
    hits = (
        candidates.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"])
        .where((start >= 0) & (start + F.col("size") <= F.col("n_words")) & (F.col("lead") >= F.col("place")))
        .where(F.array_join(F.slice(F.split("near", " "), F.col("lead") - F.col("place") + 1, F.col("size")), " ") == F.col("words"))
        .select("row", start.alias("start"), "size", "words")
        .distinct()
    )
    order = Window.partitionBy("row").orderBy("start", "size")
    until = F.coalesce(F.max(F.col("start") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    end = F.col("start") + F.col("size")
    hit = (
        hits.withColumn("new", F.greatest(F.lit(0), end - F.greatest("start", until)))
        .groupBy("row")
        .agg(F.sum("new").alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "size"))).alias("spans"))
    )
    items = (
        hits.select("row", "words").distinct()
        .join(windows.select("words", F.col("item").cast("string").alias("item")).where("item IS NOT NULL").distinct(), "words")
        .select("row", "item").distinct()
        .groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    return (
        seen.select("row", F.col("id").alias(key), "n_words")
        .join(hit, "row", "left")
        .join(items, "row", "left")
        .select(
            key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans", (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[j:j + size - 1], ' ') AS words
  FROM (SELECT item_id, ws, least(10, len(ws)) AS size, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS j FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT size FROM bw
), u AS (
  SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM d
), v AS (
  SELECT r, i, list(x) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS k FROM u
), dw AS (
  SELECT r, i, size, array_to_string(k[1:size], ' ') AS words FROM v, sizes WHERE len(k) >= size
), h AS (
  SELECT DISTINCT r, i, dw.size, item_id FROM dw JOIN bw ON bw.words = dw.words AND bw.size = dw.size
), n AS (
  SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM h) GROUP BY r
), t AS (
  SELECT r, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM h) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
