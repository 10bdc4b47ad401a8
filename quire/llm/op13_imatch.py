"""Fingerprints of documents by I-Match: hashes of the terms of a band of inverse document frequency.

1. Document frequencies of all terms are counted over all documents: tasks add up theirs, one shuffle
   merges the sums. The lexicon has the terms of LOW_SHARE to HIGH_SHARE of the documents, in at least
   two. No more than (distinct terms of a mean document) / LOW_SHARE terms can be that frequent, however many documents
   there are; as 64-bit hashes they are broadcast.
2. A text keeps its terms of the lexicon, sorted and distinct. One hash of all of them heads the fingerprint, which any
   change of the terms changes. Others are made over randomised subsets of the lexicon: a subset of rung j
   holds each term with probability 2^-j. A text has the subsets of three rungs from log2 of its
   number of terms, SUBSETS of each, so that its subsets hold about 1, 1/2 and 1/4 of a term, whatever
   its length. A subset without any of its terms is written 0000.
3. The likeness of two fingerprints is the share of subsets of their common rungs that agree, among those where at
   least one text has a term; 1 for equal fingerprints.

A text with less than FEW terms of the lexicon keeps all its terms; one without terms counts as a term of its own.

Next documents: rows are cut into ranges of (id, hash of the text), whose first rows are found from these keys alone. A range's
texts, and the first row of the next one, come into one task, sorted, and are read as a stream. Null ids
come last and are ordered by their texts' hashes, as are equal ids. Every row has a result; a single row is its own
next. Null texts are ''. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import cut
from quire.llm.terms import Sums, letter_class, runs
from quire.llm.words import Texts, ascii_lower, mix, owner, spans, texts_of, word_hashes

LOW_SHARE, HIGH_SHARE, FEW = 1 / 2000, 1 / 40, 8
RUNGS, SUBSETS = 3, 24
RANGE_BYTES, RANGES = 4 << 20, 100_000
SEEDS = mix(np.arange(1, 64 * SUBSETS + 1, dtype=np.uint64)).reshape(64, SUBSETS)  # by rung and subset; two subsets share one


def distinct_terms(block: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Rows and term hashes, sorted and distinct."""
    starts, ends, off = spans(block, letter_class())
    h, row = word_hashes(ascii_lower(block.buf), starts, ends), owner(off)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def document_frequencies(texts: DataFrame) -> DataFrame:
    """term (64-bit hash), n: the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(["term"], ["n"], 1_000_000)
        for batch in batches:
            for _, block in texts_of(batch.column(0)).blocks():
                h = np.sort(distinct_terms(block)[1])
                at = runs(h)
                for full in sums.add(pa.table({"term": h[at].view(np.int64), "n": np.diff(np.append(at, len(h)))})):
                    yield from full.to_batches(64_000)
        for full in sums.rest():
            yield from full.to_batches(64_000)

    return texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(texts: DataFrame, documents: int, low: float = LOW_SHARE, high: float = HIGH_SHARE) -> np.ndarray:
    """The sorted hashes of the terms whose document frequency is in the band."""
    least = max(2, int(np.ceil(documents * low)))
    most = max(2 * least, int(documents * high))
    found = document_frequencies(texts).where(F.col("n").between(least, most)).select("term").toArrow()
    return np.sort(found.column("term").to_numpy().astype(np.int64).view(np.uint64))


class Prints:
    """Fingerprints of some texts: head, rung and codes (RUNGS * SUBSETS, 16 bits each) of each."""

    def __init__(self, head: np.ndarray, rung: np.ndarray, codes: np.ndarray):
        self.head, self.rung, self.codes = head, rung, codes

    def written(self) -> list[str]:
        return [f"{h:016x}{r:02x}" + c.byteswap().tobytes().hex() for h, r, c in zip(self.head.tolist(), self.rung.tolist(), self.codes)]

    @staticmethod
    def read(written: list[str]) -> Prints:
        head = np.array([int(w[:16], 16) for w in written], np.uint64)
        rung = np.array([int(w[16:18], 16) for w in written], np.int64)
        codes = np.array([np.frombuffer(bytes.fromhex(w[18:]), ">u2") for w in written], np.uint16).reshape(len(written), RUNGS * SUBSETS)
        return Prints(head, rung, codes)

    def take(self, rows: np.ndarray) -> Prints:
        return Prints(self.head[rows], self.rung[rows], self.codes[rows])


def prints(block: Texts, lex: np.ndarray) -> Prints:
    n = len(block)
    row, term = distinct_terms(block)
    at = np.minimum(np.searchsorted(lex, term), max(0, len(lex) - 1))
    inside = lex[at] == term if len(lex) else np.zeros(len(term), bool)
    few = np.bincount(row[inside], minlength=n) < FEW
    keep = inside | few[row]
    row, term = row[keep], term[keep]
    none = np.flatnonzero(np.bincount(row, minlength=n) == 0)
    if len(none):  # the text itself
        row = np.concatenate([row, none])
        term = np.concatenate([term, word_hashes(block.buf, block.off[none], block.off[none + 1])])
    count = np.bincount(row, minlength=n)
    rung = np.round(np.log2(np.maximum(count, 1))).astype(np.int64)
    head, codes = np.zeros(n, np.uint64), np.zeros(n * RUNGS * SUBSETS, np.uint64)
    with np.errstate(over="ignore"):
        value = mix(term + np.uint64(1))
        np.add.at(head, row, value)
        for r in range(RUNGS):
            j = rung[row] + r
            for pair in range(SUBSETS // 2):
                u = mix(term ^ SEEDS[j, pair])
                for half in range(2):
                    x = u >> np.uint64(32) if half else u & np.uint64(0xFFFFFFFF)
                    on = np.flatnonzero(x >> (32 - np.minimum(j, 32)).astype(np.uint64) == 0)
                    np.add.at(codes, row[on] * (RUNGS * SUBSETS) + r * SUBSETS + 2 * pair + half, value[on])
        held = codes != 0
        short = (mix(codes) >> np.uint64(48)).astype(np.uint16)
    short[held & (short == 0)] = 1
    short[~held] = 0
    return Prints(mix(head), rung, short.reshape(n, RUNGS * SUBSETS))


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """0 to 1 for each two fingerprints."""
    same, some = np.zeros(len(a.head), np.int64), np.zeros(len(a.head), np.int64)
    for apart in range(1 - RUNGS, RUNGS):
        at = np.flatnonzero(b.rung - a.rung == apart)
        x, y = (p.codes[at].reshape(len(at), RUNGS, SUBSETS) for p in (a, b))
        x, y = x[:, max(0, apart) : RUNGS + min(0, apart)], y[:, max(0, -apart) : RUNGS + min(0, -apart)]
        some[at] = ((x != 0) | (y != 0)).sum(axis=(1, 2))
        same[at] = ((x == y) & (x != 0)).sum(axis=(1, 2))
    out = same / np.maximum(some, 1)
    out[(a.head == b.head) & (a.rung == b.rung) & (a.codes == b.codes).all(axis=1)] = 1.0
    return out


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint"""
    source = df.select(F.col(key), F.col(text).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(lexicon(source.select("text"), source.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, block in texts_of(batch.column(1)).blocks():
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(block)), pa.array(prints(block, shared.value).written(), pa.string())], names=[key, "fingerprint"])

    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, fingerprint string")


def ordered(df: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """(id, text, guest) in partitions sorted by id, each run of rows followed by its next row (guest), and the number of rows."""
    rows = df.select(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    light = cut(rows.select("none", "id", "h", F.octet_length("text").cast("long").alias("size")))
    documents, total = light.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(1, min(RANGES, -(-int(total) // RANGE_BYTES)))
    least = light.repartitionByRange(ranges, "none", "id", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("none", "id", "h")).alias("k"))
    first = sorted((tuple(r.k) for r in least.collect()), key=lambda k: (k[0], 0 if k[0] else k[1], k[2]))  # one row for each range

    @F.pandas_udf("array<int>")
    def places(none: pd.Series, ids: pd.Series, h: pd.Series) -> pd.Series:
        known = [(n, 0 if n else i, x) for n, i, x in first]
        out = []
        for k in zip(none, ids, h):
            k = (bool(k[0]), 0 if k[0] else k[1], k[2])
            p = bisect_right(known, k) - 1
            out.append([2 * p, 2 * ((p - 1) % len(known)) + 1] if known[p] == k else [2 * p])
        return pd.Series(out)

    dealt = rows.withColumn("place", F.explode(places("none", "id", "h")))
    sorted_rows = dealt.select(F.expr("place DIV 2").alias("range"), (F.col("place") % 2 == 1).alias("guest"), "none", "id", "h", "text").repartition("range").sortWithinPartitions("range", "guest", "none", "id", "h")
    return sorted_rows.select("id", "guest", "text"), documents


def edited(text: str, follows: str) -> str:
    """The last half of a text (rounded down) replaced by as many code points, or all, from the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + follows[:half]


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows, documents = ordered(df, key, text)
    shared = df.sparkSession.sparkContext.broadcast(lexicon(df.select(F.col(text).alias("text")), documents))
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def some(held: pa.Table) -> pa.RecordBatch | None:
        """Results of all rows but the last, whose next is not there yet."""
        own = np.flatnonzero(~held.column("guest").to_numpy()[:-1])
        if not len(own):
            return None
        said = held.column("text").to_pylist()
        changed = [edited(said[i], said[i + 1]) for i in own.tolist()]
        mine, new = prints(texts_of(held.column("text")), shared.value), prints(texts_of(pa.array(changed, pa.large_string())), shared.value)
        a = mine.take(own)
        return pa.RecordBatch.from_arrays(
            [
                held.column("id").take(pa.array(own)).combine_chunks(), pa.array([len(said[i]) for i in own.tolist()], pa.int64()), pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
                pa.array(a.written(), pa.string()), pa.array(new.written(), pa.string()), pa.array(likeness(a, new)), pa.array(likeness(a, mine.take(own + 1))),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for first, block in texts_of(batch.column(2)).blocks(2 << 20):
                part = pa.Table.from_batches([batch.slice(first, len(block))])
                held = part if held is None else pa.concat_tables([held, part]).combine_chunks()
                out = some(held)
                if out is not None:
                    yield out
                held = held.slice(held.num_rows - 1)

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
