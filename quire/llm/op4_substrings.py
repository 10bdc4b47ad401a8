"""Removal of word sequences that occur more than once, by difference-cover anchors.

Two equal windows of WINDOW words, wherever they start, have a common offset below PERIOD
at which both positions lie in the difference cover COVER modulo PERIOD. So only
WINDOW - PERIOD + 1 words from cover positions are hashed (5 of 21 positions); any repeated
window holds an anchor that some other place shares. Around shared anchors alone the match
is extended to whole windows, which are compared by a 64-bit hash of all their words.

Both steps run over chunks (see chunks.py): a chunk sends each distinct hash once with a
mark if it holds it twice, so a passage in a third of all documents makes one entry per chunk.

Nulls: a null text has no words. Rows with a null or repeated id are rows of their own;
equal rows repeat each other's windows. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.chunks import Answers, ask, ask_again, bucket_count, chunk_words, finish, pack, settle, table_texts, totals
from quire.llm.shared import cut
from quire.llm.stats import covered, per_row
from quire.llm.words import Texts, gram_hashes, gram_starts, nonspace_class, owner, spans

WINDOW = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)  # a perfect difference set: every residue is a difference of two


def anchors(hashes: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all texts."""
    width = window - PERIOD + 1
    ok = gram_starts(off, width)
    at = np.flatnonzero(ok)
    row = owner(off)
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True
    at = at[on[(at - off[row[at]]) % PERIOD]] if len(at) else at
    return at, gram_hashes(hashes, width)[at] if len(at) else np.zeros(0, np.uint64)


def candidates(hashes: np.ndarray, off: np.ndarray, shared: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows over shared anchors."""
    row = owner(off)[shared] if len(shared) else shared
    low = np.maximum(shared - (PERIOD - 1), off[row])
    high = np.minimum(shared, off[row + 1] - window)
    fit = high >= low
    change = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(change, low[fit], 1)
    np.add.at(change, high[fit] + 1, -1)
    at = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    return at, gram_hashes(hashes, window)[at] if len(at) else np.zeros(0, np.uint64)


def once(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, 2 for those present twice (else 1), and each entry's place in them."""
    distinct, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    return distinct, np.minimum(count, 2).astype(np.uint8), back


def shared_somewhere(keys: np.ndarray, chunk: np.ndarray, more: np.ndarray) -> np.ndarray:
    return (totals(keys, more) > 1).astype(np.uint8)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, chunk_bytes: int = 8 << 20) -> DataFrame:
    """key, n_words, n_removed, kept (the words left, joined by one space)."""
    if window < PERIOD:
        raise ValueError(f"window must be {PERIOD} words or more")
    kind = df.schema[key].dataType.simpleString()
    packed = pack(df.select(F.col(key).alias("id"), F.col(text).alias("text")), chunk_bytes)
    buckets = bucket_count(packed)
    table = nonspace_class()

    def first(rows: pa.Table):
        keys, more, _ = once(anchors(*chunk_words(table_texts(rows), table), window)[1])
        yield 0, keys, more

    def windows(rows: pa.Table, answers: Answers, hashes=None, off=None):
        if hashes is None:
            hashes, off = chunk_words(table_texts(rows), table)
        at, h = anchors(hashes, off, window)
        keys, _, back = once(h)
        return candidates(hashes, off, at[answers.get(0, keys, np.uint8)[back] > 0], window)

    def second(rows: pa.Table, answers: Answers):
        keys, more, _ = once(windows(rows, answers)[1])
        yield 1, keys, more

    def result(rows: pa.Table, answers: Answers) -> pa.Table:
        texts = table_texts(rows)
        hashes, off = chunk_words(texts, table)
        at, h = windows(rows, answers, hashes, off)
        keys, _, back = once(h)
        gone = covered(at[answers.get(1, keys, np.uint8)[back] > 0], window, len(hashes))
        kept = []
        for i, block in texts.blocks():
            n = len(block)
            kept += kept_words(block, ~gone[off[i] : off[i + n]])
        return pa.table([rows.column("id"), pa.array(np.diff(off)), pa.array(per_row(gone, off)), pa.array(kept, pa.string())], names=[key, "n_words", "n_removed", "kept"])

    found = cut(settle(ask(packed, first, buckets), {0: (shared_somewhere, "u1")}))
    again = settle(ask_again(packed, found, second, buckets), {1: (shared_somewhere, "u1")})
    return finish(packed, found.unionAll(again), result, buckets, f"`{key}` {kind}, n_words long, n_removed long, kept string")


def kept_words(texts: Texts, keep: np.ndarray) -> list[bytes]:
    """Each text's kept words joined by one space."""
    starts, ends, off = spans(texts, nonspace_class())
    buf = texts.buf.copy()
    change = np.zeros(len(buf) + 1, np.int32)
    np.add.at(change, starts[keep], 1)
    np.add.at(change, ends[keep], -1)
    stays = np.cumsum(change[:-1]) > 0
    which = np.flatnonzero(keep)
    row = owner(off)[which] if len(which) else which
    follows = np.zeros(len(which), bool)
    if len(which):
        follows[:-1] = row[1:] == row[:-1]
    gap = ends[which[follows]]  # a space stands there, since another word follows
    buf[gap] = 32
    stays[gap] = True
    out, total = buf[stays].tobytes(), np.concatenate([[0], np.cumsum(stays)])
    bounds = total[texts.off].tolist()
    return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), u AS (
  SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w
), v AS (
  SELECT r, i, list(x) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS k FROM u
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY md5(array_to_string(k, ' '))) AS c FROM v WHERE len(k) = 35
), b AS (
  SELECT u.r, u.i, x, coalesce(last_value(CASE WHEN c > 1 THEN u.i END IGNORE NULLS) OVER (PARTITION BY u.r ORDER BY u.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM u LEFT JOIN g ON g.r = u.r AND g.i = u.i
), s AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM b GROUP BY r
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (r)
"""
