"""Terms of texts, exact, as Arrow columns, and sums of partial rows inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import Texts, ascii_lower, byte_class, owner, spans

SMALL_ROWS, SMALL_BYTES, DEAL = 20_000, 4 << 20, 16


def letter_class() -> np.ndarray:
    """`[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]`: ASCII letters and all non-ASCII."""
    return byte_class([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def terms_of(texts: Texts) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms (A-Z lower-cased), and for every term of the texts its number among them and its text."""
    table = letter_class()
    starts, ends, off = spans(texts, table)
    data = ascii_lower(texts.buf)[table[texts.buf]]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data))
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), owner(off)


def runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


class Sums:
    """Partial rows of a task: those with equal keys are added up from time to time, so memory is bounded by `rows`.

    add() gives tables that have to go out because there are too many different keys; rest() gives the others.
    """

    def __init__(self, keys: list[str], sums: list[str], rows: int = 600_000):
        self.keys, self.sums, self.rows, self.held, self.size = keys, sums, rows, [], 0

    def merged(self) -> pa.Table:
        table = pa.concat_tables(self.held).combine_chunks()
        got = table.group_by(self.keys, use_threads=False).aggregate([(s, "sum") for s in self.sums])
        return got.select([*self.keys, *(f"{s}_sum" for s in self.sums)]).rename_columns([*self.keys, *self.sums])

    def add(self, table: pa.Table) -> Iterator[pa.Table]:
        self.held.append(table)
        self.size += table.num_rows
        if self.size > self.rows:
            table = self.merged()
            self.held, self.size = [table], table.num_rows
            if 2 * self.size > self.rows:
                self.held, self.size = [], 0
                yield table

    def rest(self) -> Iterator[pa.Table]:
        if self.held:
            yield self.merged()


def met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with the rows of right, one for each key. Keys are never null.

    right goes to all tasks where it has been counted as small (SMALL_ROWS, SMALL_BYTES of keys); otherwise it is
    copied DEAL times, and the rows of a hot key of left are dealt over as many tasks. right should be stored, since it is counted first.
    """
    n, size = right.agg(F.count("*"), F.sum(sum(F.octet_length(F.col(k).cast("string")) for k in keys))).first()
    if n <= SMALL_ROWS and (size or 0) <= SMALL_BYTES:
        return left.join(F.broadcast(right), keys, how)
    part = F.pmod(F.xxhash64(*left.columns), F.lit(DEAL)).cast("int").alias("dealt_part")
    copies = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))).alias("dealt_part"))
    return left.select("*", part).join(copies, [*keys, "dealt_part"], how).drop("dealt_part")
