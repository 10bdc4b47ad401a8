"""Asking every chunk of a corpus the same question about its keys.

Substring operators and language models need to know, for hashes of n-grams, what the
rest of the corpus has of them. Texts are packed into chunks of some megabytes, once, in
the shared checkpoint folder. Each chunk sends every distinct key once, however often it
holds it, so a key that fills the corpus makes one entry per chunk and no hot group. Keys
are dealt by value into buckets of bounded size; a bucket sends back one answer per key,
in the order in which the chunk sent them, and the chunk's texts then meet the answers.

Buckets hold about `bucket_bytes` of text each, so their number follows the input. Where
chunks times buckets exceeds the number of keys, rows hold few keys each, and the shuffle
stays proportional to the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import cut
from quire.llm.words import Texts, ascii_lower, spans, texts_of, word_hashes

PACKED = "chunk long, n_bytes long, body binary"
ASKED = "bucket long, chunk long, part int, keys binary, more binary"
ANSWERED = "chunk long, part int, bucket long, answer binary"


def _freeze(batches: list[pa.RecordBatch]) -> bytes:
    out = pa.BufferOutputStream()
    table = pa.Table.from_batches(batches).combine_chunks()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for batch in table.to_batches():
            writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def thaw(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(body)).read_all().combine_chunks()


def pack(df: DataFrame, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Whole rows of df (its columns as given, `text` among them) in chunks, checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = made = 0

        def out() -> pa.RecordBatch:
            nonlocal made
            made += 1
            name = (TaskContext.get().partitionId() << 32) + made
            return pa.RecordBatch.from_pydict({"chunk": pa.array([name], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "body": pa.array([_freeze(held)], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(text.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False) + 16
            ends = np.cumsum(sizes)
            at = 0
            while at < batch.num_rows:
                base = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, base + chunk_bytes - size, side="right")))
                held.append(batch.slice(at, upto - at))
                size += int(ends[upto - 1] - base)
                at = upto
                if size >= chunk_bytes or at < batch.num_rows:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return cut(df.mapInArrow(run, PACKED))


def bucket_count(packed: DataFrame, bucket_bytes: int = 4 << 20) -> int:
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    return max(12, -(-int(total) // bucket_bytes))


def planes(keys: np.ndarray) -> bytes:
    """Bytes of equal weight together: sorted keys then compress."""
    return keys.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def by_weight(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, for values of any width: the high bytes of small counts then take no room."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def from_weight(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the key, so sorted keys fall into runs."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def cuts(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of sorted keys and the bounds of their runs."""
    b = bucket_of(keys, buckets)
    at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    return b[at], np.append(at, len(b))


def entry_bytes(more, a: int, b: int) -> bytes | None:
    """What goes with the keys a to b: an array's entries, or what a function of a and b gives."""
    return None if more is None else more(a, b) if callable(more) else by_weight(more[a:b])


def rows_asked(found, chunks: list[int], buckets: int) -> list[pa.Array]:
    """The columns of ASKED for what keys_of() gives of each chunk: one row for each run of keys of one bucket."""
    squeeze = zstandard.ZstdCompressor(level=1)
    names, owners, parts, keys_of, with_keys = [], [], [], [], []
    for chunk, answers in zip(chunks, found):
        for part, keys, more in answers:
            runs, at = cuts(keys, buckets)
            for k, name in enumerate(runs.tolist()):
                data = entry_bytes(more, at[k], at[k + 1])
                names.append(name)
                owners.append(chunk)
                parts.append(part)
                keys_of.append(squeeze.compress(planes(keys[at[k] : at[k + 1]])))
                with_keys.append(None if data is None else squeeze.compress(data))
    return [pa.array(names, pa.int64()), pa.array(owners, pa.int64()), pa.array(parts, pa.int32()), pa.array(keys_of, pa.binary()), pa.array(with_keys, pa.binary())]


ASKED_NAMES = ["bucket", "chunk", "part", "keys", "more"]


def ask(source: DataFrame, keys_of: Callable, buckets: int) -> DataFrame:
    """keys_of(pa.Table) yields (part, sorted uint64 keys, entry array, function of a run's bounds, or None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body")):
                yield pa.RecordBatch.from_arrays(rows_asked([keys_of(thaw(body.as_py()))], [chunk], buckets), names=ASKED_NAMES)

    return source.select("chunk", "body").mapInArrow(run, ASKED)


def ask_again(packed: DataFrame, answers: DataFrame, keys_of: Callable, buckets: int) -> DataFrame:
    """As ask(), where keys_of(table, answers of the chunk) also has what was answered so far."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        bodies = left.column("body").to_pylist()
        return pa.table(rows_asked((keys_of(thaw(b), Answers(right, buckets)) for b in bodies), [key[0].as_py()] * len(bodies), buckets), names=ASKED_NAMES)

    return packed.select("chunk", "body").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, ASKED)


def settle(asked: DataFrame, decide: dict[int, tuple[Callable, object]], summary: Callable | None = None) -> DataFrame:
    """For every bucket of a part: decide[part] is a function and the type of what goes with its keys.

    function(keys, chunk of each, what goes with each) gives one answer for each. For the type bytes
    it is given the number of keys and the bytes of each run instead.
    summary(part, keys, more) -> two whole numbers of a bucket, sent as a row of chunk -1 in
    the columns part and bucket.
    """

    def run(table: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor().decompress
        part = table.column("part")[0].as_py()
        function, kind = decide[part]
        keys = [unplanes(expand(k)) for k in table.column("keys").to_pylist()]
        sizes = np.array([len(k) for k in keys], np.int64)
        chunk = np.repeat(table.column("chunk").to_numpy(), sizes)
        with_keys = [expand(m) for m in table.column("more").to_pylist()]
        more = (sizes, with_keys) if kind is bytes else np.concatenate([from_weight(m, kind) for m in with_keys])
        joined = np.concatenate(keys)
        got = function(joined, chunk, more)
        at = np.concatenate([[0], np.cumsum(sizes)])
        squeeze = zstandard.ZstdCompressor(level=1)
        answers = [squeeze.compress(by_weight(got[at[i] : at[i + 1]])) for i in range(len(sizes))]
        names = ["chunk", "part", "bucket", "answer"]
        out = pa.table([table.column("chunk"), table.column("part"), table.column("bucket"), pa.array(answers, pa.binary())], names=names)
        if summary:
            a, b = summary(part, joined, more)
            out = pa.concat_tables([out, pa.table([pa.array([-1], pa.int64()), pa.array([a], pa.int32()), pa.array([b], pa.int64()), pa.array([b""], pa.binary())], names=names)])
        return out

    return asked.groupBy("bucket", "part").applyInArrow(run, ANSWERED)


class Answers:
    """Answers of one chunk, by part."""

    def __init__(self, table: pa.Table, buckets: int):
        self.rows, self.buckets, self.open = {}, buckets, zstandard.ZstdDecompressor()
        for part, bucket, answer in zip(table.column("part").to_pylist(), table.column("bucket").to_pylist(), table.column("answer").to_pylist()):
            self.rows[part, bucket] = answer

    def get(self, part: int, keys: np.ndarray, kind) -> np.ndarray:
        """For the same sorted distinct keys that the chunk asked about."""
        names, at = cuts(keys, self.buckets)
        out = np.empty(len(keys), kind)
        for k, name in enumerate(names.tolist()):
            out[at[k] : at[k + 1]] = from_weight(self.open.decompress(self.rows[part, name]), kind)
        return out


def finish(packed: DataFrame, answers: DataFrame, result: Callable, buckets: int, schema: str) -> DataFrame:
    """result(table of a chunk's rows, Answers) -> pa.Table in the given schema."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [result(thaw(body), Answers(right, buckets)) for body in left.column("body").to_pylist()]
        return pa.concat_tables(out)

    return packed.select("chunk", "body").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts values, starts of equal runs, and the run of each sorted value."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def totals(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each entry the sum of weights over the entries of the same key."""
    order, first, run = groups(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.add.reduceat(weights[order].astype(np.int64), first)[run] if len(keys) else 0
    return out


def chunk_words(texts: Texts, table: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and each text's offsets in them."""
    hashes, counts = [], []
    for _, block in texts.blocks():
        starts, ends, off = spans(block, table)
        hashes.append(word_hashes(ascii_lower(block.buf) if lower else block.buf, starts, ends))
        counts.append(np.diff(off))
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *hashes]), np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))]).astype(np.int64)


def table_texts(table: pa.Table) -> Texts:
    return texts_of(table.column("text"))
