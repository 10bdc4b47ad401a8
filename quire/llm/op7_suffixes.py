"""Removal of byte strings that already occurred, by prefix-free parsing.

1. Parse. A rolling hash of MER bytes sets triggers: the trigger of a window of WINDOW bytes is
   the least hash among its first TRIGGERS positions, so every window holds one, in a place that
   its content alone decides. The window starts that see the same trigger make a phrase; its
   dictionary entry is the text from the first of them to the trigger, and the parse goes on
   after it. Two equal windows have equal entries before, and equal text after, their triggers.
2. What a chunk knows: its distinct entries, by the hash of the bytes that follow the trigger,
   with the hash of all bytes that their windows cover. An entry that the corpus has once is
   done; one that is the same wherever it stands has its first place named, and is done too.
3. Suffix order of the rest. Entries with the same bytes after the trigger, but not the same
   surroundings, are sent to one bucket with their bytes. There the parse is sorted by what
   follows the trigger, with the common prefixes of neighbours, and the dictionary by what
   stands before it, read backwards, with the common suffixes. A window is d bytes of an entry's
   end and WINDOW - d bytes of what follows: two windows are equal where both orders say so.
   The first of each class stays.

One array of all suffixes is never made: no task could hold it, and only the classes of equal
WINDOW bytes are asked for. Entries that stand in more than MANY surroundings would make a hot
bucket; their windows are told apart by hashes instead (96 bits), one for each chunk that has it.

Ids are of any ordered type; rows with a null id come last. Null texts count as empty, equal rows
are later copies of the first (of one id: in the order of partitions). Empty tables give empty
results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.chunks import Answers, ask, ask_again, bucket_count, by_weight, finish, from_weight, groups, pack, settle, table_texts
from quire.llm.shared import cut
from quire.llm.stats import per_row
from quire.llm.words import BASE, Texts, mix, powers
from quire.operators.upsert import number_rows

WINDOW = 100
TRIGGERS = 64
MER = 8
LAST = np.int64(2**63 - 1)  # stands for a null id
MANY = 4096
#: What an entry's answer may be: seen once; its first place is here, or elsewhere; to be sorted; to be hashed.
NONE, FIRST, LATER, SORTED, HASHED = range(5)
#: With each distinct string after a trigger: the hash of its surroundings, how many of them the chunk has, whether it stands there twice, the least id.
SEEN = np.dtype([("whole", "<u8"), ("kinds", "<u2"), ("twice", "u1"), ("id", "<i8")])
#: With each entry that is to be sorted: the id and place of its first trigger, and the least and most bytes of a window before it.
ENTRY = np.dtype([("id", "<i8"), ("at", "<u4"), ("least", "u1"), ("most", "u1")])
#: With each window that is told apart by hashes: more of the hash, and the id.
PLACE = np.dtype([("tag", "<u4"), ("id", "<i8")])


def byte_sums(buf: np.ndarray) -> np.ndarray:
    up, _ = powers(BASE, len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return total


def string_hash(total: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    _, down = powers(BASE, len(total))
    with np.errstate(over="ignore"):
        return mix((total[high] - total[low]) * down[low] + (high - low).astype(np.uint64))


def parse_block(block: Texts, window: int) -> tuple[np.ndarray, ...]:
    """First and last window start of each phrase, its trigger, and the hashes of what follows that and of all its bytes."""
    buf, off = block.buf, block.off
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    data = buf.tobytes()
    mers = np.empty(n - MER + 1, np.uint64)
    for k in range(MER):
        count = (n - k) // MER
        mers[k::MER] = np.frombuffer(data, "<u8", count, k)[: len(mers[k::MER])]
    # 33 bits of hash, then the position: equal hashes fall to the left one
    least = (mix(mers) >> np.uint64(31) << np.uint64(31)) | np.arange(len(mers), dtype=np.uint64)
    width = 1
    while width < TRIGGERS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    starts = n - window + 1
    at = (least[:starts] & np.uint64((1 << 31) - 1)).astype(np.int64)
    valid = np.zeros(starts + 1, np.int32)
    fits = off[1:] - off[:-1] >= window
    np.add.at(valid, off[:-1][fits], 1)
    np.add.at(valid, off[1:][fits] - window + 1, -1)
    i = np.flatnonzero(np.cumsum(valid[:starts]) > 0)
    if not len(i):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.ones(len(i), bool)
    new[1:] = (at[i][1:] != at[i][:-1]) | (i[1:] != i[:-1] + 1)
    low = i[new]
    high = i[np.append(np.flatnonzero(new)[1:] - 1, len(i) - 1)]
    total = byte_sums(buf)
    trigger = at[low]
    right = window - TRIGGERS + 1
    return low, high, trigger, string_hash(total, trigger, trigger + right), string_hash(total, low, high + window)


class Phrases:
    """The phrases of a chunk whose rows are in the order of ids."""

    def __init__(self, rows: pa.Table, window: int):
        self.rows, self.window, self.texts = rows, window, table_texts(rows)
        parts = []
        for i, block in self.texts.blocks():
            *places, after, whole = parse_block(block, window)
            parts.append([p + self.texts.off[i] for p in places] + [after, whole])
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
        self.low, self.high, self.trigger, self.after, self.whole = (np.concatenate([np.zeros(0, k), *(p[j] for p in parts)]) for j, k in enumerate(kinds))
        self.ids = ids_of(rows)
        # the distinct strings after a trigger, each with its first phrase; and each phrase's place among them
        order, first, run = groups(self.after)
        self.keys, self.lead = self.after[order][first], order[first]
        self.back = np.empty(len(order), np.int64)
        self.back[order] = run

    def id_at(self, places: np.ndarray) -> np.ndarray:
        row = np.searchsorted(self.texts.off, places, side="right") - 1
        return self.ids[row] if len(row) else np.zeros(0, np.int64)

    def seen(self) -> np.ndarray:
        out = np.zeros(len(self.keys), SEEN)
        out["whole"] = self.whole[self.lead]
        pairs = np.lexsort((self.whole, self.back))
        b, w = self.back[pairs], self.whole[pairs]
        new = np.ones(len(pairs), bool)
        new[1:] = (b[1:] != b[:-1]) | (w[1:] != w[:-1])
        out["kinds"] = np.minimum(np.bincount(b[new], minlength=len(self.keys)), 65535)
        out["twice"] = np.bincount(self.back, minlength=len(self.keys)) > 1
        out["id"] = self.id_at(self.low[self.lead])
        return out

    def entries(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The phrases to be sorted, the first phrase of each distinct entry of them, and the entry of each."""
        some = np.flatnonzero(state == SORTED)
        order = some[np.lexsort((some, self.whole[some], self.after[some]))]
        a, w = self.after[order], self.whole[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
        return order, order[new], np.cumsum(new) - 1

    def told(self, lead: np.ndarray):
        """What is sent of the entries a to b."""
        facts = np.zeros(len(lead), ENTRY)
        facts["id"], facts["at"] = self.id_at(self.low[lead]), self.trigger[lead]
        facts["least"], facts["most"] = self.trigger[lead] - self.high[lead], self.trigger[lead] - self.low[lead]
        size = self.high[lead] - self.low[lead] + self.window
        end = np.cumsum(size)

        def some(a: int, b: int) -> bytes:
            n = size[a:b]
            at = np.repeat(self.low[lead[a:b]] - (end[a:b] - n), n) + np.arange(end[a] - size[a], end[b - 1])
            return by_weight(facts[a:b]) + self.texts.buf[at].tobytes()

        return some

    def hashed(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of windows that are told apart by hashes: starts, distinct hashes, the first window of each, and each one's place among them."""
        apart = np.flatnonzero(state == HASHED)
        size = self.high[apart] - self.low[apart] + 1
        starts = np.repeat(self.low[apart] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        starts.sort()
        found = [np.zeros(0, np.uint64)]
        for i, block in self.texts.blocks():
            a, b = np.searchsorted(starts, [self.texts.off[i], self.texts.off[i] + len(block.buf)])
            if b > a:
                at = starts[a:b] - self.texts.off[i]
                found.append(string_hash(byte_sums(block.buf), at, at + self.window))
        keys, first, back = np.unique(np.concatenate(found), return_index=True, return_inverse=True)
        return starts, keys, first, back

    def second_tag(self, starts: np.ndarray) -> np.ndarray:
        """32 bits of another hash of the window from each start: of its middle and ends."""
        buf, out = self.texts.buf, np.zeros(len(starts), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(0, self.window, 8):
                at = min(k, self.window - 8)
                piece = np.zeros(len(starts), np.uint64)
                for j in range(8):
                    piece = (piece << np.uint64(8)) | buf[starts + at + j]
                out = mix(out + piece)
        return (out >> np.uint64(32)).astype(np.uint32)


def ids_of(rows: pa.Table) -> np.ndarray:
    return pc.fill_null(rows.column("place").cast(pa.int64()), int(LAST)).to_numpy()


def in_order(rows: pa.Table) -> pa.Table:
    return rows.take(pa.array(np.argsort(ids_of(rows), kind="stable"))).combine_chunks()


def first_of_runs(new: np.ndarray, order: np.ndarray) -> np.ndarray:
    """True for the first entry of each run of a sorted order."""
    out = np.zeros(len(order), bool)
    out[order[new]] = True
    return out


def dictionary_states(keys: np.ndarray, chunk: np.ndarray, more: np.ndarray, many: int = MANY) -> np.ndarray:
    order = np.lexsort((chunk, more["id"], keys))
    k, m = keys[order], more[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first, run = np.flatnonzero(new), np.cumsum(new) - 1
    least, most = np.minimum.reduceat(m["whole"], first), np.maximum.reduceat(m["whole"], first)
    kinds = np.add.reduceat(m["kinds"].astype(np.int64), first)
    one = (least == most) & (np.maximum.reduceat(m["kinds"], first) == 1)
    twice = (np.diff(np.append(first, len(m))) > 1) | (np.maximum.reduceat(m["twice"], first) > 0)
    state = np.where(~twice, NONE, np.where(one, LATER, np.where(kinds <= many, SORTED, HASHED)))[run]
    out = np.empty(len(keys), np.uint8)
    out[order] = np.where(new & (state == LATER), FIRST, state)
    return out


def columns(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, step: int, keys: np.ndarray) -> np.ndarray:
    """One row of bytes for each start: its key, then `length` bytes from there on (or backwards), then zeros."""
    out = np.zeros((len(start), 8 + width), np.uint8)
    out[:, :8] = keys.astype(">u8").view(np.uint8).reshape(-1, 8)
    for k in range(width):
        inside = np.flatnonzero(length > k)
        out[inside, 8 + k] = data[start[inside] + step * k]
    return out


def sorted_strings(rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows as strings (of equal ones the shorter first), and what each has in common with the one before (-1: not even the key)."""
    order = np.argsort(length, kind="stable")
    order = order[np.argsort(rows.view(f"S{rows.shape[1]}").ravel()[order], kind="stable")]
    same = rows[order[1:]] == rows[order[:-1]]
    shared = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1)) - 8
    shared = np.minimum(shared, np.minimum(length[order[1:]], length[order[:-1]]))
    return order, np.concatenate([[-1], np.where(same[:, :8].all(axis=1), shared, -1)])[: len(order)]


def later_windows(keys: np.ndarray, chunk: np.ndarray, runs: tuple[np.ndarray, list[bytes]], window: int) -> np.ndarray:
    """For each entry, bit d is set if its window with d bytes before the trigger already stands in an earlier place."""
    sizes, blobs = runs
    facts = np.concatenate([from_weight(b[: n * ENTRY.itemsize], ENTRY) for n, b in zip(sizes.tolist(), blobs)])
    data = np.frombuffer(b"".join([b[n * ENTRY.itemsize :] for n, b in zip(sizes.tolist(), blobs)]), np.uint8)
    least, most = facts["least"].astype(np.int64), facts["most"].astype(np.int64)
    size = window + most - least
    trigger = np.cumsum(size) - size + most
    by_place = np.lexsort((facts["at"], chunk, facts["id"]))
    least, most, trigger, k = least[by_place], most[by_place], trigger[by_place], keys[by_place]
    parse = sorted_strings(columns(data, trigger, window - least, window, 1, k), window - least)
    words = sorted_strings(columns(data, trigger - 1, most, TRIGGERS - 1, -1, k), most)
    seen = np.zeros(len(k), np.uint64)
    after, before = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
    for d in range(int(least.min()), int(most.max()) + 1):
        has = np.flatnonzero((least <= d) & (most >= d))
        after[parse[0]] = np.cumsum(parse[1] < window - d)
        before[words[0]] = np.cumsum(words[1] < d)
        _, first = np.unique(after[has] * (len(k) + 1) + before[has], return_index=True)
        again = np.ones(len(has), bool)
        again[first] = False
        seen[has[again]] |= np.uint64(1) << np.uint64(d)
    out = np.empty(len(k), np.uint64)
    out[by_place] = seen
    return out


def first_of(keys: np.ndarray, chunk: np.ndarray, more: np.ndarray) -> np.ndarray:
    """1 for the entry of a window with the least id, then the least chunk."""
    order = np.lexsort((chunk, more["id"], more["tag"], keys))
    k, t = keys[order], more["tag"][order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    return first_of_runs(new, order).astype(np.uint8)


def remove_seen(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, chunk_bytes: int = 4 << 20, many: int = MANY) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept (binary: the bytes left; cuts may fall inside a character)."""
    shape = f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"

    def result(rows: pa.Table, texts: Texts, removed: np.ndarray) -> pa.Table:
        opens = removed.copy()
        opens[1:] &= ~removed[:-1]
        heads = texts.off[:-1][texts.off[:-1] < texts.off[1:]]
        opens[heads] = removed[heads]
        return pa.table([rows.column("id"), pa.array(np.diff(texts.off)), pa.array(per_row(removed, texts.off)), pa.array(per_row(opens, texts.off)), pa.array(left(texts, removed), pa.binary())], names=[key, "n_bytes", "n_removed", "n_spans", "kept"])

    return seen_before(placed(df.select(F.col(key).alias("id"), F.col(text).alias("text"))), result, shape, window, chunk_bytes, many)


def cut_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", size: str | None = "n_chars", window: int = WINDOW, chunk_bytes: int = 4 << 20) -> DataFrame:
    """The rows of df with their texts cut, and their number of characters in `size` if df has it.

    A character of which any byte is removed goes as a whole; null texts stay null.
    """

    def result(rows: pa.Table, texts: Texts, removed: np.ndarray) -> pa.Table:
        head = (texts.buf & 0xC0) != 0x80
        if len(head):
            removed = np.maximum.reduceat(removed, np.flatnonzero(head))[np.cumsum(head) - 1]
        was = rows.column("text").is_null().to_pylist()
        kept = pa.array([None if n else b for n, b in zip(was, left(texts, removed))], pa.string())
        whole = rows.column("row").combine_chunks()
        whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
        columns = []
        for i, field in enumerate(whole.type):
            if field.name == text:
                columns.append(kept)
            elif field.name == size:
                columns.append(pc.if_else(pa.array(was), whole.field(i), pc.utf8_length(kept).cast(field.type)))
            else:
                columns.append(whole.field(i))
        return pa.table(columns, names=[f.name for f in whole.type])

    others = [F.when(F.lit(False), F.col(c)).alias(c) if c == text else F.col(c) for c in df.columns]  # the text travels once
    return seen_before(placed(df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.struct(*others).alias("row"))).drop("id"), result, df.schema, window, chunk_bytes)


def placed(df: DataFrame) -> DataFrame:
    """df with `place`, whole numbers in the order of `id`: the ids themselves, or else the rows' numbers in that order."""
    if df.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return df.withColumn("place", F.col("id").cast("long"))
    return number_rows(df, F.col("id"), "place").withColumn("place", F.when(F.col("id").isNotNull(), F.col("place")))


def left(texts: Texts, removed: np.ndarray) -> list[bytes]:
    out = texts.buf[~removed].tobytes()
    at = np.concatenate([[0], np.cumsum(~removed)])[texts.off].tolist()
    return [out[a:b] for a, b in zip(at[:-1], at[1:])]


def seen_before(df: DataFrame, output, shape, window: int, chunk_bytes: int, many: int = MANY) -> DataFrame:
    """output(rows, texts, removed bytes) -> pa.Table in `shape`, for every chunk of df (id, text, ...)."""
    if window < TRIGGERS + MER:
        raise ValueError(f"window must be {TRIGGERS + MER} bytes or more")
    packed = pack(df, chunk_bytes)
    buckets = bucket_count(packed)

    def first(rows: pa.Table):
        phrases = Phrases(in_order(rows), window)
        yield 0, phrases.keys, phrases.seen()

    def second(rows: pa.Table, answers: Answers):
        phrases = Phrases(in_order(rows), window)
        state = answers.get(0, phrases.keys, np.uint8)[phrases.back]
        _, lead, _ = phrases.entries(state)
        yield 1, phrases.after[lead], phrases.told(lead)
        starts, keys, at, _ = phrases.hashed(state)
        more = np.zeros(len(keys), PLACE)
        more["tag"], more["id"] = phrases.second_tag(starts[at]), phrases.id_at(starts[at])
        yield 2, keys, more

    def result(rows: pa.Table, answers: Answers) -> pa.Table:
        phrases = Phrases(in_order(rows), window)
        n = len(phrases.texts.buf)
        change = np.zeros(n + 1, np.int32)

        def remove(begin: np.ndarray, end: np.ndarray) -> None:
            np.add.at(change, begin, 1)
            np.add.at(change, end + window, -1)

        state = answers.get(0, phrases.keys, np.uint8)[phrases.back]
        gone = (state == FIRST) | (state == LATER)
        gone[phrases.lead] &= state[phrases.lead] != FIRST
        remove(phrases.low[gone], phrases.high[gone])
        # phrases that were sorted: the first of each entry has its answer, the others come after it
        order, lead, _ = phrases.entries(state)
        later = np.setdiff1d(order, lead)
        remove(phrases.low[later], phrases.high[later])
        bits = answers.get(1, phrases.after[lead], np.uint64)
        size = phrases.high[lead] - phrases.low[lead] + 1
        start = np.repeat(phrases.low[lead] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        before = np.repeat(phrases.trigger[lead], size) - start
        again = (np.repeat(bits, size) >> before.astype(np.uint64)) & np.uint64(1) > 0
        remove(start[again], start[again])
        # windows that were hashed
        starts, keys, at, _ = phrases.hashed(state)
        first_here = np.zeros(len(starts), bool)
        first_here[at[answers.get(2, keys, np.uint8) > 0]] = True
        remove(starts[~first_here], starts[~first_here])
        return output(phrases.rows, phrases.texts, np.cumsum(change[:n]) > 0)

    found = cut(settle(ask(packed, first, buckets), {0: (lambda k, c, m: dictionary_states(k, c, m, many), SEEN)}))
    again = settle(ask_again(packed, found, second, buckets), {1: (lambda k, c, m: later_windows(k, c, m, window), bytes), 2: (first_of, PLACE)})
    return finish(packed, found.unionAll(again), result, buckets, shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_seen(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), c AS (
  SELECT doc_id, n, 1000 * j AS o, t[1000 * j + 1:1000 * j + 1099] AS part FROM (SELECT *, unnest(range(0, (n - 100) // 1000 + 1)) AS j FROM d WHERE n >= 100)
), w AS (
  SELECT doc_id, o, part, unnest(range(1, least(1000, n - 99 - o) + 1)) AS i FROM c
), f AS (
  SELECT doc_id, o + i AS i, row_number() OVER (PARTITION BY md5(part[i:i + 99]) ORDER BY doc_id, o + i) > 1 AS again FROM w
), m AS (
  SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) + 100 AS new FROM f WHERE again
), g AS (
  SELECT doc_id, i, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m
), r AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, k
), q AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS kept_from FROM r
  UNION ALL SELECT d.doc_id, n + 1, n + 1, coalesce(max(b), 1) FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, n
), h AS (
  SELECT q.doc_id, sum(b - a) AS gone, count(*) - 1 AS spans, string_agg(CASE WHEN a > kept_from THEN hex(t[kept_from:a - 1]) ELSE '' END, '' ORDER BY a, b) AS kept FROM q JOIN d USING (doc_id) GROUP BY q.doc_id
)
SELECT doc_id, n AS n_bytes, gone::BIGINT AS n_removed, spans AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN h USING (doc_id)
"""
