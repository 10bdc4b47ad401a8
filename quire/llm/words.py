"""Vectorised tokenising and hashing of UTF-8 text held in Arrow buffers.

All word classes used here are unions of ASCII bytes and all non-ASCII bytes, so
they can be matched byte by byte on UTF-8 without decoding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15  # what hashes begin with
WBASE = 0xD1342543DE82EF95  # odd multiplier of hashes and of the word polynomial
SPAN = 64  # bytes of a span that are hashed for all spans at once
TAILS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # the first k of eight bytes


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for every byte outside the given inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in excluded:
        table[low : high + 1] = False
    return table


def alnum_class() -> np.ndarray:
    """`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`: lower-case ASCII letters, digits, all non-ASCII."""
    return byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def nonspace_class() -> np.ndarray:
    """`[^\\x20\\x09-\\x0D]`"""
    return byte_class([(0x20, 0x20), (0x09, 0x0D)])


def ascii_lower(buf: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[buf]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: int, n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """base^i and base^-i modulo 2^64 for i < n."""
    if base not in cache or len(cache[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        up[0] = down[0] = 1
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            k = 1
            while k < size:
                up[k : 2 * k] = up[:k] * np.uint64(pow(base, k, 1 << 64))
                down[k : 2 * k] = down[:k] * np.uint64(pow(inverse, k, 1 << 64))
                k *= 2
        cache[base] = (up, down)
    return cache[base]


class Texts:
    """The texts of an Arrow column: one byte buffer and offsets. Null counts as empty."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off

    def __len__(self) -> int:
        return len(self.off) - 1

    def raw(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()

    def blocks(self, limit: int = 1 << 20):
        """(first row, Texts) of runs of whole texts of about `limit` bytes."""
        i, n = 0, len(self)
        while i < n:
            j = int(np.searchsorted(self.off, self.off[i] + limit, side="right")) - 1
            j = min(max(j, i + 1), n)
            off = self.off[i : j + 1]
            yield i, Texts(self.buf[off[0] : off[-1]], off - off[0])
            i = j


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_binary())
    if column.null_count or not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(buf[off[0] : off[-1]], off - off[0])


def spans(texts: Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the offsets of each text's words in them."""
    flag = table[texts.buf]
    if not len(flag):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(texts) + 1, np.int64)
    before, after = np.zeros(len(flag), bool), np.zeros(len(flag), bool)
    before[1:], after[:-1] = flag[:-1], flag[1:]
    full = texts.off[1:] > texts.off[:-1]
    before[texts.off[:-1][full]] = False
    after[texts.off[1:][full] - 1] = False
    starts, ends = np.flatnonzero(flag & ~before), np.flatnonzero(flag & ~after) + 1
    return starts, ends, np.searchsorted(starts, texts.off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: eight bytes at a time go through mix(), longer spans than SPAN through xxh3.

    No sum of powers is involved, so strings of a regular build (Thue-Morse strings, say) collide no oftener than others.
    """
    size = ends - starts
    h = mix(size.astype(np.uint64) ^ np.uint64(BASE))
    if not len(starts):
        return h
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", buffer=padded, strides=(1,))  # the eight bytes from each place
    with np.errstate(over="ignore"):
        live = np.flatnonzero((size > 0) & (size <= SPAN))
        at = 0
        while len(live):
            left = size[live] - at
            part = eight[starts[live] + at] & TAILS[np.minimum(left, 8)]
            h[live] = mix(h[live] * np.uint64(WBASE) ^ part)
            at += 8
            live = live[left > 8]
    for i in np.flatnonzero(size > SPAN).tolist():
        h[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return h


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive entries; the caller drops those that cross texts."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if n <= 4:
            h = words[: len(words) - n + 1].copy()
            for k in range(1, n):
                h = mix(h * np.uint64(WBASE) + words[k : len(words) - n + 1 + k])
            return h
        up, down = powers(WBASE, len(words) + 1)
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=total[1:])
        count = len(words) - n + 1
        return mix((total[n:] - total[:count]) * down[:count] + np.uint64(n))


def gram_starts(word_off: np.ndarray, n: int) -> np.ndarray:
    """True where n words from here stay inside one text; one entry for each possible start."""
    count = int(word_off[-1]) - n + 1
    if count <= 0:
        return np.zeros(0, bool)
    ok = np.ones(count, bool)
    for back in range(1, n):
        at = word_off[1:-1] - back
        at = at[(at >= 0) & (at < count)]
        # a start `back` words before a text's first word lies in an earlier text
        ok[at] = False
    return ok


def owner(off: np.ndarray) -> np.ndarray:
    """The row of each element, from offsets."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))
