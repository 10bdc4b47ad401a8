"""Measurements of documents, made block by block on Arrow buffers."""

from __future__ import annotations

import numpy as np

from quire.llm.words import BASE, Texts, ascii_lower, gram_hashes, gram_starts, mix, nonspace_class, owner, spans, word_hashes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_same_as_before", "n_caps_words", "n_distinct_words", "n_upper", "n_digits", "n_stops", "n_chars", "n_bytes")


def only(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def per_row(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of x between offsets."""
    total = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def distinct_per_row(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    if not len(rows):
        return np.zeros(n, np.int64)
    key = mix(values + rows.astype(np.uint64) * np.uint64(BASE))
    _, first = np.unique(key, return_index=True)
    return np.bincount(rows[first], minlength=n)


def repeated(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """True for entries whose value occurs again in the same row."""
    if not len(rows):
        return np.zeros(0, bool)
    key = mix(values + rows.astype(np.uint64) * np.uint64(BASE))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[back] > 1


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """True for the positions in [s, s + width) of any start s."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return np.cumsum(change[:n]) > 0


def lines(texts: Texts, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every \\n-split line that holds a word."""
    buf, off = texts.buf, texts.off
    if not len(word_starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    breaks = np.flatnonzero(buf == 10)
    full = off[:-1] < off[1:]
    begin = np.union1d(off[:-1][full], breaks + 1)
    begin = begin[begin < len(buf)]
    # a line ends at its line feed, or where the next text begins
    end = np.append(begin[1:], len(buf))
    end = end - (buf[end - 1] == 10)
    end = np.maximum(end, begin)
    held = np.searchsorted(word_starts, end) > np.searchsorted(word_starts, begin)
    begin, end = begin[held], end[held]
    h = word_hashes(buf, begin, end)
    return np.searchsorted(off, begin, side="right") - 1, h


def measure(texts: Texts, repeat: int = 8) -> dict[str, np.ndarray]:
    """MEASURES of each text; the words are `[^\\x20\\x09-\\x0D]+`."""
    n, buf, off = len(texts), texts.buf, texts.off
    starts, ends, word_off = spans(texts, nonspace_class())
    rows = owner(word_off)
    hashes = word_hashes(buf, starts, ends)
    point = (buf & 0xC0) != 0x80  # first byte of a code point
    inside = nonspace_class()[buf]
    upper, lower = (buf >= 65) & (buf <= 90), (buf >= 97) & (buf <= 122)
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    u, lo = sums(upper), sums(lower)
    grams = gram_hashes(hashes, repeat)
    ok = np.flatnonzero(gram_starts(word_off, repeat))
    twice = ok[repeated(rows[ok], grams[ok])] if len(ok) else ok
    line_rows, line_hashes = lines(texts, starts)
    folded = word_hashes(ascii_lower(buf), starts, ends)
    same = np.zeros(len(starts), bool)
    same[1:] = (folded[1:] == folded[:-1]) & (rows[1:] == rows[:-1])
    n_lines = np.bincount(line_rows, minlength=n)
    return {
        "n_words": np.diff(word_off),
        "word_chars": per_row(point & inside, off),
        "n_symbols": per_row(only(b"#*$%&|<>")[buf], off),
        "n_lines": n_lines,
        "n_dup_lines": n_lines - distinct_per_row(line_rows, line_hashes, n),
        "n_repeat_words": per_row(covered(twice, repeat, len(starts)), word_off),
        "n_same_as_before": per_row(same, word_off),
        "n_caps_words": per_row((u[ends] - u[starts] >= 2) & (lo[ends] == lo[starts]), word_off),
        "n_distinct_words": distinct_per_row(rows, folded, n),
        "n_upper": per_row(upper, off),
        "n_digits": per_row((buf >= 48) & (buf <= 57), off),
        "n_stops": per_row(only(b".!?")[buf], off),
        "n_chars": per_row(point, off),
        "n_bytes": np.diff(off),
    }


def measure_all(texts: Texts) -> dict[str, np.ndarray]:
    parts = [measure(block) for _, block in texts.blocks()]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in MEASURES}


