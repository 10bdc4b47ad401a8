import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import op12_codes

SCHEMA = "vec_id long, embedding array<double>, label string, code string, error string, row string, vector string"


def brute(rows, entries, rounds=4):
    """Plain loops over whole numbers."""
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(ok[0][1]) if ok else 0
    fit = [(i, [math.floor(1024 * x) for x in r[1]]) for i, r in enumerate(ok) if len(r[1]) == width]
    w = width // 4
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(4)]
    books = [[cut(v)[p] for _, v in fit[:entries]] for p in range(4)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, a: min(range(len(books[p])), key=lambda e: (apart(a, books[p][e]), e))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(4):
            held = {}
            for _, v in fit:
                held.setdefault(nearest(p, cut(v)[p]), []).append(cut(v)[p])
            for e, vs in held.items():
                new[p][e] = [sum(c) // len(vs) for c in zip(*vs)]
        books = new
    out = []
    codes = {i: [nearest(p, cut(v)[p]) for p in range(4)] for i, v in fit}
    errors = {i: sum(apart(cut(v)[p], books[p][codes[i][p]]) for p in range(4)) for i, v in fit}
    for i, r in enumerate(ok):
        total = [errors[j] for j, o in enumerate(ok) if o[2] == r[2] and j in errors]
        out.append((r[0], "".join("%02x" % e for e in codes[i]) if i in codes else None, errors.get(i), sum(total) if total else None))
    return sorted(out, key=repr), books


def found(spark, rows, entries=256, parts=3):
    df = spark.createDataFrame([(i, v, label, "a", "b", "c", "d") for i, v, label in rows], SCHEMA).repartition(parts)
    coded, books = op12_codes.compress(df, entries=entries)
    out = op12_codes.with_label_errors(coded.select("row.vec_id", "row.label", F.lower(F.hex("code")).alias("code"), "error"), "label")
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out.collect()), key=repr), [b.tolist() for b in books]


def vectors(n, width, spread=1.0):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, spread) for _ in range(width)], rng.choice(["a", "b", None])) for i in range(n)]
    rows += [(5, rows[7][1], "a")] * 3 + [(None, rows[2][1], None), (-4, [0.0] * width, "a"), (-4, [-0.1] * width, "b")]
    rows += [(1000, None, "a"), (1001, [None] + [0.0] * (width - 1), "b"), (1002, [math.nan] * width, "a"), (1003, [math.inf] + [0.0] * (width - 1), None), (1004, [1.0] * (width + 4), "c"), (1005, [], "a")]
    rows += [(2000 + i, rows[3][1], "b") for i in range(40)]  # copies
    return rows


@pytest.mark.parametrize("n, width, entries, spread", [(60, 8, 256, 1.0), (150, 8, 6, 0.01), (40, 4, 5, 1e6), (30, 8, 4, 1e9), (9, 0, 4, 1.0)])
def test_against_brute_force(spark, n, width, entries, spread):
    rows = vectors(n, width, spread) if width else [(i, [], "a") for i in range(9)]
    if spread == 1e9:  # beyond int64 products, in two clusters
        rng = random.Random(1)
        rows = [(i, [(i % 2 * 2 - 1) * 2e9 + rng.random() for _ in range(width)], "ab"[i % 3 > 0]) for i in range(n)]
    want, books = brute(rows, entries)
    got, mine = found(spark, rows, entries)
    assert mine == books
    assert got == want


def test_exact_beyond_int64():
    x = np.array([[1 << 40, -(1 << 40)], [3, 1 << 50]])
    c = np.array([[(1 << 40) + 1, -(1 << 40)], [0, 1 << 50]])
    at, d = op12_codes.nearest(x, c)
    assert at.tolist() == [0, 1] and d.tolist() == [1, 9]
    assert op12_codes.whole(np.array([[1e30]])).tolist() == [[math.floor(1e30 * 1024)]]


def test_empty_tables_and_odd_widths(spark):
    assert found(spark, [], parts=1)[0] == []
    assert found(spark, [(1, None, "a"), (2, [math.nan] * 4, "b")], parts=1)[0] == []
    with pytest.raises(ValueError):
        found(spark, [(1, [1.0, 2.0, 3.0], "a")])


def test_digest_and_query(spark):
    assert len(op12_codes.digest([np.array([[1, -2]]), np.array([[3, 4]])])) == 64 and zlib.crc32(b"1,-2,3,4")
    rows = op12_codes.query(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 500 and len({r.codebooks_sha256 for r in rows}) == 1 and all(len(r.code) == 8 for r in rows)
