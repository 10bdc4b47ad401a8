"""Compression of vectors to codes of a few bytes, in whole numbers.

Components become floor(SCALE * x). A vector is cut into PARTS equal parts, and each part becomes the number of
its nearest entry in the codebook of its position. Codebooks begin with the parts of the vectors with the
smallest ids; each round assigns every part and replaces an entry by the mean of its parts, rounded down.

The codebooks (PARTS * ENTRIES entries whatever the table) are broadcast. A task computes the distances of a batch to all
entries by |x|^2 - 2xc + |c|^2 with matrix products and takes the first least one. It adds up its parts by
entry, so that it sends at most PARTS * ENTRIES rows, however many copies a vector has; a grouped sum merges these.
Only the merged sums, which have that size as well, come to the driver.

Products are exact: int64 as long as no sum can reach 2^62, and Python's whole numbers for components beyond that. Where no
sum can reach 2^53, the product is made in float64, where it has the same integers, several times as fast.

Vectors that are null or hold null or non-finite components are dropped. Vectors of another length than the one with the
smallest id take no part and get null code and error; an error that no long can hold is null, and a sum of errors as well. Null ids come last. Equal ids are ordered by their
vectors, and each row has its result. Null labels count as one label. With fewer vectors than
ENTRIES, codebooks have as many entries as there are vectors. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import cut
from quire.llm.terms import met

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
STEP = 2048  # vectors whose distances are computed at once


def largest(x: np.ndarray) -> int:
    return max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0)


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as int64 where that holds them."""
    scaled = np.floor(x * float(SCALE))
    return scaled.astype(np.int64) if np.abs(scaled).max(initial=0) < 2.0**62 else np.array([int(v) for v in scaled.ravel()], object).reshape(x.shape)


def product(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x times the transpose of c, exactly."""
    bound = largest(x) * largest(c) * max(1, x.shape[1])
    if bound < 1 << 53:
        return (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return x @ c.T


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest of the rows c to each row of x, and its squared distance."""
    if max(largest(x), largest(c)) ** 2 * 4 * max(1, x.shape[1]) >= 1 << 62:
        x, c = x.astype(object), c.astype(object)
    d = (c * c).sum(axis=1)[None, :] - 2 * product(x, c)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at] + (x * x).sum(axis=1)


def slices(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, whole components) of a list column whose lists all have this width."""
    for at in range(0, len(column), STEP):
        part = column.slice(at, STEP)
        yield at, whole(part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), width))


def sums_of_parts(vectors: DataFrame, books, width: int) -> DataFrame:
    """part, entry, n, s0, s1, ..: the number and the componentwise sums of the parts of each entry, for each task."""
    w = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        k = len(book[0])
        n, total = np.zeros((PARTS, k), np.int64), np.zeros((PARTS, k, w), object)
        for batch in batches:
            for _, x in slices(batch.column(0), width):
                for p in range(PARTS):
                    mine = x[:, p * w : (p + 1) * w]
                    at, _ = nearest(mine, book[p])
                    order = np.argsort(at, kind="stable")
                    first = np.flatnonzero(np.diff(at[order], prepend=-1))
                    entry = at[order][first]
                    n[p, entry] += np.diff(np.append(first, len(at)))
                    small = mine.dtype == object or largest(mine) * STEP < 1 << 62
                    total[p, entry] += np.add.reduceat(mine[order] if small else mine[order].astype(object), first, axis=0)
        p, entry = np.nonzero(n)
        columns = [pa.array(p, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[p, entry])]
        sums = [pa.array([int(v) for v in total[p, entry, i]], pa.decimal128(38, 0)) for i in range(w)]
        yield pa.RecordBatch.from_arrays([*columns, *sums], names=["part", "entry", "n", *(f"s{i}" for i in range(w))])

    return vectors.mapInArrow(run, "part int, entry int, n long" + "".join(f", s{i} decimal(38,0)" for i in range(w)))


def next_books(books: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """Each entry by the mean of its parts, rounded down; entries without parts stay."""
    names = [c for c in sums.columns if c.startswith("s")]
    new = [b.astype(object) for b in books]
    for row in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).collect():  # PARTS * ENTRIES rows at most
        new[row["part"]][row["entry"]] = [int(row[c]) // row["n"] for c in names]
    return [narrow(b) for b in new]


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if largest(x) < 1 << 62 else x


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has finite components only."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False)))


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """The rows of df with a usable vector as (row: all columns, code: bytes, error), and the codebooks by part."""
    spark = df.sparkSession
    rows = usable(df.select(F.struct("*").alias("row"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")), "vector")
    order = [F.col("id").asc_nulls_last(), "vector"]
    least = rows.orderBy(*order).select("vector").limit(1).collect()
    width = len(least[0][0]) if least else 0
    if width % PARTS:
        raise ValueError(f"vectors of {width} components have no {PARTS} equal parts")
    fit = rows.where(F.size("vector") == width)
    first = fit.orderBy(*order).select("vector").limit(entries).collect()
    begin = whole(np.array([r[0] for r in first], np.float64).reshape(len(first), width))
    w = width // PARTS
    books = [begin[:, p * w : (p + 1) * w] for p in range(PARTS)]
    for _ in range(rounds if len(begin) else 0):
        shared = spark.sparkContext.broadcast(books)
        books = next_books(books, sums_of_parts(fit.select("vector"), shared, width))
    final = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = final.value
        for batch in batches:
            fits = pc.equal(pc.list_value_length(batch.column(1)), width)
            code, error = np.zeros((pc.sum(fits).as_py() or 0, PARTS), np.uint8), []
            for at, x in slices(batch.column(1).filter(fits), width):
                found = [nearest(x[:, p * w : (p + 1) * w], book[p]) for p in range(PARTS)]
                code[at : at + len(x)] = np.stack([f[0] for f in found], axis=1)
                error += [v if v < 1 << 63 else None for v in sum(f[1] for f in found).tolist()]
            place = pa.array(np.cumsum(fits.to_numpy(zero_copy_only=False)) - 1, mask=~fits.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()).take(place), pa.array(error, pa.int64()).take(place)], names=["row", "code", "error"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", "vector").mapInArrow(run, f"row {kind}, code binary, error long"), books


def with_label_errors(rows: DataFrame, label: str) -> DataFrame:
    """Adds label_error, the sum of `error` over all rows of a label; nulls are a label."""
    kind = rows.schema[label].dataType
    keyed = rows.select("*", F.col(label).isNull().alias("label_none"), F.coalesce(F.col(label), F.lit("0").cast(kind)).alias("label_key"))
    sums = cut(keyed.groupBy("label_none", "label_key").agg(F.try_sum("error").alias("label_error")))
    return met(keyed, sums, ["label_none", "label_key"]).drop("label_none", "label_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code (hex), error, label_error, codebooks_sha256"""
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))
    rows = cut(coded.select(F.col("row.vec_id").alias("vec_id"), F.col("row.label").alias("label"), F.lower(F.hex("code")).alias("code"), "error"))
    return with_label_errors(rows, "label").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle() -> str:
    """The rounds, one after the other, in SQL."""
    distance = "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))::HUGEINT"
    parts = [
        "k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS c FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS MATERIALIZED (SELECT r, p, c[p * (len(c) // 4) + 1 : (p + 1) * (len(c) // 4)] AS v FROM k, range(4) AS t(p))",
        "b0 AS MATERIALIZED (SELECT p, e, v FROM (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k) JOIN x USING (r) WHERE e < 256)",
    ]
    for n in range(ROUNDS + 1):
        # 256 * distance + entry: its least value is the first nearest entry
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, p, m % 256 AS e, m // 256 AS d FROM (SELECT a.r, a.p, min({distance} * 256 + b.e) AS m FROM x a JOIN b{n} b ON a.p = b.p GROUP BY a.r, a.p))")
        if n < ROUNDS:
            parts.append(
                f"b{n + 1} AS MATERIALIZED (SELECT p, b.e, coalesce(m.v, b.v) AS v FROM b{n} b LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v"
                f" FROM (SELECT p, e, i, sum(y)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT a.p, a.e, unnest(v) AS y, unnest(range(len(v))) AS i FROM a{n} a JOIN x ON x.r = a.r AND x.p = a.p) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))"
            )
    parts.append(f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS s FROM b{ROUNDS})")
    parts.append(f"o AS (SELECT r, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)")
    return "WITH " + ",\n".join(parts) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h.s AS codebooks_sha256 FROM k JOIN o USING (r), h"


ORACLE = oracle()
