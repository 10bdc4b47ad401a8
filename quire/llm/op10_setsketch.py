"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct word shingles. Equal sets make one class. A class has
REGISTERS registers: the least of an exponential variate over its shingles, on a scale of
powers of BASE_B and truncated to 16 bits. Registers of a union are the maxima of registers,
so sketches merge; two sets agree in a register about as often as their Jaccard similarity.

1. Band: the registers in bands of as many as miss a link at the threshold with less than
   MISS. Classes that share a band are linked to its least
   member, and the components of these links are clusters: any two classes that share a
   band are in one cluster, without a pair of them being written out.
2. Estimate: inside a cluster, the joint likelihood of two sketches, given both set sizes,
   tells whether the most likely similarity is within SLACK of the threshold. Classes with no such partner
   are left out.
3. Verify: the full sets of the rest are compared exactly; only a spanning forest of the
   links leaves a task.

Clusters are cut into blocks of about BLOCK classes, and each pair of blocks is one task,
so no task holds a large cluster. With 5 registers a band, two sets at 0.85 share no band with
probability (1 - 0.85^5)^24 = 8e-7; with 4, two sets at 0.8 with (1 - 0.8^4)^30 = 1e-7. The
estimate loses such a pair with about 1e-8.

Nulls: a null text has an empty set, linked with nothing, as has a text without words. Null
ids count as larger than all others; a component of null ids only has a null component_id
and keeps its rows. Rows with equal ids are documents of their own. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.components import DEAL, components
from quire.llm.shared import cut
from quire.llm.words import Texts, ascii_lower, gram_hashes, gram_starts, mix, nonspace_class, owner, spans, texts_of, word_hashes

SHINGLE, PERCENT = 5, 80
REGISTERS = 120
MISS = 1e-6
BASE_B, RATE, TOP = 1.001, 20.0, 65535
SLACK = 0.2
BLOCK = 512


def rows_of_band(percent: int) -> int:
    """The most registers in a band that still miss a link at the threshold with less than MISS."""
    return max(r for r in range(1, REGISTERS + 1) if REGISTERS % r == 0 and (r == 1 or (1 - (percent / 100) ** r) ** (REGISTERS // r) < MISS))


def shingle_sets(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and the texts' offsets in them."""
    out, counts = [np.zeros(0, np.uint64)], []
    for _, block in texts.blocks():
        starts, ends, off = spans(block, nonspace_class())
        words = word_hashes(ascii_lower(block.buf), starts, ends)
        at = np.flatnonzero(gram_starts(off, width))
        rows, h = owner(off)[at] if len(at) else at, gram_hashes(words, width)[at] if len(at) else np.zeros(0, np.uint64)
        size = np.diff(off)
        for k in range(1, width):  # fewer words: the whole sequence is one shingle
            short = np.flatnonzero(size == k)
            if len(short):
                rows = np.concatenate([rows, short])
                h = np.concatenate([h, mix(gram_hashes(words, k)[off[:-1][short]] + np.uint64(k))])
        order = np.lexsort((h, rows))
        rows, h = rows[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
        out.append(h[new])
        counts.append(np.bincount(rows[new], minlength=len(block)))
    return np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))]).astype(np.int64)


def registers(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """REGISTERS 16-bit registers of every non-empty set (zeros for an empty one)."""
    full = off[1:] > off[:-1]
    out = np.zeros((len(off) - 1, REGISTERS), np.uint16)
    if not len(h):
        return out
    heads = off[:-1][full]
    seeds = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64))
    least = np.empty((REGISTERS, len(heads)), np.float64)
    with np.errstate(over="ignore"):
        for i in range(REGISTERS):
            least[i] = np.minimum.reduceat((h ^ seeds[2 * i]) * (seeds[2 * i + 1] | np.uint64(1)), heads)
    u = (least + 1.0) / 2.0**64
    value = np.floor(1.0 - np.log(-np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE) / np.log(BASE_B))
    out[full] = np.clip(value, 0, TOP).T.astype(np.uint16)
    return out


def sketch(df: DataFrame, width: int) -> DataFrame:
    """id, n (set size), k1, k2 (128 bits of the set), regs, body (compressed text); df has id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for first, part in texts.blocks():
                h, off = shingle_sets(part, width)
                full = off[1:] > off[:-1]
                keys = np.zeros((2, len(part)), np.uint64)
                for k in range(2):
                    if len(h):
                        keys[k][full] = np.add.reduceat(mix(h + np.uint64(k + 1)), off[:-1][full])
                regs = registers(h, off)
                body = [squeeze.compress(part.raw(i)) if full[i] else None for i in range(len(part))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), pa.array(np.diff(off)), *(pa.array(k.view(np.int64)) for k in keys), pa.array([r.tobytes() for r in regs], pa.binary()), pa.array(body, pa.binary())],
                    names=["id", "n", "k1", "k2", "regs", "body"],
                )

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, n long, k1 long, k2 long, regs binary, body binary")


def bands(classes: DataFrame, size: int) -> DataFrame:
    """(band, cls): one row for each band of `size` registers of a class."""
    count = REGISTERS // size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS).astype(np.uint64)
            keys = [gram_hashes(mix(regs[:, b * size : (b + 1) * size] + np.uint64(b << 16)).ravel(), size)[::size] for b in range(count)] if len(regs) else []
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)), pa.array(np.tile(batch.column(0).to_numpy(), count))], names=["band", "cls"])

    return classes.select("cls", "regs").mapInArrow(run, "band long, cls long")


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, floor: float) -> np.ndarray:
    """Whether the joint likelihood's best similarity is `floor` or more, for all pairs of rows.

    The log-likelihood is concave in the similarity, so its slope at `floor` decides.
    """
    above, below = np.zeros((len(a), len(b)), np.int16), np.zeros((len(a), len(b)), np.int16)
    for k in range(REGISTERS):
        x, y = a[:, k][:, None], b[:, k][None, :]
        above += x > y
        below += x < y
    u = n_a[:, None] / (n_a[:, None] + n_b[None, :])
    v = 1.0 - u
    c = (BASE_B - 1.0) / BASE_B
    slope = lambda x: c / (1.0 - c * x) / np.log(BASE_B)
    p = lambda x: -np.log1p(-c * x) / np.log(BASE_B)
    x, y = np.maximum(u - v * floor, 1e-9), np.maximum(v - u * floor, 1e-9)
    same = REGISTERS - above - below
    up = same * (v * slope(x) + u * slope(y)) / np.maximum(1.0 - p(x) - p(y), 1e-9)
    down = above * v * slope(x) / p(x) + below * u * slope(y) / p(y)
    fits = np.minimum(u, v) >= floor * np.maximum(u, v)  # else the sizes alone rule it out
    return (up >= down) & fits


def sized(members: DataFrame, block: int) -> DataFrame:
    """Adds blocks, how many a class's cluster is cut into. Only clusters of more than one block are looked up, and
    their classes are dealt over DEAL tasks for that."""
    large = members.groupBy("cluster").agg(F.ceil(F.count("*") / block).alias("more")).where("more > 1")
    copies = large.select("cluster", "more", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEAL - 1).cast("long"))).alias("part"))
    part = F.pmod(F.xxhash64("cls"), F.lit(DEAL)).alias("part")
    return members.select("cluster", "cls", part).join(copies, ["cluster", "part"], "left").select("cluster", "cls", F.coalesce("more", F.lit(1).cast("long")).alias("blocks"))


def in_blocks(members: DataFrame) -> DataFrame:
    """For blocks: pair (cluster and two of its blocks, one key, so that Spark deals a cluster's pairs over tasks) for
    each pair that the class's block takes part in, and on which sides of the pair the class is."""
    whole = [c for c in members.columns if c not in ("cluster", "blocks")]
    mine = F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("mine")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    met = members.select("cluster", "blocks", *whole, mine).select("cluster", *whole, "mine", other)
    pair = F.struct("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).alias("pair")
    return met.select(pair, *whole, (F.col("mine") <= F.col("other")).alias("first"), (F.col("mine") >= F.col("other")).alias("second"))


def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two blocks of a group (one block: both sides are all rows)."""
    first, second = (np.flatnonzero(table.column(c).to_numpy()) for c in ("first", "second"))
    return first, second


def plausible(members: DataFrame, floor: float) -> DataFrame:
    """Of members (cluster, cls, blocks, n, regs), the classes (cluster, cls) with a partner in their cluster that may be similar enough."""

    def run(table: pa.Table) -> pa.Table:
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        n, cls = table.column("n").to_numpy().astype(np.float64), table.column("cls").to_numpy()
        a, b = sides(table)
        found = np.zeros(len(cls), bool)
        for at in range(0, len(a), 256):
            part = a[at : at + 256]
            ok = likely(regs[part], regs[b], n[part], n[b], floor) & (cls[part][:, None] != cls[b][None, :])
            found[part[ok.any(axis=1)]] = True
            found[b[ok.any(axis=0)]] = True
        got = table.filter(pa.array(found))
        return pa.table([pc.struct_field(got.column("pair"), "cluster"), got.column("cls")], names=["cluster", "cls"])

    return in_blocks(members).groupBy("pair").applyInArrow(run, "cluster long, cls long").distinct()


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of sets a with sets b."""
    used = np.union1d(a, b)
    flat = np.concatenate([sets[i] for i in used])
    row = np.repeat(used, [len(sets[i]) for i in used])
    values, back, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1  # a shingle of one set alone is in no intersection
    keep = count[back] > 1
    column, row = rank[back[keep]], row[keep]
    out = np.zeros((len(a), len(b)))
    place_a, place_b = np.full(len(sets), -1), np.full(len(sets), -1)
    place_a[a], place_b[b] = np.arange(len(a)), np.arange(len(b))
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for low in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        s = slice(*np.searchsorted(column, [low, low + width]))
        pair = []
        for place, n in ((place_a, len(a)), (place_b, len(b))):
            dense = np.zeros((n, width), np.float32)
            r = place[row[s]]
            dense[r[r >= 0], column[s][r >= 0] - low] = 1
            pair.append(dense)
        out += pair[0] @ pair[1].T
    return out


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least member of each element's component under the links x-y."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verified(members: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) between classes of members (cluster, cls, blocks, body) of 100 * intersection >= percent * union, enough to connect each component."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cls").combine_chunks()
        expand = zstandard.ZstdDecompressor()
        bodies = [expand.decompress(b) for b in table.column("body").to_pylist()]
        h, off = shingle_sets(texts_of(pa.array(bodies, pa.large_binary())), width)
        sets = [h[p:q] for p, q in zip(off[:-1], off[1:])]
        n, cls = np.diff(off), table.column("cls").to_numpy()
        a, b = sides(table)
        both = intersections(sets, a, b)
        linked = 100 * both >= percent * (n[a][:, None] + n[b][None, :] - both)
        x, y = np.nonzero(linked)
        root = forest(len(cls), a[x], b[y])
        moved = np.flatnonzero(root != np.arange(len(cls)))
        return pa.table([pa.array(cls[moved]), pa.array(cls[root[moved]])], names=["a", "b"])

    return in_blocks(members).groupBy("pair").applyInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """key, n_shingles, component_id (least key of the component), kept."""
    rows = cut(sketch(df.select(F.col(key).alias("id"), F.col(text).alias("text")), width)).withColumn("row", F.monotonically_increasing_id())
    classes = cut(rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("row").alias("cls"), F.min("id").alias("low"), F.first("regs").alias("regs")))
    banded = bands(classes, rows_of_band(percent))
    hubs = banded.groupBy("band").agg(F.min("cls").alias("hub"), F.count("*").alias("size")).where("size > 1").select("band", "hub")
    links = banded.join(hubs, "band").where("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    clustered = with_roots(components(links), "cluster")
    likely_ones = cut(plausible(sized(clustered, block).join(classes.select("cls", "n", "regs"), "cls"), percent / 100 - SLACK))
    held = cut(sized(likely_ones, block).join(rows.select(F.col("row").alias("cls"), "body"), "cls"))
    roots = components(verified(held, percent, width))
    named = classes.select("k1", "k2", "n", F.col("cls").alias("a"), "low").join(roots, "a", "left").select("k1", "k2", "n", "low", F.coalesce("root", "a").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = named.join(least, "root").select("k1", "k2", "n", "component_id", F.lit(True).alias("found"))
    joined = rows.select("id", "k1", "k2", "n").join(ids, ["k1", "k2", "n"], "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def with_roots(found: DataFrame, name: str) -> DataFrame:
    """(cls, name) for all nodes, roots themselves included."""
    return found.select(F.col("a").alias("cls"), F.col("root").alias(name)).unionAll(found.select(F.col("root").alias("cls"), F.col("root").alias(name)).distinct())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85, width=3)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), x AS (
  SELECT doc_id, unnest(ws) AS x, unnest(range(len(ws))) AS i, len(ws) AS n FROM w
), v AS (
  SELECT doc_id, i, n, concat_ws(' ', x, lead(x) OVER p, lead(x, 2) OVER p) AS x FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), y AS (
  SELECT doc_id, x FROM v WHERE i = 0 OR i <= n - 3 GROUP BY ALL
), s AS (
  SELECT doc_id, coalesce(g, []) AS g FROM w LEFT JOIN (SELECT doc_id, list(x ORDER BY x) AS g FROM y GROUP BY doc_id) USING (doc_id)
), c AS (
  SELECT md5(array_to_string(g, chr(10))) AS k, min(doc_id) AS cls, any_value(g) AS g, len(any_value(g)) AS n FROM s WHERE len(g) > 0 GROUP BY 1
), u AS (
  SELECT cls, n, unnest(g) AS x FROM c
), p AS (
  SELECT a.cls AS a, b.cls AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM u a JOIN u b ON a.x = b.x AND a.cls < b.cls AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p WHERE 100 * common >= 85 * (na + nb - common)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT cls AS a, cls AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), m AS (
  SELECT a AS cls, min(b) AS component_id FROM r GROUP BY 1
)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, coalesce(component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON len(s.g) > 0 AND c.k = md5(array_to_string(s.g, chr(10))) LEFT JOIN m USING (cls)
"""
