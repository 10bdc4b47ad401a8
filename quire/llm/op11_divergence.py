"""How far sources of a language differ in their terms, by sorted streams and run-length scans.

1. A task sorts the terms of its documents by (language, source, term, document) and scans the runs: a run of
   a document is one document that holds the term, a run of a term its occurrences. The runs of a task
   go out as partial rows (language, term, source, documents, occurrences), so that the commonest term makes
   one row per task and source.
2. These are repartitioned by (language, term) and sorted by source inside. One scan over a partition adds them up and
   keeps the terms of at least `least` documents. It streams: of the run at a batch's end only the sums by source are carried.
3. Totals by source and by language follow from the kept rows. They meet the kept rows again, in the same order, and
   a second scan gives each run's part of the results: for each two sources that both hold
   the term a part of their pair, for each source a term, of which a task keeps the first `top` ones by source, and
   how often each source has each count.

The value of a pair is a sum over all kept terms, those that one source or both lack included. Of a term that source s
has and t lacks, the addend depends on s, on the count there and on t alone. So
    sum of f(p, q) = V * f(z, z') + sum over the terms of s of [f(p, z') - f(z, z')] + the same for t
                     + sum over the terms of both of [f(p, q) - f(p, z') - f(z, q) + f(z, z')]
where z is the p of a count of 0. The second scan gives the last sum, the counts of each source the others.

All arithmetic is on whole numbers: occurrences of a language times 1,000 must stay below 2^63.

Nulls: null texts, languages and sources are ''. Each row is a document of its own, whatever its id: repeated
rows count again. A language without kept terms has pairs of value 0 and no terms. A language
with one source has no pairs. Empty tables give empty results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.shared import cut
from quire.llm.terms import Sums, met, runs, terms_of
from quire.llm.words import texts_of

LEAST, TOP, SCALE = 10, 10, 1_000_000_000
PARTIAL = "lang string, term string, source string, n_docs long, n long"
KEPT = "lang string, term string, source string, n long, first boolean"
FOUND = "part string, lang string, source string, item string, n long, value long"


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / total) for 0 < n + 2 <= total or so, by long division to the base 1,000."""
    rest = n + 2
    out, rest = rest // total, rest % total
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // total, rest * 1000 % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def partial_counts(docs: DataFrame) -> DataFrame:
    """PARTIAL rows of lang, source, text; one or few for each task and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(["lang", "term", "source"], ["n_docs", "n"])
        for batch in batches:
            lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            for first, block in texts_of(batch.column(2)).blocks(4 << 20):
                names, term, doc = terms_of(block)
                of_doc = group[first : first + len(block)]
                order = np.argsort(of_doc, kind="stable")  # documents by group, so that a key of (term, place) sorts by term, group, document
                place = np.empty(len(block), np.int64)
                place[order] = np.arange(len(block))
                key = np.sort(term * len(block) + place[doc])
                at = runs(key)
                key, times = key[at], np.diff(np.append(at, len(key)))
                of_term, g = key // max(1, len(block)), of_doc[order][key % max(1, len(block))]
                at = runs(of_term * (int(of_doc.max(initial=0)) + 1) + g)
                if not len(at):
                    continue
                table = pa.table({
                    "lang": lang.dictionary.take(pa.array(g[at] // len(source.dictionary))), "term": names.take(pa.array(of_term[at])), "source": source.dictionary.take(pa.array(g[at] % len(source.dictionary))),
                    "n_docs": np.diff(np.append(at, len(key))), "n": np.add.reduceat(times, at),
                })
                for full in sums.add(table):
                    yield from full.to_batches(64_000)
        for full in sums.rest():
            yield from full.to_batches(64_000)

    return docs.mapInArrow(run, PARTIAL)


def starts_of(table: pa.Table, columns: list[str]) -> np.ndarray:
    """True for rows that differ from the one before in one of the columns; the table is sorted by them."""
    new = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        differ = [pc.not_equal(c.slice(1), c.slice(0, table.num_rows - 1)).to_numpy(zero_copy_only=False) for c in (table.column(x).combine_chunks() for x in columns)]
        new[1:] = np.logical_or.reduce(differ)
    return new


def whole_runs(batches: Iterator[pa.RecordBatch], columns: list[str], less=lambda t: t) -> Iterator[pa.Table]:
    """The sorted rows of a partition in tables that cut no run of equal columns. less() makes what is carried of an open run smaller."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
        last = int(np.flatnonzero(starts_of(table, columns))[-1])
        if last:
            yield table.slice(0, last).combine_chunks()
        held = less(table.slice(last).combine_chunks())
    if held is not None:
        yield held


def added(table: pa.Table) -> pa.Table:
    """One row for each (lang, term, source) of sorted PARTIAL rows."""
    at = np.flatnonzero(starts_of(table, ["lang", "term", "source"]))
    sums = {c: pa.array(np.add.reduceat(table.column(c).to_numpy(), at)) for c in ("n_docs", "n")}
    keys = table.select(["lang", "term", "source"]).take(pa.array(at))
    return pa.table([*keys.columns, *sums.values()], names=table.column_names)


def kept_terms(partial: DataFrame, least: int) -> DataFrame:
    """KEPT rows: the count of each kept term in each source that has it; `first` marks one row of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["lang", "term"], added):
            table = added(table)
            new = starts_of(table, ["lang", "term"])
            at = np.flatnonzero(new)
            docs = np.add.reduceat(table.column("n_docs").to_numpy(), at)
            keep = (docs >= least)[np.cumsum(new) - 1]
            out = pa.table([*table.select(["lang", "term", "source", "n"]).columns, pa.array(new)], names=["lang", "term", "source", "n", "first"])
            yield from out.filter(pa.array(keep)).combine_chunks().to_batches(64_000)

    return partial.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(run, KEPT)


def best(table: pa.Table, top: int) -> pa.Table:
    """The rows with the `top` largest values of each (lang, source), ties by item."""
    table = table.sort_by([("lang", "ascending"), ("source", "ascending"), ("value", "descending"), ("item", "ascending")]).combine_chunks()
    new = starts_of(table, ["lang", "source"])
    at = np.flatnonzero(new)
    place = np.arange(table.num_rows) - at[np.cumsum(new) - 1] if len(at) else at
    return table.filter(pa.array(place < top))


def compared(rows: DataFrame, top: int) -> DataFrame:
    """FOUND rows of sorted runs (lang, term, source, n, total of the source, of the language and the number of terms).

    part 'pair': of two sources, a part of their value; 'term': a term of a source (at most `top` for each task
    and source, that is all that may be among the first); 'count': that n terms of the source have the count `value`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, terms = Sums(["lang", "source", "item"], ["value"]), Sums(["lang", "source", "value"], ["n"]), None

        def out(table: pa.Table, part: str) -> Iterator[pa.RecordBatch]:
            n = table.num_rows
            columns = {"part": pa.array([part] * n, pa.string()), "item": pa.array([""] * n, pa.string()), "n": pa.array(np.zeros(n, np.int64)), **{c: table.column(c) for c in table.column_names}}
            yield from pa.table([columns[c] for c in ("part", "lang", "source", "item", "n", "value")], names=["part", "lang", "source", "item", "n", "value"]).combine_chunks().to_batches(64_000)

        for table in whole_runs(batches, ["lang", "term"]):
            new = starts_of(table, ["lang", "term"])
            at, of = np.flatnonzero(new), np.cumsum(new) - 1
            n, total, whole, v = (table.column(c).to_numpy() for c in ("n", "total", "whole", "v"))
            p, z, q = share(n, total + 2 * v), share(0 * n, total + 2 * v), share(np.add.reduceat(n, at)[of], whole + 2 * v)
            lang, source, term = (table.column(c).combine_chunks() for c in ("lang", "source", "term"))
            high = np.flatnonzero(p > q)
            mine = pa.table({"lang": lang.take(pa.array(high)), "source": source.take(pa.array(high)), "item": term.take(pa.array(high)), "value": apart(p, q)[high]})
            terms = best(mine if terms is None else pa.concat_tables([terms, mine]), top)
            for full in counts.add(pa.table({"lang": lang, "source": source, "value": n, "n": np.ones(len(n), np.int64)})):
                yield from out(full, "count")
            left = np.arange(len(n))
            for step in range(1, len(n)):  # rows that are `step` apart in one run; as many steps as the longest run has rows
                left = left[left + step < len(n)]
                left = left[of[left] == of[left + step]]
                if not len(left):
                    break
                a, b = left, left + step
                value = apart(p[a], p[b]) - apart(p[a], z[b]) - apart(z[a], p[b]) + apart(z[a], z[b])
                for full in pairs.add(pa.table({"lang": lang.take(pa.array(a)), "source": source.take(pa.array(a)), "item": source.take(pa.array(b)), "value": value})):
                    yield from out(full, "pair")
        for full in pairs.rest():
            yield from out(full, "pair")
        for full in counts.rest():
            yield from out(full, "count")
        if terms is not None:
            yield from out(terms, "term")

    return rows.mapInArrow(run, FOUND)


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language ('pair'), and the terms it has more of ('term')."""
    named = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.col(text).alias("text"))
    kept = cut(kept_terms(partial_counts(named), least))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = named.groupBy("lang", "source").agg(F.lit(True).alias("occurs"))
    by_lang = cut(kept.groupBy("lang").agg(F.sum("n").alias("whole"), F.sum(F.col("first").cast("long")).alias("v")))
    none = F.lit(0).cast("long")
    known = cut(groups.join(totals, ["lang", "source"], "left").join(by_lang, "lang", "left").select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("total", "whole", "v"))))

    rows = met(kept.select("lang", "term", "source", "n"), known, ["lang", "source"]).repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    found = cut(compared(rows, top))

    # each two sources of a language, one way: the output itself has them both ways
    a, b = known.select("lang", "source", "total", "v"), known.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"))
    sides = cut(met_all(a, b).where("source <> item"))
    p_of = lambda n, total: 1 + F.expr(f"CAST({SCALE} AS DECIMAL(20, 0)) * ({n} + 2) DIV ({total} + 2 * v)")
    f_of = lambda x, y: F.expr(f"({x} - {y}) * ({x} - {y}) DIV ({x} + {y})")
    zeros = sides.withColumns({"z": F.when(F.col("v") > 0, p_of("0", "total")), "y": F.when(F.col("v") > 0, p_of("0", "item_total"))})
    base = zeros.select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * f_of("z", "y")).otherwise(none).alias("value"))
    counts = cut(found.where("part = 'count'").groupBy("lang", "source", F.col("value").alias("count")).agg(F.sum("n").alias("n")))
    lacking = zeros.where("v > 0").join(counts, ["lang", "source"]).withColumn("p", p_of("count", "total"))
    single = lacking.select("lang", "source", "item", (F.col("n") * (f_of("p", "y") - f_of("z", "y"))).alias("value"))
    both = found.where("part = 'pair'").select("lang", "source", "item", "value")
    flip = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = base.unionAll(single).unionAll(flip(single)).unionAll(both).unionAll(flip(both)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))
    return ranked(pairs, "pair").unionAll(ranked(found.where("part = 'term'"), "term").where(F.col("rank") <= top))


def met_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sources of a language with each other: the pairs that the result has."""
    return a.join(b, "lang")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), o AS (
  SELECT r, lang, source, unnest(ws) AS term FROM d
), k AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 10
), l AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), h AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM o GROUP BY ALL
), c AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, k.n AS whole, sum(coalesce(h.n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS total
  FROM g JOIN k USING (lang) LEFT JOIN h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
), p AS (
  SELECT c.lang, source, term, c.n, 1 + (1000000000 * (c.n + 2)) // (total + 2 * v) AS p, 1 + (1000000000 * (whole + 2)) // (l.n + 2 * v) AS q FROM c JOIN l USING (lang)
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
), y AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM x
)
SELECT lang, source, part, item, value, rank FROM y WHERE part = 'pair' OR rank <= 10
"""
