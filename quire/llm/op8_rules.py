"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps the measurements and one
failure bit per rule. Policies are masks over those bits with a version, so a policy is
applied, or changed, without reading texts again, and an ablation (what each rule alone
removes, what would come back without it) is one aggregation of bits.

A ledger that several readers share is written once, with cut() of shared.py; `ablations` does so.

Nulls: a null text has no words and fails `few_words`. Empty tables give empty results.
Repeated rows are judged row by row. Columns besides the id and text are ignored; the id
may be null and is passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.shared import cut
from quire.llm.stats import MEASURES, measure_all
from quire.llm.words import texts_of

#: name -> condition over the measurements, in integers; the bit is the position.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "same_word_again": "5 * n_same_as_before > n_words",
    "capitals": "2 * n_caps_words > n_words",
    "word_length": "word_chars > 12 * n_words OR word_chars < 2 * n_words",
}
#: version -> rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(RULES),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(version: str) -> int:
    return sum(bit(r) for r in POLICIES[version])


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the measurements, and `failed`: the bits of the rules that the document fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measure_all(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[k].astype(np.int64)) for k in MEASURES)], names=[key, *MEASURES])

    source = df.select(key, text)
    made = source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, " + ", ".join(f"{k} long" for k in MEASURES))
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    failed: Column = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return made.withColumn("failed", failed.cast("long"))


def apply_policy(rows: DataFrame, version: str) -> DataFrame:
    """Adds `kept` by a policy's mask."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(version))) == 0)


def keep_passing(df: DataFrame, version: str, text: str = "text") -> DataFrame:
    """The rows of df, with all their columns, that a policy keeps; there is no shuffle."""
    at = df.columns.index(text)
    m = mask(version)
    failing = F.lit(0)
    for i, rule in enumerate(RULES.values()):
        failing = failing.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure_all(texts_of(batch.column(at)))
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema)), *(pa.array(found[k].astype(np.int64)) for k in MEASURES)], names=["row", *MEASURES])

    shape = T.StructType([T.StructField("row", df.schema), *(T.StructField(k, T.LongType()) for k in MEASURES)])
    return df.mapInArrow(run, shape).where(failing.bitwiseAND(F.lit(m)) == 0).select("row.*")


def ablation(rows: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: documents failing it, and failing it alone."""
    m = mask(version)
    seen = rows.groupBy(F.col("failed").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    table = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in POLICIES[version]))).alias("r")
    return (
        seen.select("bits", "n", table)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"))
    )


def ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """version, rule, n_failed, n_failed_alone, n_kept: of every policy, from one stored ledger."""
    stored = cut(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    out = None
    for version in POLICIES:
        kept = apply_policy(stored, version).agg(F.count_if("kept").alias("n_kept"))
        found = ablation(stored, version).join(F.broadcast(kept)).select(F.lit(version).alias("version"), "rule", "n_failed", "n_failed_alone", "n_kept")  # one row
        out = found if out is None else out.unionAll(found)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "v1")
    base = F.col("failed").bitwiseAND(F.lit(mask("base"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", F.col("failed").alias("failed_rules"))


BITS = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), u AS (
  SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w
), v AS (
  SELECT r, i, list(x) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS k FROM u
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM v WHERE len(k) = 8
), c AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT r, i, unnest(range(0, 8)) AS k FROM g WHERE c > 1) GROUP BY r
), m AS (
  SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(list_filter(ws, lambda x: length(regexp_replace(x, '[^A-Z]', '', 'g')) >= 2 AND NOT regexp_matches(x, '[a-z]')))::BIGINT AS n_caps_words,
    len(list_filter(range(2, len(ws) + 1), lambda i: translate(ws[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = translate(ws[i - 1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))::BIGINT AS n_same
  FROM w
), f AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, n_caps_words, n_same
  FROM m LEFT JOIN l ON l.r = m.r LEFT JOIN c ON c.r = m.r
), b AS (
  SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
    + 16 * (5 * n_same > n_words)::BIGINT + 32 * (2 * n_caps_words > n_words)::BIGINT + 64 * (word_chars > 12 * n_words OR word_chars < 2 * n_words)::BIGINT AS failed_rules FROM f
)
"""
ORACLE = BITS + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_rules & 3) <> 0 AS base_failed, failed_rules = 0 AS kept, failed_rules FROM b
"""
ABLATIONS = BITS + """, p AS (
  SELECT * FROM (VALUES ('base', 'few_words', 1, 3), ('base', 'repeated_windows', 2, 3), ('v1', 'few_words', 1, 127), ('v1', 'repeated_windows', 2, 127), ('v1', 'symbols', 4, 127),
    ('v1', 'duplicate_lines', 8, 127), ('v1', 'same_word_again', 16, 127), ('v1', 'capitals', 32, 127), ('v1', 'word_length', 64, 127)) AS t(version, rule, bit, mask)
)
SELECT version, rule, count(*) FILTER (failed_rules & bit <> 0) AS n_failed, count(*) FILTER (failed_rules & mask = bit) AS n_failed_alone, count(*) FILTER (failed_rules & mask = 0) AS n_kept FROM b, p GROUP BY version, rule
"""
