"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and gives documents of the same columns, but for the
last, which gives tokens. run() writes each stage's rows as Parquet in the folder that the
session names in spark.checkpoint.dir, and the next one reads these.

Decisions are about rows: ids may be null or repeated, other columns may hold anything under
any name, null and empty texts go with the quality rules. Empty tables stay empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import op1_decontaminate, op3_bpe, op7_suffixes, op8_rules, op10_setsketch
from quire.storage import shared_folder


def keyed(docs: DataFrame) -> DataFrame:
    """row (a row of docs, whole) and row_key, a key of its own. Kept as Parquet, so that every read finds the same keys."""
    at = f"{shared_folder(docs.sparkSession)}/rows-{uuid.uuid4().hex}"
    docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("row_key")).write.option("compression", "zstd").parquet(at)
    return docs.sparkSession.read.parquet(at)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of keyed() whose key is not in gone. Few rows go, so Spark may send their keys whole where they are small."""
    return rows.join(gone, "row_key", "left_anti").select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the current policy rejects. Judged in place: there is no shuffle."""
    return op8_rules.keep_passing(docs, "v1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies (shingles of five words, similarity 0.8).

    Null ids come last; of equal ids the first row stays.
    """
    rows = keyed(docs)
    order = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), "row_key")
    found = op10_setsketch.near_duplicates(rows.select(F.col("row.text").alias("text"), order.alias("place")), "place")
    return without(rows, found.where("NOT kept").select("place.row_key"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts bytes that an earlier document, or an earlier place, already has.

    A character that a cut splits goes as a whole. n_chars becomes the length that is left.
    """
    return op7_suffixes.cut_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    rows = keyed(docs)
    found = op1_decontaminate.decontaminate(rows.select("row_key", F.col("row.text").alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "row_key")
    return without(rows, found.where("contaminated").select("row_key"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and the digest of the decoded text."""
    rows = op3_bpe.encode(docs)
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("tokens", tokens),
]

#: BPE merging can't be told in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_folder(spark)
    name = uuid.uuid4().hex
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for stage, function in STAGES:
        out = f"{at}/pipeline-{name}/{stage}"
        function(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
