"""Queries take all rows and whole values: each test has input that a narrower read would lose."""

import hashlib
import re

from pyspark.sql import functions as F

from quire.queries import QUERIES
from quire.streaming import incremental

TEXTS = ["plain text", "a b — “c”", "x‐y‑z ‘q’ –", "thin and　wide line\x0b", "a <i>tagged</i> Title: rest", "1 < 2", "<b>", "", None]


def documents(spark, at, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_all_documents_are_cleaned(spark, tmp_path):
    at = documents(spark, tmp_path, TEXTS)
    plain = str.maketrans("  ‘’“”–—‐‑", "  ''\"\"----")
    spaced = [None if t is None else hashlib.md5(re.sub(r"\s+", " ", t.translate(plain)).strip().encode()).hexdigest() for t in TEXTS]
    assert sorted((r.doc_id, r.h) for r in QUERIES["normalize_space"](spark, at).collect()) == list(enumerate(spaced))
    key = lambda t: re.sub("[^a-z0-9 ]", "", re.sub("<[^>]+>", "", t).split(":")[0].lower()).strip(" ")
    want = [(i, *((None,) * 3 if t is None else (key(t), len(re.findall("[a-zA-Z]{3,}", t)), t))) for i, t in enumerate(TEXTS)]
    assert sorted(tuple(r) for r in QUERIES["text_clean"](spark, at).collect()) == want


def test_metadata_late_in_a_page(spark, tmp_path):
    late = '<meta name="author" content="Ann Lee"><meta property="datePublished" content="2020-05-01"><script type="application/ld+json">{"author": {"name": "Al Bo"}}</script>'
    page = "<style>" + "x" * 90_000 + "</style>" + late
    spark.createDataFrame([(1, page), (2, late), (3, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: tuple(r)[1:] for r in QUERIES["page_metadata"](spark, str(tmp_path)).collect()}
    assert got[1] == got[2] and got[1][:2] == ("Ann Lee", "2020-05-01") and got[1][2] and got[3][0] is None


def test_late_events_are_kept(spark, tmp_path):
    def run(rows):
        spark.createDataFrame(rows, "event_id long, ts string").selectExpr("event_id", "CAST(ts AS timestamp) AS ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("event_id long, ts timestamp").parquet(f"{tmp_path}/in")
        incremental.fresh_events(stream, "event_id", "ts").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run([(1, "2024-03-01 00:00:00"), (2, "2024-03-01 01:00:00")]) == [1, 2]
    assert run([(3, "2024-01-01 00:00:00"), (1, "2024-03-01 00:00:00")]) == [1, 2, 3]


def test_predicates_read_whole_texts(spark, tmp_path):
    at = documents(spark, tmp_path, ["a quiet line\nReview of The Good Life, by Jane Doe", "Once upon times\nthere was a tree", "ALL CAPITALS HERE\nX\nand small", "ONE LINE\nTWO LINES"])
    got = lambda name, column: [r[column] for r in sorted(QUERIES[name](spark, at).collect())]
    assert got("review_detect", "review")[0]
    assert got("all_caps_texts", "caps") == [False, False, False, True]
    assert got("function_words_texts", "has") == [True, True, True, False]
    assert got("garbled_texts", "garbled") == [True, True, True, False]


def test_small_files_are_dealt_over_tasks(spark, tmp_path):
    """Millions of short rows fit into one file's part, and were one task; the number of tasks follows the rows."""
    from quire.citation_queries import list_items, parts_as
    from quire.queries import title_parse
    from quire.storage import ROWS_A_TASK
    from quire.table_queries import review_pages

    parts = spark.range(1, 2 * ROWS_A_TASK + 2).select(F.col("id").alias("p_partkey"), F.lit("plum bisque").alias("p_name"), F.lit(3).alias("p_size"))
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert parts_as(spark, str(tmp_path), ["{}"]).rdd.getNumPartitions() == 3
    for query in (list_items, review_pages, title_parse):
        assert query(spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_words_of_a_whole_text_are_asked_for_only_where_they_can_matter(spark, tmp_path):
    """Page counts are looked for wherever "pp" stands; a genitive, a comma or a colon far into a text does not change what a name is."""
    texts = ["x " * 300 + "pp", "x " * 300 + "224 pp.", "x " * 300 + "224PP y", "x " * 300 + "224 apples", "Ann Lee's Mind", "Ann " * 9 + "Lee's Mind", "Plato, Mind", "Ann Lee: Mind", "ann lee: Mind", "Ann Lee: mind"]
    rows = QUERIES["review_detect"](spark, documents(spark, tmp_path, texts)).orderBy("doc_id").collect()
    assert [r.review for r in rows] == [False, True, True, False, True, False, True, True, False, False]
