"""The bulk and weekly runs: scan, detect, parse, symposia, enrich, filter, upsert, classify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.dates_urls import page_end, page_start, year_of
from quire.functions.names import split_name, surname_key
from quire.operators import classify, matching, misses, symposia, upsert
from quire.schema import filled, is_blank, titled
from quire.sources.landed import review_rows
from quire.storage import cut


def issue_items(items: DataFrame) -> DataFrame:
    """Items as the symposium operators read them."""
    return items.select(
        F.coalesce(F.try_element_at("`container-title`", F.lit(1)), F.lit("")).alias("journal"), F.coalesce("volume", F.lit("")).alias("volume"), F.coalesce("issue", F.lit("")).alias("issue"), F.col("DOI").alias("doi"),
        F.coalesce(F.try_element_at("title", F.lit(1)), F.lit("")).alias("title"), surname_key(F.try_element_at("author", F.lit(1))["family"]).alias("surname"), page_start(F.col("page")).alias("start_page"), page_end(F.col("page")).alias("end_page"),
    )


def enrich(rows: DataFrame, works: DataFrame, abort_after: int | None = 30) -> DataFrame:
    """Authors for rows without one, from the most similar known work.

    Rows are looked up in the order of `seq`; after `abort_after` misses in a row the rest stay as they are (None: all are looked up).
    """
    wanting = rows.where(is_blank("book_author_last_name") & ~is_blank("book_title"))
    found = matching.best_work(wanting.select(F.col("seq").alias("record"), F.col("book_title").alias("title"), year_of(F.col("publication_date")).alias("year")), works)
    known = found.select(F.col("record").alias("seq"), F.col("name.first").alias("f"), F.col("name.last").alias("l"))
    if abort_after is not None:
        asked = wanting.select("seq").join(known, "seq", "left")
        known = misses.attempted(asked, is_blank("l"), abort_after, ["seq"]).where("attempted").drop("attempted")
    joined = rows.join(known, "seq", "left")
    return joined.withColumns({"book_author_first_name": F.coalesce(F.when(is_blank("book_author_last_name"), F.col("f")), F.col("book_author_first_name")), "book_author_last_name": F.coalesce(filled("book_author_last_name"), F.col("l"), F.lit(""))}).drop("f", "l")


def works_of(lookups: DataFrame) -> DataFrame:
    """Landed lookup results -> works (SC24). Their numbers are stored with them, since several branches of a plan read them."""
    return cut(lookups.select(F.monotonically_increasing_id().alias("work"), "title", F.col("publication_year").alias("year"), F.monotonically_increasing_id().alias("rank"), F.try_element_at("authorships", F.lit(1))["author"]["display_name"].alias("author")))


def observed(rows: DataFrame, observation) -> DataFrame:
    """Counts that a run takes on the way, without a pass of its own (A13). observation: pyspark.sql.Observation."""
    return rows.observe(observation, F.count("*").alias("rows"), F.count_if(~is_blank("book_title")).alias("with_title"), F.count_if(~is_blank("book_author_last_name")).alias("with_author"))


def ingest(catalog: DataFrame, items: DataFrame, works: DataFrame | None = None, journals: DataFrame | None = None, mode: str = "all") -> DataFrame:
    """The catalog's next snapshot."""
    rows = cut(review_rows(items, mode))  # parsed once, read by several joins
    members = symposia.by_markers(issue_items(items))
    clusters = symposia.records(members, symposia.inferred_title(members)).dropDuplicates(["doi"])
    upgrade = clusters.select("doi", F.col("symposium_group").alias("g"), F.lit(True).alias("hit"))
    rows = rows.join(upgrade, "doi", "left").withColumns({"entry_type": F.when(F.col("hit"), "symposium").otherwise(F.col("entry_type")), "symposium_group": F.coalesce("g", F.lit(""))}).drop("g", "hit")
    extra = cut(clusters.join(rows.select("doi"), "doi", "left_anti").withColumn("seq", F.monotonically_increasing_id() + F.lit(1 << 60)))  # several branches read the numbers
    batch = rows.unionByName(extra, allowMissingColumns=True)
    if works is not None:
        batch = enrich(batch, works)
    out = upsert.insert_or_ignore(catalog, titled(batch))
    return classify.classify(out, journals) if journals is not None else out


def backfill(catalog: DataFrame, found: DataFrame, column: str = "review_summary", least: int = 20) -> DataFrame:
    """Blank summaries from landed abstracts longer than `least`, by DOI (C11)."""
    return upsert.fill_by_key(catalog, found.where(F.length(column) > least), "doi", (column,))


def backfill_reviewers(catalog: DataFrame, found: DataFrame, name: Column, key: str = "review_link") -> DataFrame:
    """Blank reviewers from found names, by URL."""
    people = found.select(key, split_name(name).alias("n")).select(key, F.col("n.first").alias("reviewer_first_name"), F.col("n.last").alias("reviewer_last_name"))
    return upsert.fill_by_key(catalog, people.where(~is_blank("reviewer_last_name")), key, ("reviewer_first_name", "reviewer_last_name"))
