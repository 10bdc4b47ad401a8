"""Readers of landed items and pages; no network is used here.

Connectors land what they fetch as JSON or HTML; these readers give it a schema. Filters and
columns asked for are pushed to the files by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.dates_urls import clean_doi, date_of_first, date_of_parts, date_of_timestamp, linked_data_author
from quire.functions.names import first_author, is_edited, reviewer
from quire.functions.text import let, squeeze, strip_tags, truncated
from quire.operators.detect import is_review, is_self_review
from quire.operators.parse import parse_title
from quire.operators.windows import carry_forward
from quire.schema import PUBLISHER_RECORD, WORK_ITEM, conform, filled, is_blank
from quire.storage import cut


FEW_ISSUES = 50_000


def read_items(spark: SparkSession, path: str, schema: T.StructType = WORK_ITEM) -> DataFrame:
    """SC5, SC7, SC8, SC20: landed JSON with a fixed schema."""
    return spark.read.schema(schema).json(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """SC1, SK6: a snapshot, whatever columns it was written with."""
    return conform(spark.read.option("mergeSchema", "true").parquet(path))


def write_snapshot(catalog: DataFrame, path: str) -> None:
    """A whole new snapshot; readers move to it when it is complete."""
    catalog.write.mode("errorifexists").parquet(path)


def write_site(view: DataFrame, path: str) -> None:
    """SK10: the serving view as JSON lines."""
    view.write.mode("errorifexists").json(path)


def run_report(catalog: DataFrame) -> DataFrame:
    """SK11: one line of Markdown per journal."""
    n = catalog.groupBy("publication_source").agg(F.count("*").alias("n"), F.expr("count_if(book_author_last_name <> '')").alias("named"))
    return n.orderBy(F.desc("n"), "publication_source").select(F.concat(F.lit("- "), "publication_source", F.lit(": "), F.col("n").cast("string"), F.lit(" rows, "), F.col("named").cast("string"), F.lit(" with author")).alias("line"))


def changed_since(items: DataFrame, start: str) -> DataFrame:
    """SC6"""
    return items.where(F.col("indexed") >= F.lit(start).cast("timestamp"))


def write_issues(items: DataFrame, path: str) -> None:
    """Items (journal, year, volume, issue, ..) in folders by journal and year, as an issue fetch asks for them (SC21)."""
    items.repartition("journal", "year").write.mode("errorifexists").partitionBy("journal", "year").parquet(path)


def issue_articles(spark: SparkSession, path: str, markers: DataFrame) -> DataFrame:
    """All items of the issues that markers (journal, year, volume, issue) found in another source name (SC21, SC22).

    The journals and years of the markers choose, while the query runs, which folders are read at all; volume and issue are compared
    then. Nulls name no issue. The issues are stored and counted: up to FEW_ISSUES of them go to all tasks, and only then do they
    choose folders; more are joined.
    """
    wanted = cut(markers.select("journal", "year", "volume", "issue").dropna().distinct())
    n, low, high = wanted.agg(F.count("*"), F.min("year"), F.max("year")).first()
    side = wanted.where(F.col("year").between(low, high))  # a range that folders can be judged by before the join's own keys are known
    side = F.broadcast(side) if n <= FEW_ISSUES else side
    return spark.read.parquet(path).join(side, ["journal", "year", "volume", "issue"], "left_semi")


def missing_author(catalog: DataFrame) -> DataFrame:
    """SC2"""
    return catalog.where(is_blank("book_author_first_name") & is_blank("book_author_last_name"))


def missing_surname(catalog: DataFrame) -> DataFrame:
    """SC27"""
    return catalog.where(is_blank("book_author_last_name"))


def missing_reviewer(catalog: DataFrame, sources: list[str]) -> DataFrame:
    """SC28, SC29"""
    return catalog.where(F.col("publication_source").isin(sources) & is_blank("reviewer_last_name")).orderBy("publication_source", "id")


def review_rows(items: DataFrame, mode: str = "all") -> DataFrame:
    """Work items that are reviews -> catalog rows with a `seq` for first-wins."""
    title = F.coalesce(F.try_element_at("title", F.lit(1)), F.lit(""))
    subtitle = F.try_element_at("subtitle", F.lit(1))
    person = F.try_element_at("author", F.lit(1))
    rows = items.where(is_review(title, mode)).select(
        parse_title(title, subtitle).alias("p"), F.coalesce(person["given"], F.lit("")).alias("reviewer_first_name"), F.coalesce(person["family"], F.lit("")).alias("reviewer_last_name"),
        F.coalesce(F.try_element_at("`container-title`", F.lit(1)), F.lit("")).alias("publication_source"), date_of_parts(F.try_element_at(F.col("issued.`date-parts`"), F.lit(1))).alias("publication_date"),
        F.coalesce("URL", F.lit("")).alias("review_link"), truncated(squeeze(strip_tags(F.coalesce("abstract", F.lit(""))))).alias("review_summary"),
        F.when(F.size(F.coalesce("license", F.array())) > 0, "Open").otherwise("Restricted").alias("access_type"), F.coalesce("DOI", F.lit("")).alias("doi"), F.monotonically_increasing_id().alias("seq"),
    )
    named = rows.where("p IS NOT NULL").withColumns({"book_title": F.col("p.book_title"), "book_author_first_name": F.col("p.first"), "book_author_last_name": F.col("p.last"), "entry_type": F.lit("review")}).drop("p")
    who = lambda kind: F.concat_ws(" ", filled(f"{kind}_first_name"), filled(f"{kind}_last_name"))
    return named.where(~is_self_review(who("book_author"), who("reviewer"), F.col("publication_source")))


def logic_dates(items: DataFrame) -> DataFrame:
    """F51 on work items: (DOI, date)."""
    first = lambda f: F.try_element_at(F.col(f"`{f}`.`date-parts`"), F.lit(1))
    return items.select("DOI", date_of_first(first("published-print"), first("published-online"), first("issued")).alias("date"))


def publisher_rows(records: DataFrame, journal: str) -> DataFrame:
    """Publisher records of reviews -> catalog rows."""
    html = F.try_element_at(F.filter("url", lambda u: u["format"] == "html"), F.lit(1))["value"]
    creator = F.coalesce(F.try_element_at("creators", F.lit(1))["creator"], F.lit(""))
    is_book = F.exists("genre", lambda g: g.contains("Book Review")) | is_review(F.col("title"))
    rows = records.where(is_book).withColumn("p", parse_title(F.col("title"))).where("p IS NOT NULL")
    return rows.select(
        F.col("p.book_title").alias("book_title"), F.col("p.first").alias("book_author_first_name"), F.col("p.last").alias("book_author_last_name"),
        F.coalesce(F.try_element_at(F.split(creator, ", ", 2), F.lit(2)), F.lit("")).alias("reviewer_first_name"), F.element_at(F.split(creator, ", ", 2), 1).alias("reviewer_last_name"),
        F.lit(journal).alias("publication_source"), F.col("publicationDate").alias("publication_date"), F.coalesce(html, F.lit("")).alias("review_link"),
        F.when(F.lower("openaccess") == "true", "Open").otherwise("Restricted").alias("access_type"), "doi", F.lit("review").alias("entry_type"), F.monotonically_increasing_id().alias("seq"),
    )


def read_publisher(spark: SparkSession, path: str) -> DataFrame:
    """SC9"""
    return read_items(spark, path, PUBLISHER_RECORD)


def posts_with_slug(posts: DataFrame, prefix: str, newest: int | None = None) -> DataFrame:
    """SC10"""
    found = posts.where(F.col("slug").startswith(prefix)).orderBy(F.desc("date"), F.desc("id"))
    return found if newest is None else found.limit(newest)


def links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, pos, href) of every link (SC11, SC14-SC16, G4)."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))).alias("pos", "href"))


def blocks(pages: DataFrame, tag: str, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, pos, block): the insides of an element (G4, SC14-SC18)."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))).alias("pos", "block"))


def headed_entries(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, pos, year, entry): list entries with the year of the nearest heading before them (SC17, SC19, W4)."""
    parts = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<(?:h[1-6]|li)\b[^>]*>.*?</(?:h[1-6]|li)>"), F.lit(0))).alias("pos", "part"))
    head = parts.withColumn("text", squeeze(strip_tags(F.col("part")))).withColumn("is_head", F.col("part").rlike("(?i)^<h"))
    year = F.when(F.col("is_head"), filled(F.regexp_extract("text", r"\b((?:19|20)\d{2})\b", 1)))
    return carry_forward(head, year, "year", [key], ["pos"]).where(~F.col("is_head")).select(key, "pos", "year", F.col("text").alias("entry"))


def page_metadata(pages: DataFrame, html: str = "html", key: str = "page_id", limit: int | None = None) -> DataFrame:
    """(key, author, published, linked): meta tags and linked data of a page, or of its first `limit` characters (SC26; the reference reads 80,000)."""
    head = F.col(html) if limit is None else F.substring(html, 1, limit)
    meta = lambda name: F.coalesce(*(filled(F.regexp_extract(head, p, 1)) for p in (rf"""(?is)<meta[^>]+(?:name|property)=["']{name}["'][^>]*content=["']([^"']+)""", rf"""(?is)<meta[^>]+content=["']([^"']+)["'][^>]*(?:name|property)=["']{name}["']""")))
    linked = linked_data_author(F.regexp_extract(head, r"""(?is)<script[^>]+application/ld\+json["'][^>]*>(.*?)</script>""", 1))
    return pages.select(key, meta("(?:author|article:author|parsely-author)").alias("author"), meta("(?:datePublished|article:published_time)").alias("published"), linked.alias("linked"))


def review_page(html: Column) -> Column:
    """(title, author_first, author_last, is_edited, reviewer_first, reviewer_last, published, summary) of a review page (SC13, P21).

    Null where the page has no bibliography element.
    """
    part = lambda cls, tag: F.regexp_extract(html, rf"""(?is)<{tag}[^>]+class=["'][^"']*{cls}[^"']*["'][^>]*>(.*?)</{tag}>""", 1)
    stamp = F.regexp_extract(html, r"""(?is)property=["']datePublished["'][^>]*content=["']([^"']+)""", 1)

    def record(title: Column, edited: Column, author: Column, person: Column) -> Column:
        return F.struct(
            title.alias("title"), author["first"].alias("author_first"), author["last"].alias("author_last"), edited.alias("is_edited"), author["has_multiple"].alias("has_multiple_authors"),
            person["first"].alias("reviewer_first"), person["last"].alias("reviewer_last"), person["affiliation"].alias("affiliation"), person["has_multiple"].alias("has_multiple_reviewers"),
            date_of_timestamp(stamp, squeeze(strip_tags(part("meta-item__edition", "p")))).alias("published"), clean_doi(F.concat(strip_tags(html), F.lit(" "))).alias("doi"),
            truncated(squeeze(strip_tags(part("article-content", "div")))).alias("summary"),
        )

    def found(bibliography: Column) -> Column:
        title = squeeze(strip_tags(F.regexp_extract(bibliography, r"(?is)<em>(.*?)</em>", 1)))
        before = squeeze(strip_tags(F.regexp_extract(bibliography, r"(?is)^(.*?)<em>", 1)))
        person = let(squeeze(strip_tags(part("meta-item__reviewer", "p"))), reviewer)
        people = lambda b: F.struct(is_edited(b).alias("edited"), first_author(F.regexp_replace(b, r"[,\s]+$", "")).alias("author"), person.alias("person"))
        return F.when(bibliography != "", let(let(before, people), lambda p: record(title, p["edited"], p["author"], p["person"])))

    return let(part("meta-item__bibliography", "div"), found)
