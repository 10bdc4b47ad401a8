"""Symposia: contributions on one book in one journal issue, found by pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.dates_urls import issue_key
from quire.functions.text import squeeze, strip_tags
from quire.operators.detect import is_no_symposium, is_precis, is_reply
from quire.operators.upsert import place_in_group
from quire.operators.windows import until_first
from quire.schema import is_blank

ISSUE = ["journal", "volume", "issue"]


def greedy_pairs(anchors: DataFrame, group: list[str], who: str = "surname", start: str = "start_page", end: str = "end_page", kind: str = "kind") -> DataFrame:
    """Each start anchor with the nearest later end anchor of the same person, an end used once.

    Starts go in the order of their pages, so the place that a start takes among its person's ends
    is one more than the last start's, or the place of the first later end if that is farther on:
    its own place plus the running maximum of (first later end - own place). Windows over
    one person's anchors in an issue do it, in linear time. Anchors without person or pages have no pair.
    """
    is_end = F.col(kind) == "end"
    known = anchors.where(F.col(start).isNotNull() & F.col(end).isNotNull() & F.col(kind).isin("start", "end") & (F.col(who) != ""))
    rows = known.select(*group, who, is_end.alias("is_end"), F.when(is_end, F.col(end)).otherwise(F.col(start)).alias("page"))
    w = Window.partitionBy(*group, who).orderBy("page", F.col("is_end").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.withColumns({"ends": F.count_if("is_end").over(w), "starts": F.count_if(~F.col("is_end")).over(w)})
    lag = F.max(F.when(~F.col("is_end"), F.col("ends") + 1 - F.col("starts"))).over(w)
    placed = counted.withColumn("place", F.when(F.col("is_end"), F.col("ends")).otherwise(F.col("starts") + lag))
    both = placed.groupBy(*group, who, "place").agg(F.min(F.when(~F.col("is_end"), F.col("page"))).alias("range_start"), F.min(F.when(F.col("is_end"), F.col("page"))).alias("range_end"))
    return both.where("range_start IS NOT NULL AND range_end IS NOT NULL").drop("place")


def last_item_by(items: DataFrame, starts: DataFrame, group: list[str]) -> DataFrame:
    """For starts without an end: the last item of the same person, if it is later."""
    last = items.where("surname <> ''").groupBy(*group, "surname").agg(F.max("start_page").alias("later"), F.max_by("end_page", F.struct("start_page", "end_page")).alias("range_end"))
    found = starts.select(*group, "surname", F.col("start_page").alias("range_start")).distinct().join(last, [*group, "surname"])
    return found.where("later > range_start").select(*group, "surname", "range_start", "range_end")


def swept(items: DataFrame, ranges: DataFrame) -> DataFrame:
    """Items and both edges of ranges in one order of pages, an issue's counts running along: at the same page, starts first and ends last.

    items: ISSUE, page, item; ranges: ISSUE, range_start, range_end.
    """
    edges = ranges.select(*ISSUE, "range_start", "range_end", F.explode(F.array(F.lit(0), F.lit(2))).alias("at"))
    edges = edges.select(*ISSUE, F.when(F.col("at") == 0, F.col("range_start")).otherwise(F.col("range_end")).alias("page"), "at", F.struct("range_start", "range_end").alias("range"))
    every = items.withColumn("at", F.lit(1)).unionByName(edges, allowMissingColumns=True)
    w = Window.partitionBy(*ISSUE).orderBy("page", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return every.withColumns({"seen": F.count_if(F.col("at") == 1).over(w), "open": F.sum(1 - F.col("at")).over(w)})


def by_anchors(items: DataFrame, start: Column, end: Column) -> DataFrame:
    """Members (item columns, symposium_group) of page ranges between a start and an end.

    items: journal, volume, issue, doi, title, surname, start_page, end_page. Items are never
    paired with ranges: one sweep counts what each range holds, a second finds the items inside ranges
    of two items or more. Items without journal, volume, issue or start page are in none.
    """
    known = items.dropna(subset=[*ISSUE, "start_page"])
    marked = known.withColumn("kind", F.when(start, "start").when(end, "end"))
    pairs = greedy_pairs(marked.where("kind IS NOT NULL"), ISSUE)
    alone = marked.where("kind = 'start'").join(pairs.select(*ISSUE, "surname", F.col("range_start").alias("start_page")), [*ISSUE, "surname", "start_page"], "left_anti")
    ranges = pairs.unionByName(last_item_by(known, alone, ISSUE).select(*pairs.columns)).where("range_start <= range_end").select(*ISSUE, "range_start", "range_end").distinct()
    rows = known.select(*ISSUE, F.col("start_page").alias("page"), F.struct(*known.columns).alias("item"))
    held = swept(rows.drop("item"), ranges).where("at <> 1").groupBy(*ISSUE, "range").agg((F.max("seen") - F.min("seen")).alias("size")).where("size >= 2")
    inside = swept(rows, held.select(*ISSUE, "range.*")).where("at = 1 AND open > 0")
    return inside.select("item.*").withColumn("symposium_group", issue_key(*(F.col(c) for c in ISSUE))).distinct()


def near_markers(items: DataFrame, markers: DataFrame, before: int, after: int) -> DataFrame:
    """Items with the markers (marker, marker_page) of their issue in whose window of pages they may be.

    Pages are cut into bands as wide as a window, so a window touches two of them: an item meets the markers of its own
    band and of a neighbour, never all of its issue.
    """
    width = before + after + 1
    band = lambda page: F.floor(page / width).cast("long")
    touched = F.explode(F.sequence(band(F.col("marker_page") - before), band(F.col("marker_page") + after)))
    return items.withColumn("band", band(F.col("start_page"))).join(markers.withColumn("band", touched), [*ISSUE, "band"]).drop("band")


def by_markers(items: DataFrame, before: int = 10, after: int = 80) -> DataFrame:
    """Members of the page window around a precis, up to a reply or to what is no symposium."""
    markers = items.where(is_precis(F.col("title")) & (F.col("start_page") > 0)).select(*ISSUE, F.col("doi").alias("marker"), F.col("start_page").alias("marker_page"))
    near = near_markers(items, markers, before, after).where((F.col("start_page") >= F.col("marker_page") - before) & (F.col("start_page") <= F.col("marker_page") + after))
    odd = is_no_symposium(F.col("title"))
    group, order = ["marker"], ["start_page", "doi"]
    until_break = until_first(near, odd & (F.col("start_page") > F.col("marker_page")), group, order, inclusive=False)
    members = until_first(until_break.where(~odd), is_reply(F.col("title")), group, order)
    size = F.count("*").over(Window.partitionBy("marker"))
    return members.withColumn("size", size).where("size >= 2").withColumn("symposium_group", issue_key(*(F.col(c) for c in ISSUE))).drop("size")


def merged_markers(*hits: DataFrame) -> DataFrame:
    """Lists of markers as one (J19): the first list's hit of each DOI, in the order of DOIs. Hits without DOI go."""
    ranked = [h.withColumn("list", F.lit(k)) for k, h in enumerate(hits)]
    every = reduce(lambda a, b: a.unionByName(b), ranked).where(~is_blank("doi"))
    row = F.struct(*hits[0].columns)
    return every.groupBy(F.col("doi").alias("key")).agg(F.min_by(row, F.struct("list", F.coalesce("start_page", F.lit(-1)), "title")).alias("hit")).select("hit.*").orderBy("doi")


def issue_lists(items: DataFrame, size: int = 1000) -> DataFrame:
    """(journal, volume, issue, part, items): the items of each issue by start page.

    Items without volume or issue go. A list has `size` items at most; a larger issue has several parts.
    """
    placed = place_in_group(items.where(~is_blank("volume") & ~is_blank("issue")), ISSUE, ["start_page", "doi"])
    part = ((F.col("place") - 1) / size).cast("long").alias("part")
    entry = F.struct("place", *(c for c in items.columns if c not in ISSUE))
    return placed.groupBy(*ISSUE, part).agg(F.array_sort(F.collect_list(entry)).alias("items"))


def inferred_title(members: DataFrame) -> DataFrame:
    """(symposium_group, book_title): the first sibling that tells it, by page."""
    italic = F.rtrim(squeeze(F.regexp_extract("title", r"(?i)<i>(.+?)</i>", 1)), F.lit(".,:"))
    lead = squeeze(F.regexp_extract(strip_tags(F.col("title")), r"(?i)^(.+?):\s*(?:reply|replies|response)", 1))
    told = F.coalesce(F.when(F.length(italic) > 10, italic), F.when(F.length(lead) > 5, lead))
    return members.withColumn("told", told).where("told IS NOT NULL").groupBy("symposium_group").agg(F.min_by("told", F.struct("start_page", "doi")).alias("book_title"))


def dense_issues(items: DataFrame, hit: Column) -> DataFrame:
    """Issues with at least two marker hits, and hits for three tenths of their items."""
    return items.groupBy(*ISSUE).agg(F.sum(F.when(hit, 1).otherwise(0)).alias("hits"), F.count("*").alias("n")).where(F.col("hits") >= F.greatest(F.lit(2.0), 0.3 * F.col("n")))


def records(members: DataFrame, titles: DataFrame) -> DataFrame:
    """Catalog rows of symposium members."""
    clean = squeeze(strip_tags(F.col("title")))
    return members.join(titles, "symposium_group", "left").select(
        F.coalesce("book_title", clean).alias("book_title"), F.col("journal").alias("publication_source"), clean.alias("review_summary"), "doi", F.lit("symposium").alias("entry_type"), "symposium_group",
    )
