"""Matching records with books, works and search results. Every join has a blocking key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.dates_urls import date_in_snippet, domain, normalize_url
from quire.functions.names import split_name
from quire.functions.text import comparison_key, significant_words, strip_tags, title_similarity, word_set
from quire.operators.windows import best
from quire.schema import is_blank

GENERIC_TITLES = ["introduction", "ethics", "philosophy", "metaphysics", "logic", "reason", "justice", "freedom", "truth", "knowledge"]


def beginnings(key: Column) -> Column:
    """The first 2^k and 2^(k-1) characters, 2^k being the largest power within the length.

    If one key begins another of at most 1.9 times its length, the two have one of these in common.
    """
    size = F.floor(F.log2(F.greatest(F.length(key), F.lit(1)))).cast("int")
    at = lambda k: F.concat(F.lit("^"), F.substring(key, F.lit(1), F.pow(F.lit(2), F.greatest(k, F.lit(0))).cast("int")))
    return F.when(key != "", F.array_distinct(F.array(at(size), at(size - 1)))).otherwise(F.array().cast("array<string>"))


def blocked(titles: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, block) from (id, title): beginnings, and the rarest words of the full and the main title.

    Titles of similarity 0.5 or more begin each other, or have more than four fifths of the longer
    one's words in common; then they share one of the rarest fifth (and one more) of its words.
    """
    full, main = comparison_key(F.col("title"), False), comparison_key(F.col("title"))
    keys = titles.select("id", full.alias("full"), main.alias("main"))
    starts = keys.select("id", F.explode(F.array_union(beginnings(F.col("full")), beginnings(F.col("main")))).alias("block"))
    words = keys.select("id", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("full").alias("key")), F.struct(F.lit(1).alias("part"), F.col("main").alias("key")))).alias("k")).select("id", "k.part", F.explode(word_set(F.col("k.key"))).alias("word"))
    ranked = words.join(counts, "word").groupBy("id", "part").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("w"))
    rare = ranked.select("id", F.explode(F.slice("w", F.lit(1), (F.floor(F.size("w") * 0.2) + 1).cast("int"))).alias("w")).select("id", F.col("w.word").alias("block"))
    return starts.unionByName(rare).distinct()


def similar_titles(records: DataFrame, works: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(record, work, score) of titles that match, from (record, title) and (work, title)."""
    if threshold < 0.5:
        raise ValueError("blocks are made for similarities of 0.5 or more")
    a, b = records.select(F.col("record").alias("id"), "title"), works.select(F.col("work").alias("id"), "title")
    counts = a.select("title").unionByName(b.select("title")).select(F.explode(word_set(comparison_key(F.col("title"), False))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    pairs = blocked(a, counts).withColumnRenamed("id", "record").join(blocked(b, counts).withColumnRenamed("id", "work"), "block").select("record", "work").distinct()
    titled = pairs.join(records.select("record", F.col("title").alias("a")), "record").join(works.select("work", F.col("title").alias("b")), "work")
    return titled.withColumn("score", title_similarity(F.col("a"), F.col("b"))).where(F.col("score") >= threshold).select("record", "work", "score")


def best_work(records: DataFrame, works: DataFrame) -> DataFrame:
    """The most similar work of each record; ties by nearness of years, then rank.

    records: record, title, year. works: work, title, year, rank, authorships.
    """
    found = similar_titles(records, works).join(records.select("record", F.col("year").alias("y1")), "record").join(works.select("work", F.col("year").alias("y2"), "rank", "author"), "work")
    penalty = F.coalesce(F.abs(F.col("y1") - F.col("y2")), F.lit(99))
    return best(found.where(F.coalesce(F.col("y2") <= F.col("y1") + 1, F.lit(True))), ["record"], [F.desc("score"), penalty, F.col("rank"), F.col("work")]).withColumn("name", split_name(F.col("author")))


def best_book(records: DataFrame, books: DataFrame, accept: int = 5) -> DataFrame:
    """As best_work with whole scores: title 10, 7 or 5, year 5, 3, 1 or -2."""
    works_of = books.select("work", "title")
    found = similar_titles(records, works_of).join(records.select("record", F.col("title").alias("a"), F.col("year").alias("y1")), "record")
    pairs = found.join(works_of, "work").withColumnRenamed("title", "b").join(books.select("work", F.col("year").alias("y2"), "rank", "author"), "work")
    a, b = comparison_key(F.col("a")), comparison_key(F.col("b"))
    title = F.when(a == b, 10).when(a.startswith(b) | b.startswith(a), 7).otherwise(5)
    gap = F.col("y1") - F.col("y2")
    year = F.when(gap.isNull(), 0).when(gap.between(0, 2), 5).when(gap.between(3, 5), 3).when(gap.between(6, 10), 1).otherwise(-2)
    scored = pairs.withColumn("score", title + year).where(F.col("score") >= accept)
    return best(scored, ["record"], [F.desc("score"), F.col("rank"), F.col("work")]).withColumn("name", split_name(F.col("author")))


def matched_share(words: Column, text: Column) -> Column:
    n = F.size(words)
    return F.when(n > 0, F.size(F.filter(words, lambda w: F.lower(text).contains(F.lower(w)))) / n)


def headline_matches(reviews: DataFrame, books: DataFrame) -> DataFrame:
    """Newspaper reviews of candidate books (J8): url, headline; key, title, last.

    Surnames of one word meet headline words in an equi join; surnames of several words are
    searched for their first word, and then as a whole.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("headline"), F.lit(r"[\p{L}'-]+"), F.lit(0)))
    heads = reviews.where(F.lower("headline").contains("review")).select("url", "headline", F.explode(words).alias("word"))
    named = books.where(~is_blank("last")).withColumn("word", F.lower(F.split_part("last", F.lit(" "), F.lit(1))))
    long_words = F.filter(significant_words(F.col("title")), lambda w: F.length(w) >= 4)
    pairs = heads.join(named, "word").where(F.concat(F.lit(" "), F.regexp_replace(F.lower("headline"), r"[^\p{L}'-]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.lower("last"), F.lit(" "))))
    return pairs.where(F.coalesce(matched_share(long_words, F.col("headline")), F.lit(0)) >= 0.75).select("url", "key").distinct()


def is_review_result(title: Column, snippet: Column, book: Column, last: Column) -> Column:
    """Whether a search result is a review of a book."""
    text = F.lower(F.concat_ws(" ", title, snippet))
    words = significant_words(book)
    ratio = F.coalesce(matched_share(words, text), F.lit(0.0))
    signal = text.rlike("review|university press|oxford|cambridge|princeton|harvard|routledge|mit press") | text.contains(F.concat(F.lit("on "), F.substring(F.lower(book), 1, 30)))
    short = F.size(words) < 4
    return (last != "") & text.contains(F.lower(last)) & F.when(short, (ratio >= 0.6) & signal).when(signal, ratio >= 0.4).otherwise(ratio >= 0.6)


def verified_results(results: DataFrame, books: DataFrame, venues: DataFrame, catalog: DataFrame) -> DataFrame:
    """Results of book searches -> rows: verify, tidy the URL, drop known ones, name the venue.

    results: key, title, snippet, url. books: key, book_title, first, last. venues: domain, venue, access.
    """
    found = results.join(books, "key").withColumn("domain", domain(F.col("url"))).join(venues, "domain")
    found = found.where(is_review_result(F.col("title"), F.col("snippet"), F.col("book_title"), F.col("last"))).withColumn("review_link", normalize_url(F.col("url")))
    known = catalog.select(normalize_url(F.col("review_link")).alias("known")).distinct()
    fresh = best(found.join(known, F.col("review_link") == F.col("known"), "left_anti"), ["review_link"], [F.col("key")])
    return fresh.select("book_title", F.col("first").alias("book_author_first_name"), F.col("last").alias("book_author_last_name"), F.col("venue").alias("publication_source"), date_in_snippet(F.col("snippet")).alias("publication_date"), "review_link", F.col("access").alias("access_type"))


def keyword_matches(articles: DataFrame, books: DataFrame) -> DataFrame:
    """Articles whose keywords name the author, and the title by half, or whose text has three quarters."""
    person = articles.select("*", F.explode(F.filter("keywords", lambda k: k["name"] == "Person")).alias("k")).select("web_url", "headline", "abstract", "snippet", "keywords", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("k.value"), F.lit(r"[\p{L}'-]+"), F.lit(0)))).alias("word"))
    pairs = person.join(books.withColumn("word", F.lower(F.element_at(F.split("last", " "), -1))), "word")
    words = significant_words(F.col("title"))
    titled = F.exists(F.filter("keywords", lambda k: k["name"] == "Title"), lambda k: F.coalesce(matched_share(words, k["value"]), F.lit(0)) >= 0.5)
    text = F.concat_ws(" ", F.col("headline.main"), "abstract", "snippet")
    return pairs.where(titled | (F.coalesce(matched_share(words, text), F.lit(0)) >= 0.75)).select("web_url", "key").distinct()


def candidate_books(catalog: DataFrame, coverage: DataFrame, least: int = 2) -> DataFrame:
    """Books reviewed `least` times or more that mainstream coverage lacks."""
    books = (
        catalog.where(~is_blank("book_title") & ~is_blank("book_author_last_name"))
        .groupBy(F.lower("book_title").alias("t"), F.lower("book_author_last_name").alias("l"))
        .agg(F.count("*").alias("n"), F.min_by("book_title", "id").alias("title"), F.min_by("book_author_last_name", "id").alias("last"))
        .where(F.col("n") >= least)
    )
    books = books.where(~F.col("t").isin(GENERIC_TITLES) & (F.size(significant_words(F.col("title"))) >= 3))
    have = coverage.select(F.lower("book_title").alias("t"), F.lower("book_author_last_name").alias("l")).distinct()
    return books.join(have, ["t", "l"], "left_anti").select(F.concat_ws("|", "t", "l").alias("key"), "title", "last", "n")


def mapped(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """A lookup in a small literal map, other values as they are."""
    if not names:
        return df
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return df.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))


def zipped(batch: DataFrame, left: str, right: str) -> DataFrame:
    """Requests and responses by their places in two arrays."""
    return zipped_of(batch, left, right, ())


def zipped_of(batch: DataFrame, left: str, right: str, keys: tuple[str, ...]) -> DataFrame:
    """As zipped(), with the batch's own columns `keys`."""
    pairs = F.posexplode(F.arrays_zip(F.col(left).alias("request"), F.col(right).alias("response"))).alias("place", "pair")
    return batch.select(*keys, pairs).select(*keys, "place", "pair.request", "pair.response")


def title_mentions(items: DataFrame, book: str, surname: str) -> DataFrame:
    """Fallback grouping by title when pages are missing."""
    low = F.lower(strip_tags(F.col("title")))
    key = "".join(ch for ch in book.lower() if ch.isalnum() or ch == " ").strip()
    test = low.rlike("reply|replies|response to|symposium")
    if key:
        test = test | low.contains(key)
    if len(surname) > 3:
        test = test | low.contains(surname.lower())
    return items.where(test)
