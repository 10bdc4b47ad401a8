"""Data-quality phases over the catalog, each a DataFrame -> DataFrame step with a name.

run() applies a range of phases; preview() tells what it would change without writing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import names, text
from quire.operators.detect import is_generic, is_no_review, is_placeholder
from quire.operators.matching import mapped
from quire.operators.upsert import changes, survivors
from quire.schema import filled, is_blank

AUTHOR = ("book_author_first_name", "book_author_last_name")
PERSONS = (*AUTHOR, "reviewer_first_name", "reviewer_last_name")
#: Spellings of venues and their right forms.
JOURNAL_NAMES = {
    "Times LIterary Supplement": "The Times Literary Supplement", "The TImes Literary Supplement": "The Times Literary Supplement", "The London Review of Books": "London Review of Books", "The Boston Review": "Boston Review",
    "Boston Globe": "The Boston Globe", "Hedgehog Review": "The Hedgehog Review", "Financial Times": "The Financial Times", "New York Journal of Books": "The New York Journal of Books",
    "Christian Science Monitor": "The Christian Science Monitor", "ARC Digital": "Arc Digital", "British Society for Philosophy of Science": "The British Society for Philosophy of Science",
    "British Society for the Philosophy of Science": "The British Society for the Philosophy of Science", "New York Review of Books": "The New York Review of Books",
}


def on(columns: tuple[str, ...], f: Callable) -> Callable[[DataFrame], DataFrame]:
    """f on each column. Each phase names a column once, so that conditions which Spark pushes down through many phases stay small."""
    return lambda df: df.withColumns({c: text.let(F.col(c), f) for c in columns})


def on_author(f: Callable) -> Callable[[DataFrame], DataFrame]:
    """f gives (first, last) of an author, from both."""

    def step(df: DataFrame) -> DataFrame:
        fixed = text.let(F.struct(F.col(AUTHOR[0]).alias("first"), F.col(AUTHOR[1]).alias("last")), lambda s: f(s["first"], s["last"]))
        return df.withColumn("fixed", fixed).withColumns({AUTHOR[0]: F.col("fixed.first"), AUTHOR[1]: F.col("fixed.last")}).drop("fixed")

    return step


def if_named(f: Callable) -> Callable:
    """f where there is a surname."""
    return lambda first, last: F.when((last != "") & last.isNotNull(), f(F.coalesce(first, F.lit("")), last)).otherwise(F.struct(first.alias("first"), last.alias("last")))


def null_author(test: Callable) -> Callable[[DataFrame], DataFrame]:
    return on_author(lambda first, last: text.let(F.coalesce(test(first, last), F.lit(False)), lambda bad: F.struct(F.when(~bad, first).alias("first"), F.when(~bad, last).alias("last"))))


def editor_marks(c):
    """without editor markers, and of two authors the first."""
    bare = text.strip(F.regexp_replace(c, r"(?i)\s*[,(]?\s*\b(?:eds?|editors?)\b\.?\s*\)?\s*$", ""))
    one = F.element_at(F.split(bare, r"\s+and\s+", 2), 1)
    return F.when(one != "", one).otherwise(c)


def too_long(c):
    """F21"""
    return F.when((F.length(c) > 50) | ((F.length(c) > 20) & c.rlike("[0-9]")), F.lit(None)).otherwise(c)


def shorter_title(c):
    """A title of over 150 characters without its citation, if that is shorter and anything is left."""
    bare = text.strip_citation_tail(c)
    return F.when((F.length(c) > 150) & (F.length(bare) < F.length(c)) & (bare != ""), bare).otherwise(c)


PHASES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "no_reviews": lambda df: df.where(~is_no_review(F.col("book_title"), F.col("publication_source"))),
    "placeholders": lambda df: df.where(~is_placeholder(F.col("book_title"), F.col("book_author_last_name"))),
    "generic_titles": lambda df: df.where(~is_generic(F.col("book_title"))),
    "entities": lambda df: df.withColumns({c: text.html_unescape(c) for c in ("book_title", "review_summary", "publication_source")}).withColumns({c: text.unescape_name(F.col(c)) for c in PERSONS}),
    "journal_names": lambda df: mapped(df, "publication_source", JOURNAL_NAMES),
    "review_prefix": on(("book_title",), text.strip_review_prefix),
    "blank_to_null": on(PERSONS, text.null_if_blank),
    "access": lambda df: df.withColumns({"access_type": text.lower_access(F.col("access_type")), "entry_type": F.coalesce(filled("entry_type"), F.lit("review"))}),
    "trailing_commas": on(PERSONS, text.strip_trailing_commas),
    "editor_marks": on(AUTHOR, editor_marks),
    "publishers": null_author(names.is_publisher),
    "too_long": on(PERSONS, too_long),
    "duplicates": survivors,
    "one_letter_surnames": on(("book_author_last_name", "reviewer_last_name"), lambda c: F.when(c.rlike("^[A-Z]$"), F.lit(None)).otherwise(c)),
    "capitals": on(("book_title",), lambda c: F.when(text.is_all_caps(c), text.smart_title_case(c)).otherwise(c)),
    "leading_punctuation": on(("book_title",), text.strip_leading_punctuation),
    "tags": on(("book_title",), lambda c: F.when(c.rlike("<.*>"), text.strip_known_tags(c)).otherwise(c)),
    "editor_annotations": on_author(if_named(names.repaired_editor)),
    "name_swaps": on_author(if_named(names.repaired_swap)),
    "long_titles": on(("book_title",), shorter_title),
    "garbled": null_author(names.is_garbled),
    "self_reviews": lambda df: df.where(~F.coalesce((F.col("entry_type") == "review") & ~is_blank("book_author_last_name") & (F.col("book_author_first_name") == F.col("reviewer_first_name")) & (F.col("book_author_last_name") == F.col("reviewer_last_name")), F.lit(False))),
}


def run(catalog: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """All phases, or those from `first` to `last`."""
    order = list(PHASES)
    for name in order[order.index(first) if first else 0 : order.index(last) + 1 if last else None]:
        catalog = catalog.transform(PHASES[name])
    return catalog


def preview(catalog: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """SK12"""
    return changes(catalog, run(catalog, first, last), ("book_title", *PERSONS, "publication_source", "access_type", "entry_type"))


def reverified(catalog: DataFrame, items: DataFrame) -> DataFrame:
    """(id, action, book_title, first, last) of rows whose landed title was looked up again.

    keep: the title reads as a review's; reparse: it has a better title; delete: it is no review.
    """
    from quire.operators.detect import reads_as_review
    from quire.operators.parse import parse_title

    title = F.coalesce(F.try_element_at("title", F.lit(1)), F.lit(""))
    found = items.where(~is_blank("DOI")).groupBy(F.col("DOI").alias("landed_doi")).agg(F.min(title).alias("landed"), F.min("type").alias("kind"))
    rows = catalog.where(~is_blank("doi")).join(found, F.col("doi") == F.col("landed_doi")).withColumn("p", parse_title(F.col("landed")))
    is_book = reads_as_review(F.col("landed"))
    action = F.when(F.col("p").isNotNull() & (F.col("p.last") != "") & (is_blank("book_author_last_name") | names.is_garbled(F.col(AUTHOR[0]), F.col(AUTHOR[1]))), "reparse").when(is_book | (F.col("kind") == "book-review"), "keep").otherwise("delete")
    return rows.select("id", action.alias("action"), F.col("p.book_title").alias("book_title"), F.col("p.first").alias("first"), F.col("p.last").alias("last"))


def action_counts(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """A10, A11"""
    joined = found.join(catalog.select("id", "publication_source"), "id")
    return joined.groupBy("publication_source").agg(*(F.expr(f"count_if(action = '{a}')").alias(a) for a in ("keep", "reparse", "delete"))).orderBy(F.desc("delete"), "publication_source")
