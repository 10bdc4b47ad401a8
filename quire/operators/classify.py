"""Subfields: by journal where a map knows it, by a pluggable classifier for the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.dates_urls import balanced_json, classifier_prompt
from quire.schema import filled, is_blank

#: Words that tell a subfield in the stand-in classifier.
KEYWORDS = {"ethics": "ethic|moral|virtue", "political": "politic|justice|democra|liberal", "mind": "mind|conscious|perception", "language": "language|meaning|semantic", "science": "science|physics|biolog", "logic": "logic|proof|set theory", "aesthetics": "aesthetic|art|beauty", "metaphysics": "metaphysic|ontolog|causa", "epistemology": "knowledge|epistem|belief", "history": "plato|aristotle|kant|hegel|hume|descartes|medieval|ancient"}


def by_journal(catalog: DataFrame, journals: DataFrame) -> DataFrame:
    """J2. journals: publication_source, primary, secondary; only unset subfields are filled, of several rows of a journal by the least."""
    known = journals.groupBy("publication_source").agg(F.min(F.struct("primary", "secondary")).alias("m")).select("publication_source", F.col("m.primary").alias("p"), F.col("m.secondary").alias("s"))
    unset = is_blank("subfield_primary")
    joined = catalog.join(known, "publication_source", "left")
    return joined.withColumn("subfield_secondary", F.when(unset & F.col("p").isNotNull(), F.col("s")).otherwise(F.col("subfield_secondary"))).withColumn("subfield_primary", F.coalesce(filled("subfield_primary"), F.col("p"), F.col("subfield_primary"))).select(*catalog.columns)


def keyword_classifier(prompt: Column) -> Column:
    """A stand-in for an external text classifier: the first subfield one of whose words occurs."""
    low = F.lower(prompt)
    return F.coalesce(*(F.when(low.rlike(words), F.lit(name)) for name, words in KEYWORDS.items()))


def requests(catalog: DataFrame, size: int = 5000) -> DataFrame:
    """(batch, id, prompt) of unclassified rows for an external service."""
    rows = catalog.where(is_blank("subfield_primary"))
    return rows.select((F.col("id") / size).cast("long").alias("batch"), "id", classifier_prompt(F.col("book_title"), F.col("review_summary"), F.col("publication_source")).alias("prompt"))


def answers(replies: DataFrame, known: list[str]) -> DataFrame:
    """(id, primary, secondary) from free-text replies with a JSON object; unknown codes count as none."""
    found = replies.withColumn("json", balanced_json(F.col("reply")))
    code = lambda k: F.when(F.get_json_object("json", f"$.{k}").isin(known), F.get_json_object("json", f"$.{k}"))
    return found.select("id", code("primary").alias("primary"), code("secondary").alias("secondary")).where("primary IS NOT NULL")


def classify(catalog: DataFrame, journals: DataFrame, classifier: Callable[[Column], Column] = keyword_classifier) -> DataFrame:
    """The map first, then the classifier."""
    mapped = by_journal(catalog, journals)
    prompt = classifier_prompt(F.col("book_title"), F.col("review_summary"), F.col("publication_source"))
    return mapped.withColumn("subfield_primary", F.coalesce(filled("subfield_primary"), classifier(prompt), F.col("subfield_primary")))
