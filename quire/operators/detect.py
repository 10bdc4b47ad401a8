"""Which items are reviews, which rows are noise: predicates as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.names import looks_like_name, words
from quire.functions.text import let, normalize, strip, strip_tags
from quire.schema import is_blank

#: What a title of something else contains, and what a review's contains.
EXCLUDED = ["editorial:", "announcing", "comment on", "response to", "reply to", "correction", "erratum", "retraction", "call for papers", "book notes", "books received", "brief notices", "notes on our contributors", "general index"]
INDICATORS = ["(review)", "book review", "review of", "reviewed work"]
COMMON_FIRST_WORDS = ["nature", "ethics", "justice", "ecology", "the", "being", "value", "animal", "people", "land", "wild", "extinction", "poverty", "growth"]


def any_of(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def tagged(c: Column, tags: str) -> Column:
    """Length of the first text inside tags."""
    return F.length(strip(strip_tags(F.regexp_extract(c, rf"(?i)<(?:{tags})>(.*?)</(?:{tags})>", 1))))


def halves(title: Column, separator: str) -> tuple[Column, Column]:
    """What stands before and after the first separator; after is null where there is none."""
    both = F.split(title, separator, 2)
    return F.trim(F.element_at(both, 1)), F.trim(F.try_element_at(both, F.lit(2)))


def begins_upper(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}")


def said(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def last_word(c: Column) -> Column:
    return F.coalesce(F.try_element_at(words(c), F.lit(-1)), F.lit(""))


def quotes_a_title(title: Column) -> Column:
    """Somebody, then a comma, then at least ten characters in quotation marks."""
    who, rest = halves(title, """,\\s*(?=["'“‘])""")
    inside = F.regexp_extract(rest, """^["'“‘](.+)["'”’]""", 1)
    return said(begins_upper(who) & (F.length(inside) >= 10))


def bold_author(title: Column) -> Column:
    """A bold name of five or more letters with a colon after it."""
    name, rest = halves(title, "</b>")
    return said(name.startswith("<b>") & (F.length(name) >= 8) & ~F.substr(name, F.lit(4)).contains("<") & rest.startswith(":"))


def ends_by_name(title: Column) -> Column:
    """The last " by " has a name after it, and a title's length before it."""
    name = F.substring_index(title, " by ", -1)
    return said(title.contains(" by ") & (F.length(title) - F.length(name) >= 14) & looks_like_name(name))


def by_somebody(title: Column, separator: str) -> Column:
    return said(begins_upper(halves(title, separator)[1]))


def owns_a_title(title: Column) -> Column:
    """The first word in the genitive is a surname, with one capitalised word or more before it."""
    owner, rest = halves(F.regexp_replace(title, "^Review of ", ""), "['’]s ")
    named = lambda w: F.size(w).between(2, 5) & F.forall(w, begins_upper) & F.coalesce(F.try_element_at(w, F.lit(-1)), F.lit("")).rlike(r"^\p{L}[\p{L}-]+$")
    return said(F.when(rest != "", let(words(owner), named)))  # without a genitive the owner is the whole text: its words are not asked for


def counts_pages(title: Column) -> Column:
    """A number of pages: its unit stands beside it or follows as a word."""
    unit = "^pp(?![a-z0-9_])"
    pairs = lambda w: F.arrays_zip(F.slice(w, 1, F.size(w) - 1).alias("number"), F.slice(w, 2, F.size(w) - 1).alias("unit"))
    two = lambda w: F.when(F.size(w) > 1, F.exists(pairs(w), lambda p: p["unit"].rlike(unit) & p["number"].rlike("[0-9]$"))).otherwise(F.lit(False))
    some = lambda w: two(w) | F.exists(w, lambda x: x.rlike("[0-9]pp(?![a-z0-9_])"))
    return F.when(F.lower(title).contains("pp"), let(words(F.lower(title)), some)).otherwise(F.lit(False))


def surname_first(title: Column) -> Column:
    """One capitalised word that no title begins with, a comma, a capitalised word."""
    surname, rest = halves(title, ", ")
    return said(F.length(surname).between(2, 20) & (word_count(surname) == 1) & surname.rlike(r"^\p{Lu}[\p{L}-]*$") & rest.rlike(r"^\p{Lu}\p{Ll}") & ~F.lower(surname).isin(COMMON_FIRST_WORDS))


def name_then_title(title: Column, separator: str, least: int) -> Column:
    """A name of two to six words before the separator, whose surname has at least `least` letters, and a capital after it."""
    name, rest = halves(title, separator)
    letters = F.translate(name, "., ", "").rlike("^[A-Za-z]+$")
    named = looks_like_name(name) & word_count(name).between(2, 6) & (F.length(last_word(name)) >= least)
    return said(F.when(begins_upper(name) & begins_upper(rest), letters & named))


def edited_volume(title: Column) -> Column:
    """Somebody, "ed." or "eds.", and a capital."""
    who, rest = halves(title, r",\s*eds?\.\s")
    return said(begins_upper(who) & begins_upper(rest))


def is_review(title: Column, mode: str = "all") -> Column:
    """Whether a work item's title is a book review's (P14). Mode `italic_only` leaves out what looks at likely forms and names alone."""
    title = F.coalesce(title, F.lit(""))
    low = F.lower(title)
    evidence = [any_of(low, INDICATORS), low.rlike(r"^review:\s"), *(tagged(title, tags) >= 15 for tags in ("i|em", "b|strong")), quotes_a_title(title), bold_author(title), by_somebody(title, r"\.\s+[Bb]y\s+(?=\p{Lu}\p{Ll})"), ends_by_name(title)]
    if mode != "italic_only":
        evidence += [owns_a_title(title), counts_pages(title), surname_first(title), by_somebody(title, r",\s+by\s"), edited_volume(title), name_then_title(title, ":", 1), name_then_title(title, r"(?<=[a-z]{2})\.\s", 3)]
    return ~any_of(low, EXCLUDED) & reduce(lambda a, b: a | b, evidence)


def is_ethics_review(title: Column) -> Column:
    """Items of one journal, by title alone."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return ~any_of(low, ["editorial", "announcement", "erratum", "corrigendum", "index", "contributors"]) & (any_of(low, ["book review", "review of", "(review)"]) | title.rlike(r"^[A-Z][\w.'-]+(?:\s[\w.'-]+)*,\s*(?:<i>|[A-Z])"))


def is_logic_review(title: Column) -> Column:
    """P16"""
    publisher = title.rlike(r"(?i)\b(?:press|publish\w*|verlag|springer|elsevier|north-holland|kluwer|reidel|birkhäuser|wiley|dover|academic|university)\b")
    article = title.rlike(r"(?i)\bvol\.\s*\d+.*\(\d{4}\),?\s*(?:no\.\s*\d+,?\s*)?pp\.\s*\d+")
    return ~title.contains("[Omnibus Review]") & (strip(title) != "") & (title.rlike(r"^Review:\s") | (~article & publisher & title.rlike(r"(?i)\bpp\.|\d+\s*pp\b|\b(?:19|20)\d{2}\b")))


def is_indexed_review(title: Column) -> Column:
    """P17"""
    return title.rlike(r"(?i)\b(?:University Press|Cambridge|Oxford|Springer|Palgrave|Routledge|MIT Press)\b|\bpp\.\s*\d+|\b978[-\d]+|\bby\s+[A-Z][a-z]+\s+[A-Z]|\(\d{4}\)|(?:New York|London|Princeton|Chicago|Cambridge):\s")


def reads_as_review(title: Column) -> Column:
    """P18"""
    return F.coalesce(
        title.rlike(r"(?i)^(?:book\s+)?reviews?\b|reviewed?\s+works?") | (title.rlike("[a-z][A-Z][a-z]") & (F.length(title) > 30))
        | title.rlike(r"(?:University Press|Routledge|Springer|Clarendon|Macmillan|[Pp]p\.\s*\d|\$\d|\d+\s*pp\.?)|\.\s+[Bb]y\s+[A-Z]|\.\s+[A-Z]\.\s*[A-Z]|\([A-Z][a-z]+:\s+[A-Z]"),
        F.lit(False),
    )


#: Fixed values: (pattern for ILIKE, journals in which alone it counts) of titles that are no reviews.
NON_REVIEWS: list[tuple[str, list[str]]] = [
    ("%list of members%", []), ("%descriptive notices%", []), ("booknotes%", ["Philosophy"]), ("book notes", ["Ethics", "Hypatia", "Phronesis"]), ("aristotle book notes", ["Phronesis"]),
    ("editor's notes", ["Phronesis"]), ("corrigendum:%", []), ("correction to:%", []), ("%erratum%", []), ("in memoriam", []), ("%announcement by the editor%", []), ("%american council%learned%", []),
    ("fall 19%through%", []), ("fall 196%summer%", []), ("book notice%", []), ("[book review - title not specified in metadata]", []), ("books received", []),
    ("book reviews (vol%", ["Ethical Perspectives"]), ("chronicle%book reviews%", ["Ethical Perspectives"]), ("index for volume%", ["The Journal of Aesthetics and Art Criticism"]),
    ("report of the%conference%", ["International Journal of Ethics"]), ("septimana spinozana%", ["Philosophy"]),
]


def is_no_review(title: Column, source: Column) -> Column:
    """P22"""
    out = (title.ilike("%errata%") & ~title.ilike("%de erratas%")) | (title.ilike("fe de erratas%") & source.ilike("%Cr_tica%"))
    for pattern, journals in NON_REVIEWS:
        out = out | (title.ilike(pattern) & source.isin(journals) if journals else title.ilike(pattern))
    return F.coalesce(out, F.lit(False))


def is_placeholder(title: Column, last: Column) -> Column:
    """P23"""
    return F.lower(F.coalesce(title, F.lit(""))).isin("book review", "book reviews", "reviews", "review", "book notes") & is_blank(last)


def is_generic(title: Column) -> Column:
    """a title that only says that this is a book review."""
    return F.coalesce(F.lower(title).isin("book review", "book reviews"), F.lit(False))


def has_metadata(title: Column) -> Column:
    """Bibliographic matter inside a title."""
    return F.coalesce(title.rlike(r"(?i)isbn|\bpp\.|\d+ pages|university press|\$\d|£\d|hardcover|paperback"), F.lit(False))


def is_self_review(author: Column, reviewer: Column, source: Column, exempt: str = "Analysis") -> Column:
    """P30"""
    return (author != "") & (F.lower(author) == F.lower(reviewer)) & (source != exempt)


def is_suspect(first: Column, last: Column) -> Column:
    """A surname alone, words of a title in a first name, or a phrase as surname."""
    title_words = r"(?i) (?:of|and|the|in|for|to|a|an|on|with|from|or|is|as) "
    return F.coalesce(((first == "") & (last != "")) | first.rlike(title_words) | last.rlike("^.* .* .*$"), F.lit(False))


def may_be_garbled(last: Column) -> Column:
    """The cheap test before is_garbled."""
    return F.coalesce(last.rlike(r"(?i)ISBN|Press|University|Publisher|Verlag|pp|pages|978-|0-|Hardcover|Paperback") | (F.length(last) > 30), F.lit(False))


def is_skipped(title: Column) -> Column:
    """Lists and notes that are no reviews of a book."""
    low = F.lower(strip(F.coalesce(title, F.lit(""))))
    return low.isin("other books of interest", "books received") | low.startswith("note on") | low.contains("full issue")


def is_no_symposium(title: Column) -> Column:
    """P29"""
    low = F.lower(strip_tags(title))
    return any_of(low, ["issue information", "front matter", "back matter", "notes on contributors", "book notes", "book received", "recent publications", "critical notices", "recent work", "erratum", "corrigendum", "correction to:"]) | low.startswith("book review") | (title.rlike(r"^<i>.+</i>\.\s+[A-Z]") & ~F.lower(title).contains("precis")) | title.rlike(r"^[A-Z][a-z]+.*?,\s*<i>")


def is_reply(title: Column) -> Column:
    return any_of(F.lower(strip_tags(title)), ["reply to", "replies", "response to", "author response"])


def is_precis(title: Column) -> Column:
    return F.lower(F.translate(title, "éÉ", "eE")).rlike(r"\bpr(?:e|é)cis\b")


def flags(title: Column, first: Column, last: Column) -> Column:
    """Reasons to look at a row again, '' for none."""
    reasons = [(F.length(normalize(F.coalesce(title, F.lit("")))) < 3, "short title"), (F.length(title) > 300, "long title"), (last.rlike(r"\d"), "digits in name"), (is_blank(first) & is_blank(last), "no author")]
    return F.concat_ws("; ", *(F.when(test, F.lit(name)) for test, name in reasons))
