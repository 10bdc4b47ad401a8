"""Citations in titles -> book title and author.

Every format is a regular expression with the places of title and author, but for titles with italics,
whose spans are read. The first in the list whose parts hold up (a long enough title, an author that reads as a
name) is the answer, and those after it are not evaluated; trace_title tells why those before it
failed. So order is the semantics, as data. Authors are split afterwards, once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.names import first_author, has_function_word, is_edited, looks_like_name
from quire.functions.spans import italic_citation, list_item
from quire.functions.text import CITIES, let, normalize, squeeze, strip, strip_tags

#: Fixed value: words of publishers that mark a citation's tail.
HOUSE = "(?:Press|University|Books|Publishing|Publishers|Verlag|Routledge|Springer|Polity|Palgrave|Bloomsbury|MIT|Verso|Penguin|Harper|Edinburgh|Norton|Oxford|Cambridge|Blackwell|Macmillan|Brill|Wiley|Clarendon)"
ED = r"(?:\(?[Ee]ds?\.?\)?)"
NAME = r"[A-Z][\w.'’-]+(?:\s+[\w.'’-]+){0,5}"
PERSON = r"[A-Z][\w.'’-]*(?:\s+(?:[A-Z][\w.'’-]*|de|del|der|la|le|van|von))*\s+[A-Z][\w'’-]+"
PEOPLE = rf"{PERSON}(?:(?:,|,?\s+and|\s+&)\s+{PERSON})*"
#: Where an imprint begins after a title: in parentheses, a place, a publisher, numbers and pages.
IMPRINT = rf"(?s)(?:\s*\([^)]*\b{HOUSE}\b|[.,]\s+(?i:{CITIES}|Lanham|Durham)[,:]\s|\.\s+(?:[A-Z]\w+\s+){{0,3}}{HOUSE}\b|\.\s+(?:ISBN|pp\b|\d+\s*pp|\d{{4}}\b)).*$"


@dataclass(frozen=True)
class Format:
    """pattern's groups: where the title and the author are (0: not there)."""

    name: str
    pattern: str
    title: int
    author: int
    on: str = "plain"  # subtitle | raw (with any prefix) | marked (tags kept) | plain
    check: bool = True  # the author must read as a name
    least: int = 4
    imprint: bool = False  # an imprint may follow the title


#: Titles with italics: spans.italic_citation reads them.
ITALICS = Format("italics", r"(?i)<(?:i|em)>", 1, 2, "marked")
FORMATS = (
    Format("SUB-A", r"^(.+?):\s+(.{6,}?)\.\s+(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?:\s+)?.+?,\s+\d{4}", 2, 1, "subtitle"),
    Format("SUB-B", rf"^(?:.*,\s*)?(?:[Ee]dited\s+by\s+)?([^,]+?),\s*[^,]*\b{HOUSE}\b.*$", 0, 1, "subtitle"),
    Format("book_review_colon", r"(?i)^(?:Commissioned\s+)?Book\s*Review\s*:\s*(.+?)\.\s+((?-i:[A-Z])[a-zA-Z.\s-]+?)\.?$", 1, 2, "raw"),
    Format("review_of_by", r"(?i)^Review\s+(?:of|Essay:)\s+(.+?),\s+by\s+(.+?)\.?$", 1, 2, "raw", check=False),
    ITALICS,
    Format("book_review_colon_title_only", r"(?i)^(?:Commissioned\s+)?Book\s*Review\s*:\s*(.+?)\.?$", 1, 0, "raw"),
    Format("review_of_title_only", r"(?i)^Review\s+(?:of|Essay:)\s+(.+?)\.?$", 1, 0, "raw"),
    Format("written_by", r"(?i)^(.+?),?\s+written\s+by\s+(.+?)\.?$", 1, 2, check=False),
    Format("edited_by_house", rf"^(.+?)[,.]?\s+[Ee]dited\s+by\s+(\S+\s+.+?)[,.]?\s+(?:[A-Z]\w+\s+)?{HOUSE}\b", 1, 2),
    Format("edited_by", r"(?i)^(.+?),?\s+edited\s+by\s+(.+?)\.?$", 1, 2, check=False),
    Format("dot_by_parenthesis", r"^(.+?)[.,]\s+[Bb]y\s+([^(]+?)[.,]?\s*\(", 1, 2),
    Format("dot_by", r"^(.+?)\.\s+[Bb]y\s+([A-Z][\w.'’ -]+?)(?:[.:,]|$)", 1, 2),
    Format("par", r"^(.+?)[.,]\s+[Pp]ar\s+([A-Z][^.,(]+)", 1, 2),
    Format("title_author_house", rf"^(.{{8,}}?),\s+({NAME})[.,]\s+[^.]*\b{HOUSE}\b", 1, 2),
    Format("by_review", r"(?i)^(.+?)\s+by\s+(.+?)\s+\(review\)$", 1, 2),
    Format("title_review", r"(?i)^(.+?)\s+\(review\)$", 1, 0),
    Format("comma_by", r"^(.+?),\s+by\s+([A-Z].+?)(?:[.,:(]|$)", 1, 2),
    Format("review_author_title", r"(?i)^Review:\s+([^:]+?):\s+(.+?)\.?$", 2, 1, "raw"),
    Format("possessive", r"^([A-Z][\w.'-]+(?:\s+[A-Z][\w.-]*)*\s+[A-Z][\w-]+)['’]s\s+(.{5,}?)(?:\.\s.*)?$", 2, 1),
    Format("author_quoted", r"""^([A-Z].+?),\s*(?:\(eds?\.?\)\s*,?\s*)?["'“‘](.{5,}?)["'”’]""", 2, 1),
    Format("author_eds_title", r"^(.+?),\s*\(?eds?\.?\)?[,.:]?\s+([A-Z].{4,}?)\.?$", 2, 1),
    Format("author_comma_title", rf"^({NAME}),\s+([A-Z].{{9,}}?)\.?$", 2, 1, imprint=True),
    Format("author_dot_title", r"^([A-Z][a-zA-Z.\s,'-]*[a-z]{2})\.\s+([A-Z][a-z].{4,}?)\.?$", 2, 1),
    Format("author_colon_title", rf"^({NAME}):\s+([A-Z].{{4,}}?)\.?$", 2, 1),
    Format("title_by_editors", rf"^(.{{6,}}?)\s+by\s+({PEOPLE},?\s*{ED})$", 1, 2),
    Format("title_by_author", rf"^(.{{8,}}?)\s+by\s+({NAME})\.?$", 1, 2),
    Format("title_dash_author", rf"^(.{{5,}}?)\s+-\s+({NAME})\.?$", 1, 2),
    Format("title_dash_author", rf"^(.{{4,}}?)\s*[-–—]\s*({PEOPLE}(?:,?\s*{ED})?)\.?$", 1, 2),
    Format("last_first_title", r"^([A-Z][\w'-]+,\s+[A-Z][\w.\s]*?)\.\s+(.{5,}?)\.?$", 2, 1, check=False),
)
#: The same for sources with forms of their own: a logic journal, a moral-philosophy journal, an index, titles of a lookup service, an ethics journal.
LOGIC_FORMATS = (
    Format("review_author_title", r"^Review:\s*((?:[A-Z][\w'’.-]*\s*){1,5}(?:,?\s+and\s+(?:[A-Z][\w'’.-]*\s*){1,5})?),\s+(.{5,}?)\.?$", 2, 1),
    Format("title_edited_by", rf"^(.+?),\s+edited\s+by\s+(.+?),\s+[^,]*\b{HOUSE}\b", 1, 2, check=False),
    Format("author_title_house", rf"^((?:[A-Z][\w'’-]+|[A-Z]\.)(?:(?:,?\s+(?:and\s+)?)(?:[A-Z][\w'’-]+|[A-Z]\.))*)\.\s+(.{{5,}}?)\.\s+(?:[^.]+\.\s+)*?[^.]*\b{HOUSE}\b", 2, 1),
)
MORAL_FORMATS = (
    Format("marked_by", r"""(?i)^Review(?:\s+of|:)\s+[_"](.+?)[_"]\s*(?:by\s+)?(.+?)\s*(?:\((?:Editors?|Eds?\.?)\))?$""", 1, 2, "raw", check=False),
    Format("marked_only", r"""(?i)^Review(?:\s+of|:)\s+[_"](.+?)[_"]\s*$""", 1, 0, "raw"),
    Format("plain_by", r"(?i)^Review(?:\s+of|:)\s+(.+?)\s+by\s+(.+?)$", 1, 2, "raw", check=False),
    Format("plain_only", r"(?i)^Review(?:\s+of|:)\s+(.+?)$", 1, 0, "raw"),
)
INDEX_FORMATS = (
    Format("by_house", rf"(?i)^(.+?)\s+by\s+(.+?)\.\s+(?:(?-i:[A-Z])[a-z]+(?:\s+(?-i:[A-Z])[a-z]+)*:?\s+)?[^.]*\b{HOUSE}\b", 1, 2, check=False),
    Format("by_year", r"(?i)^(.+?)\s+by\s+(.+?)[,.]?\s+\(?(?:19|20)\d{2}", 1, 2, check=False),
    Format("dot_by", r"(?i)^(.+?)\.\s+by\s+(.+?)(?:\.\s|,\s|$)", 1, 2, check=False),
    Format("title_only", r"^(.+)$", 1, 0),
)
LOOKUP_FORMATS = (
    Format("comma_by", r"(?i)^(.+?),\s+by\s+(.+?)\.?\s*$", 1, 2, check=False),
    Format("prefix_title_author", r"(?i)^Book\s+Reviews?\.\s*(.+?)\s+((?-i:[A-Z])[\w.'-]+\s+(?:(?-i:[A-Z])\.\s+)?(?-i:[A-Z])[\w'-]+)$", 1, 2, "raw"),
    Format("title_dot_author", r"^(.+?)\.\s+([A-Z][a-zA-Z.\s-]+?)\.?\s*$", 1, 2),
    Format("title_dash_author", r"^(.+?)\s+-\s+(.+?)$", 1, 2),
)
ETHICS_FORMATS = (
    Format("author_italic", rf"(?i)^([^<>]{{3,}}?)[\s,.;:]*(?:{ED})?[\s,.;:]*<i>(.+?)</i>", 2, 1, "marked", check=False),
    Format("italic_only", r"(?i)<i>(.+?)</i>", 1, 0, "marked"),
    Format("author_dot_title", r"^([A-Z][^.]+?)\.\s+([^.]{4,}?)\.", 2, 1, check=False),
)
#: Subtitles of a journal that names author and italic title in them.
SUBTITLE_FORMATS = (Format("of_author_italic", r"(?i)^(?:Re(?:view|ivew)\s+of\s+)?([^<>]+?)[\s,]*<i>([^<]+)</i>", 2, 1, "marked", check=False, least=1), *ETHICS_FORMATS[1:2])
GENERIC = ["book review", "book reviews", "review", "reviews", "review essay"]


def parse_title(title: Column, subtitle: Column | None = None, formats: tuple[Format, ...] = FORMATS) -> Column:
    """(book_title, first, last, is_edited, has_multiple, needs_lookup, format); null if nothing fits."""
    return let(forms_of(title, subtitle), lambda s: let(best_format(s, formats), lambda b: let(first_author(b["author"]), lambda who: parsed(s, b, who))))


CANDIDATE = "struct<format: string, title: string, author: string, named: boolean, check: boolean, least: int, edited: boolean>"


def candidate(s: Column, f: Format) -> Column:
    """CANDIDATE of a format that fits; null if its pattern does not. named: the author must be there; check: it must read as a name."""
    shape = lambda name, title, author, named, edited: F.struct(
        name.alias("format"), F.rtrim(title, F.lit(".,: ")).alias("title"), author.alias("author"), named.alias("named"), F.lit(f.check and f is not ITALICS).alias("check"), F.lit(f.least).alias("least"), edited.alias("edited")
    )
    if f is ITALICS:  # what stands there for an author but is no name is none
        named = lambda c: (c["author"] != "") & looks_like_name(F.regexp_replace(c["author"], rf"(?i),?\s*{ED}$", ""))
        alone = lambda c, ok: shape(F.when(ok, c["format"]).otherwise("italic_title_only"), c["title"], F.when(ok, c["author"]).otherwise(""), ok, ok & c["edited"])
        found = let(italic_citation(s["marked"]), lambda c: F.when(c.isNotNull(), let(named(c), lambda ok: alone(c, ok))))
    else:
        part = lambda k: squeeze(strip_tags(F.regexp_extract(s[f.on], f.pattern, k)))
        title = part(f.title) if f.title else s["bare"]
        author = F.regexp_replace(part(f.author), r"[,.\s:;]+$", "") if f.author else F.lit("")
        found = shape(F.lit(f.name), F.regexp_replace(title, IMPRINT, "") if f.imprint else title, author, F.lit(bool(f.author)), F.lit(f.name in ("edited_by", "edited_by_house", "author_eds_title")))
    return F.when(s[f.on].rlike(f.pattern), found)


def nth(s: Column, i: Column, formats: tuple[Format, ...]) -> Column:
    """The candidate of the i-th format, from 0: no other is evaluated."""
    out = F.when(i == 0, candidate(s, formats[0]))
    for k, f in enumerate(formats[1:], 1):
        out = out.when(i == k, candidate(s, f))
    return out


def fault(c: Column) -> Column:
    """Why a candidate does not hold up; null if it does."""
    checked = lambda bare: F.when(bare == "", "no author").when(c["check"] & ~looks_like_name(bare), "no name").when((c["format"] == "author_colon_title") & has_function_word(bare), "function word")
    named = F.when(c["named"], let(F.regexp_replace(c["author"], rf"(?i),?\s*{ED}$", ""), checked))
    return F.when(c.isNull(), "no match").when(F.length(c["title"]) < c["least"], "short title").otherwise(named)


def places(formats: tuple[Format, ...]) -> Column:
    return F.sequence(F.lit(0), F.lit(len(formats) - 1))


def best_format(s: Column, formats: tuple[Format, ...]) -> Column:
    """The first of the formats that fits and holds up: format, title, author, edited. Formats after it are not evaluated."""
    sound = lambda i: let(nth(s, i, formats), lambda c: F.when(c.isNotNull() & fault(c).isNull(), c))
    return F.aggregate(places(formats), F.lit(None).cast(CANDIDATE), lambda found, i: F.coalesce(found, sound(i)))


def forms_of(title: Column, subtitle: Column | None) -> Column:
    """A title as formats read it: raw, marked (no prefix, italics as <i>), plain, bare (raw without tags), and the subtitle."""
    raw = normalize(F.coalesce(title, F.lit("")))
    marked = F.regexp_replace(raw, r"(?i)<(/?)(?:b|strong|em)>", "<$1i>")
    marked = strip(F.regexp_replace(F.regexp_replace(marked, r"(?i)^(?:Commissioned\s+)?Book\s*Reviews?\s*:?\s*", ""), r"^Review\s+of\s+", ""))
    sub = normalize(F.coalesce(subtitle if subtitle is not None else F.lit(None).cast("string"), F.lit("")))
    return F.struct(raw.alias("raw"), marked.alias("marked"), squeeze(strip_tags(marked)).alias("plain"), squeeze(strip_tags(raw)).alias("bare"), sub.alias("subtitle"))


def trace_title(title: Column, subtitle: Column | None = None, formats: tuple[Format, ...] = FORMATS) -> Column:
    """array of (format, verdict) in the order of the formats, up to the first that holds up: why each of those before it did not, and "fits"."""
    names = F.array(*(F.lit(f.name) for f in formats))
    verdict = lambda s, i: F.struct(F.element_at(names, i + 1).alias("format"), F.coalesce(let(nth(s, i, formats), fault), F.lit("fits")).alias("verdict"))
    verdicts = lambda s: F.transform(places(formats), lambda i: verdict(s, i))
    upto = lambda v: F.coalesce(F.nullif(F.array_position(F.transform(v, lambda x: x["verdict"] == "fits"), True), F.lit(0)), F.size(v)).cast("int")
    return let(forms_of(title, subtitle), lambda s: let(verdicts(s), lambda v: F.slice(v, F.lit(1), upto(v))))


def parsed(s: Column, best: Column, who: Column) -> Column:
    shape = lambda title, first, last, edited, several, wanting, name: F.struct(title.alias("book_title"), first.alias("first"), last.alias("last"), edited.alias("is_edited"), several.alias("has_multiple"), wanting.alias("needs_lookup"), name.alias("format"))
    none, no = F.lit(""), F.lit(False)
    found = shape(best["title"], who["first"], who["last"], best["edited"] | F.coalesce(is_edited(best["author"]), no), who["has_multiple"], who["last"] == "", best["format"])
    generic = F.lower(s["bare"]).isin(GENERIC) & (s["subtitle"] == "")
    return F.when(generic, shape(none, none, none, no, no, F.lit(True), F.lit("generic"))).when(best.isNotNull(), found)


def parse_list_item(text: Column) -> Column:
    """(book_title, author, reviewer, venue) of a weekly list's item, passive or active."""
    tidy = squeeze(strip_tags(text))
    passive = r"^(.+?),?\s+by\s+(.+?),?\s+is\s+reviewed\s+by\s+(.+?)\s+(?:at|in|for)\s+(.+?)\.?$"
    active = r"^(.+?)\s+reviews\s+(.+?),?\s+by\s+(.+?),?\s+(?:at|in|for)\s+(.+?)\.?$"
    possessive = r"^(.+?)['’]s\s+(.+?)\s+(?:is\s+)?reviewed\s+by\s+(.+?)\s+(?:at|in|for)\s+(.+?)\.?$"

    def got(pattern: str, title: int, author: int, reviewer: int, venue: int) -> Column:
        return F.struct(*(F.regexp_extract(tidy, pattern, k).alias(n) for n, k in (("book_title", title), ("author", author), ("reviewer", reviewer), ("venue", venue))))

    return F.when(tidy.rlike(passive), got(passive, 1, 2, 3, 4)).when(tidy.rlike(active), got(active, 2, 3, 1, 4)).when(tidy.rlike(possessive), got(possessive, 2, 1, 3, 4))


def list_rows(posts: DataFrame) -> DataFrame:
    """Posts -> list items -> one row for each book and each venue, with the venue's own link.

    Items that mark no book and venue in italics are read as plain text, with their first link.
    """
    items = posts.select("id", "date", "link", F.posexplode(F.regexp_extract_all("content.rendered", F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1))).alias("place", "item"))
    plain = let(parse_list_item(F.col("item")), lambda p: F.when(p.isNotNull(), plain_entries(p, F.regexp_extract("item", r"""href=["']([^"']+)""", 1))))
    found = items.withColumn("e", F.coalesce(list_item(F.col("item")), plain)).where("e IS NOT NULL")
    return found.select("id", "date", "place", F.explode("e").alias("e")).select("id", "date", "place", "e.book_title", "e.author", "e.reviewer", "e.review_link", "e.venue")


def plain_entries(p: Column, link: Column) -> Column:
    books, venues = F.split(p["book_title"], r"\s*;\s*|\s+and\s+also\s+"), F.split(p["venue"], r"\s*(?:;|,?\s+and\s+(?:at|in)\s+)\s*")
    entry = lambda b, v: F.struct(b.alias("book_title"), p["author"].alias("author"), p["reviewer"].alias("reviewer"), v.alias("venue"), link.alias("review_link"))
    return F.flatten(F.transform(books, lambda b: F.transform(venues, lambda v: entry(b, v))))
