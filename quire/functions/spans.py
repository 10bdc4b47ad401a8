"""Marked text as typed spans, and rules over neighbouring spans, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.names import looks_like_name
from quire.functions.text import CITIES, let, squeeze, strip, unescape_common

SPAN = "array<struct<text: string, italic: boolean, href: string>>"
PLAIN_ENDS = ".,;: "
TEXT, LINK = 0, 2


def spans(html: Column) -> Column:
    """SPAN of the text between tags: what is inside <i> or <em> is italic, what is inside <a> has its target.

    Tags may be nested in any order; other tags leave no trace. Neighbours of one kind are one span.
    """
    tokens = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("<[^>]*>|[^<]+|<"), F.lit(0))
    marks = F.filter(F.transform(tokens, mark), lambda m: m["kind"].isNotNull())
    shape = lambda depth, href, out: F.struct(depth.alias("depth"), href.alias("href"), out.alias("out"))

    def step(state: Column, m: Column) -> Column:
        depth, href, out = state["depth"], state["href"], state["out"]
        new = lambda t: F.array(F.struct(t.alias("text"), (depth > 0).alias("italic"), href.alias("href")))
        joins = lambda last: F.coalesce((last["italic"] == (depth > 0)) & last["href"].eqNullSafe(href), F.lit(False))
        more = let(F.try_element_at(out, F.lit(-1)), lambda last: F.when(joins(last), F.concat(F.slice(out, 1, F.size(out) - 1), new(F.concat(last["text"], m["text"])))).otherwise(F.concat(out, new(m["text"]))))
        return F.when(m["kind"] == TEXT, shape(depth, href, more)).when(m["kind"] == LINK, shape(depth, m["href"], out)).otherwise(shape(F.greatest(depth + m["kind"], F.lit(0)), href, out))

    return F.aggregate(marks, shape(F.lit(0), F.lit(None).cast("string"), F.array().cast(SPAN)), step, lambda s: s["out"])


def mark(token: Column) -> Column:
    """(kind, text, href) of a token, each looked at once: what opens or closes italics is 1 or -1, an <a> or its end LINK; null for other tags."""
    shape = lambda kind, text, href: F.struct(kind.cast("int").alias("kind"), text.cast("string").alias("text"), href.cast("string").alias("href"))
    none = F.lit(None)
    target = F.regexp_extract(token, r"""(?i)\shref\s*=\s*(?:"([^"]*)"|'[^']*'|[^\s>"']+)""", 0)
    target = F.regexp_replace(F.regexp_replace(target, r"(?i)^\shref\s*=\s*", ""), """^["']|["']$""", "")
    kind = lambda name: F.when(name.isin("i", "em"), 1).when(name.isin("/i", "/em"), -1).when(name.isin("a", "/a"), LINK)
    tag = lambda name: shape(kind(name), none, F.when(name == "a", F.nullif(target, F.lit(""))))
    is_tag = token.startswith("<") & (F.length(token) > 1)
    return F.when(is_tag, let(F.lower(F.regexp_extract(token, r"^<\s*(/?\s*[a-zA-Z0-9]+)", 1)), tag)).otherwise(shape(F.lit(TEXT), token, none))


def bare(c: Column) -> Column:
    return trimmed(squeeze(unescape_common(c)))


def trimmed(c: Column) -> Column:
    return F.rtrim(F.ltrim(c, F.lit(".,;: ")), F.lit(PLAIN_ENDS))


def neighbours(s: Column) -> Column:
    """Each span with its number and the plain text just before and after it ('' beside another marked span)."""
    beside = lambda x: F.coalesce(F.when(~x["italic"], x["tidy"]), F.lit(""))
    shape = lambda t, x, i: F.struct(
        i.alias("i"), trimmed(x["tidy"]).alias("text"), x["italic"].alias("italic"), x["href"].alias("href"), beside(F.try_element_at(t, F.when(i > 0, i).otherwise(F.lit(None)))).alias("before"), beside(F.try_element_at(t, i + 2)).alias("after")
    )
    tidy = F.transform(s, lambda x: F.struct(squeeze(unescape_common(x["text"])).alias("tidy"), x["italic"].alias("italic"), x["href"].alias("href")))
    return let(tidy, lambda t: F.transform(t, lambda x, i: shape(t, x, i)))


def list_item(html: Column) -> Column:
    """array of (book_title, author, reviewer, venue, review_link): the reviews that an item of a weekly list names.

    Italic spans are books or venues. A venue is the last of them, and any after "at", "in" or "for". Each venue has its own
    link, or else the item's first link that is no shop's; each book has the author that follows it; each venue
    has the reviewer before it, or the one before the first venue. Null if the item has no book beside a venue.
    """
    return let(neighbours(spans(html)), lambda m: let(F.filter(m, lambda x: x["italic"] & (x["text"] != "")), lambda marked: entries(m, marked)))


def is_shop(href: Column) -> Column:
    return F.coalesce(href.contains("amazon.com"), F.lit(False))


def entries(m: Column, marked: Column) -> Column:
    last, first = F.try_element_at(marked, F.lit(-1))["i"], F.try_element_at(marked, F.lit(1))["i"]
    is_venue = lambda x: (x["i"] == last) | ((x["i"] != first) & x["before"].rlike(r"(?i)\b(?:at|in|for)$"))
    by = lambda x: F.regexp_extract(x["before"], r"(?i)^(?:.*\b)?by\s+(.+?),?\s+(?:at|in|for)$", 1)
    venues = F.transform(F.filter(marked, is_venue), lambda x: F.struct(x["text"].alias("text"), x["href"].alias("href"), by(x).alias("by")))
    books = F.filter(marked, lambda x: ~is_venue(x) & (F.length(x["text"]) > 5))
    links = F.filter(m, lambda x: x["href"].isNotNull() & ~is_shop(x["href"]) & (x["text"] != ""))
    opening = F.try_element_at(m, F.lit(1))
    active = F.when(~opening["italic"], F.regexp_extract(opening["text"], r"(?i)^(.+?)\s+reviews$", 1))
    facts = F.struct(venues.alias("venues"), books.alias("books"), F.coalesce(F.try_element_at(links, F.lit(1))["href"], F.lit("")).alias("link"), F.nullif(active, F.lit("")).alias("active"))

    def rows(f: Column) -> Column:
        author = lambda b: F.rtrim(F.regexp_extract(b["after"], r"(?i)^[,\s]*(?:(?:edited|translated)\s+)?by\s+(.+?)(?:,?\s+(?:is|are)\s+(?:both\s+)?reviewed\b.*|,?\s+(?:at|in|for)|[;,]?\s+and|[;,])?$", 1), F.lit(PLAIN_ENDS))
        own = lambda v: F.when(v["href"].isNotNull() & ~is_shop(v["href"]), v["href"]).otherwise(f["link"])
        reviewer = F.coalesce(F.try_element_at(F.filter(f["venues"], lambda v: v["by"] != ""), F.lit(1))["by"], F.lit(""))
        who = lambda v: F.coalesce(f["active"], F.nullif(v["by"], F.lit("")), reviewer)
        each = lambda b: let(author(b), lambda a: F.transform(f["venues"], lambda v: F.struct(b["text"].alias("book_title"), a.alias("author"), who(v).alias("reviewer"), v["text"].alias("venue"), own(v).alias("review_link"))))
        return F.when(F.size(f["books"]) > 0, F.flatten(F.transform(f["books"], each)))

    return let(facts, rows)


#: Where a person's name after a title ends: a sentence, a year, a place or a parenthesis.
AFTER_NAME = rf"(?s)(?:(?<!\b\p{{Lu}})\.\s+(?=\p{{Lu}}\p{{Ll}}{{2,}})|[.,]\s+(?=\d{{4}}|(?i:{CITIES})\b)|\s*\().*$"


def italic_citation(marked: Column) -> Column:
    """(format, title, author, edited) of a title with italics (survey 2.10, row 6); null without. author is '' where none is found.

    Text before the first italics is the author. With none there, a colon after italics that read as a name makes these the author and
    what follows the title; "edited by" or "by" after them, or a name alone, gives the author. Text from second italics on belongs to another review.
    """
    return let(spans(marked), lambda s: let(F.array_position(F.transform(s, lambda x: x["italic"] & (strip(x["text"]) != "")), True).cast("int"), lambda at: F.when(at > 0, of_italics(s, at))))


def of_italics(s: Column, at: Column) -> Column:
    before = F.array_join(F.transform(F.slice(s, 1, at - 1), lambda x: x["text"]), "")
    next_one = F.filter(F.transform(s, lambda x, i: F.when(x["italic"] & (i >= at), i)), lambda i: i.isNotNull())
    upto = F.coalesce(F.try_element_at(next_one, F.lit(1)), F.size(s))
    after = F.array_join(F.transform(F.slice(s, at + 1, upto - at), lambda x: x["text"]), "")
    tidy = lambda c: squeeze(unescape_common(c))
    parts = F.struct(F.rtrim(squeeze(F.regexp_replace(tidy(before), r"(?i),?\s*\(?\beds?\b\.?\)?", "")), F.lit(PLAIN_ENDS)).alias("before"), tidy(before).alias("raw"), bare(F.element_at(s, at)["text"]).alias("title"), tidy(after).alias("after"))
    return let(parts, decided)


def decided(p: Column) -> Column:
    shape = lambda name, title, author, edited: F.struct(F.lit(name).alias("format"), title.alias("title"), author.alias("author"), edited.alias("edited"))
    no, some = F.lit(False), F.ltrim(p["after"], F.lit(".,;: "))
    cut = lambda c: F.rtrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?i),?\s+translated\s+by\b.*$", ""), r"(?i)\.\s*edited\s+by\b.*$", ""), AFTER_NAME, ""), F.lit(PLAIN_ENDS))
    editors = cut(F.regexp_extract(some, r"(?i)\bedited\s+by\s+(.+)$", 1))
    author = cut(F.regexp_extract(some, r"(?i)^by\s+(.+)$", 1))
    alone = F.regexp_replace(cut(some), r"(?i),?\s*\(?\b(?:eds?|editors?)\b\.?\)?$", "")
    title_after = F.rtrim(F.regexp_replace(F.regexp_replace(some, AFTER_NAME, ""), r"(?i),?\s+\d+\s*pp\b.*$", ""), F.lit(PLAIN_ENDS))
    marks_editor = lambda c: c.rlike(r"(?i)\beds?\b|\beditors?\b")
    return (
        F.when((F.length(p["before"]) >= 3) & p["raw"].rlike(r":$"), shape("italic_author_colon_title", p["title"], p["before"], marks_editor(p["raw"])))
        .when(p["before"].rlike(r"\p{L}{2}"), shape("italic_tags", p["title"], F.regexp_replace(p["before"], r"[\s(\[]*\d{4}[)\]]*$", ""), marks_editor(p["raw"])))
        .when(p["after"].startswith(":") & looks_like_name(p["title"]) & (F.length(title_after) > 10), shape("italic_author_colon_title", title_after, p["title"], no))
        .when((author != "") & looks_like_name(author), shape("italic_then_author", p["title"], author, some.rlike(r"\bEdited\b")))
        .when((editors != "") & looks_like_name(editors), shape("italic_then_author", p["title"], editors, F.lit(True)))
        .when(looks_like_name(alone) & alone.rlike(r"^\p{Lu}"), shape("italic_then_author", p["title"], alone, marks_editor(some)))
        .otherwise(shape("italic_title_only", p["title"], F.lit(""), no))
    )


def period_segments(c: Column) -> Column:
    """U8: the text cut after each period that a space follows, but not after initials.

    A period ends no segment if the word it stands behind has one or two letters ("J. H."), or if what follows is one capital with a period.
    Segments keep their period. A period that stands alone belongs to the word before it. (U+0001 is taken for a cut.)
    """
    return let(F.split(F.coalesce(c, F.lit("")), " ", -1), lambda w: F.filter(F.transform(F.split(cut_marks(w), "\u0001", -1), strip), lambda x: x != ""))


def cut_marks(w: Column) -> Column:
    stem = lambda x: F.rtrim(F.regexp_extract(F.substr(x, F.lit(1), F.length(x) - 1), r"(?U)(\S+)\s*$", 1), F.lit("."))
    lone = lambda x: strip(F.substr(x, F.lit(1), F.length(x) - 1)) == ""

    def follows(x: Column, i: Column) -> Column:
        held = F.coalesce(F.try_element_at(F.filter(F.slice(w, 1, i), lambda y: ~strip(y).isin(".", "")), F.lit(-1)), F.lit(""))
        ended = held.endswith(".") & (F.length(stem(held)) > 2)
        inside = F.rtrim(F.regexp_extract(held, r"(?U)(\S+)\s*$", 1), F.lit("."))
        open_segment = (held == "") | ended | (F.length(inside) > 2)
        long_enough = F.when(lone(x), open_segment).otherwise(F.length(stem(x)) > 2)
        nothing_short = ~F.coalesce(F.try_element_at(w, i + 2), F.lit("")).rlike(r"^[A-Z]\.(?:\s|$)")
        return x.endswith(".") & (i + 1 < F.size(w)) & nothing_short & long_enough

    return F.array_join(F.transform(w, lambda x, i: F.concat(x, F.when(follows(x, i), F.lit("\u0001")).when(i + 1 < F.size(w), F.lit(" ")).otherwise(F.lit("")))), "")
