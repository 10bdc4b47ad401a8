"""Column functions for dates, pages, URLs, identifiers and embedded JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Month in which a season's or month's issue counts, by the first key contained.
SEASONS = {"winter": 1, "spring": 3, "summer": 6, "autumn": 9, "fall": 9}
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
]


def _part(parts: Column, k: int) -> Column:
    return F.try_element_at(parts, F.lit(k))


def date_of_parts(parts: Column) -> Column:
    """[y, m, d] as YYYY-MM-DD; missing month or day is 1, no year gives '' (F50)."""
    y = _part(parts, 1)
    return F.when(F.coalesce(y, F.lit(0)) != 0, F.format_string("%04d-%02d-%02d", y, F.coalesce(_part(parts, 2), F.lit(1)), F.coalesce(_part(parts, 3), F.lit(1)))).otherwise("")


def date_of_first(*fields: Column) -> Column:
    """Of the first field that has parts; fewer than three parts give the year alone."""
    parts = F.coalesce(*(F.when(F.size(f) > 0, f) for f in fields))
    return F.when(parts.isNull(), "").when(F.size(parts) >= 3, date_of_parts(parts)).otherwise(_part(parts, 1).cast("string"))


def date_of_timestamp(stamp: Column, edition: Column) -> Column:
    """ISO timestamp, else an edition `YYYY.M.D` with plausible parts."""
    e = [F.regexp_extract(edition, r"(\d{4})\.(\d{1,2})\.(\d{1,2})", k).try_cast("int") for k in (1, 2, 3)]
    plausible = e[0].between(1900, 2100) & e[1].between(1, 12) & e[2].between(1, 31)
    return F.coalesce(F.date_format(F.try_to_timestamp(stamp), "yyyy-MM-dd"), F.when(plausible, F.format_string("%04d-%02d-%02d", *e)), F.lit(""))


def date_of_season(slug: Column) -> Column:
    """`2025-fall` as 2025-09-01."""
    month = F.element_at(F.create_map(*(F.lit(x) for kv in SEASONS.items() for x in kv)), F.lower(F.regexp_extract(slug, r"^\d{4}-([A-Za-z]+)", 1)))
    return F.when(month.isNotNull(), F.format_string("%s-%02d-01", F.regexp_extract(slug, r"^(\d{4})", 1), month)).otherwise("")


def date_of_issue(issue: Column) -> Column:
    """`RP 2.20 (Winter 2026)`: the first season or month that is named, with the year."""
    low, year = F.lower(issue), F.regexp_extract(issue, r"\b((?:19|20)\d{2})\b", 1)
    month = F.coalesce(*(F.when(low.contains(k), F.lit(m)) for k, m in [*SEASONS.items(), *((name, i + 1) for i, name in enumerate(MONTHS)), *((name[:3], i + 1) for i, name in enumerate(MONTHS))]))
    return F.when(year == "", "").when(month.isNull(), F.concat(year, F.lit("-01-01"))).otherwise(F.format_string("%s-%02d-01", year, month))


def date_in_snippet(c: Column) -> Column:
    """A date that begins a snippet, as `Jan 15, 2024` or `15 Jan 2024`."""
    m = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    a = F.concat_ws(" ", *(F.regexp_extract(c, rf"^{m}\s+(\d{{1,2}}),?\s+(\d{{4}})", k) for k in (1, 2, 3)))
    b = F.concat_ws(" ", *(F.regexp_extract(c, rf"^(\d{{1,2}})\s+{m}\s+(\d{{4}})", k) for k in (2, 1, 3)))
    return F.coalesce(F.date_format(F.coalesce(F.try_to_date(a, "MMM d yyyy"), F.try_to_date(b, "MMM d yyyy")), "yyyy-MM-dd"), F.lit(""))


def lookback_start(last_run: Column, overlap_days: int = 2, first_days: int = 14) -> Column:
    """F56"""
    return F.coalesce(F.date_sub(last_run, overlap_days), F.date_sub(F.current_date(), first_days))


def normalize_url(c: Column) -> Column:
    """https, no www., query, fragment or trailing slash."""
    c = F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"^https?://(?:www\.)?", "https://")
    return F.regexp_replace(c, "/+$", "")


def domain(c: Column) -> Column:
    """F58"""
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def clean_doi(c: Column) -> Column:
    """F59"""
    return F.regexp_extract(c, r"(10\.\d{4,9}/[^\s\"<>]+?)[.,;)]*(?:\s|$)", 1)


def doi_url(c: Column) -> Column:
    return F.when(c != "", F.concat(F.lit("https://doi.org/"), c)).otherwise("")


def page_start(c: Column) -> Column:
    """null if it is no number."""
    return F.trim(F.split_part(c, F.lit("-"), F.lit(1))).try_cast("int")


def page_end(c: Column) -> Column:
    return F.coalesce(F.when(c.contains("-"), F.trim(F.split_part(c, F.lit("-"), F.lit(2))).try_cast("int")), page_start(c))


def year_of(c: Column) -> Column:
    """P37"""
    return F.when(F.length(c) >= 4, F.substring(c, 1, 4).try_cast("int"))


def issue_key(*parts: Column) -> Column:
    """F61"""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def is_review_url(c: Column) -> Column:
    """P19"""
    path = F.regexp_replace(F.coalesce(c, F.lit("")), "/+$", "")
    slug = F.element_at(F.split(path, "/"), -1)
    return path.contains("/reviews/") & ~path.contains("/archives/") & (F.length(slug) >= 3) & ~slug.isin("admin", "login", "search", "contact", "about", "rss", "feed")


def is_other_page(c: Column) -> Column:
    """P20: pages of authors, topics and the like."""
    path = F.lower(F.regexp_replace(F.regexp_replace(c, r"^[a-z]+://[^/?#]*", ""), r"[?#].*$", ""))
    return path.rlike("/(?:authors|contributors?|author|topics|tags|category|series|obituaries|obituary)/|/highereducation")


def is_obituary(title: Column, url: Column) -> Column:
    """P20: an obituary's words, or a span of life that began from 1920 to 1950."""
    both = F.lower(F.concat_ws(" ", title, url))
    return both.rlike(r"obituar(?:y|ies)|dies at|died|19(?:[234]\d|50)-")


def search_text(title: Column, last: Column, limit: int = 400) -> Column:
    """F65"""
    return F.substring(F.concat_ws(" ", F.concat(F.lit('"'), title, F.lit('"')), last, F.lit("review")), 1, limit)


def classifier_prompt(title: Column, summary: Column, source: Column) -> Column:
    """F66"""
    field = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", field("Title", title), field("Abstract", F.substring(summary, 1, 200)), field("Journal", source))


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object in a text, strings respected."""
    if not text or "{" not in text:
        return None
    start, depth, quoted, escaped = text.index("{"), 0, False, False
    for i in range(start, len(text)):
        ch = text[i]
        if quoted:
            escaped, quoted = (ch == "\\" and not escaped), not (ch == '"' and not escaped)
        elif ch == '"':
            quoted = True
        elif ch in "{}":
            depth += 1 if ch == "{" else -1
            if not depth:
                return text[start : i + 1]
    return None


@F.pandas_udf(T.StringType())
def balanced_json(text: pd.Series) -> pd.Series:
    return text.map(first_object)


def author_of_linked_data(text: str | None) -> str | None:
    """The author's name in JSON-LD: a string, an object, a list, or inside @graph."""

    def look(x: object) -> str | None:
        if isinstance(x, list):
            return next((n for e in x if (n := look(e))), None)
        if isinstance(x, dict):
            a = x.get("author")
            for e in a if isinstance(a, list) else [a]:
                if isinstance(e, str) and e:
                    return e
                if isinstance(e, dict) and e.get("name"):
                    return str(e["name"])
            return look(x.get("@graph"))
        return None

    try:
        return look(json.loads(text)) if text else None
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def linked_data_author(text: pd.Series) -> pd.Series:
    return text.map(author_of_linked_data)


def article_id(url: Column) -> Column:
    """F64"""
    return F.regexp_extract(url, r"/article/(?:view/)?(\d+)", 1)
