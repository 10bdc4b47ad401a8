"""Citations as queries: every format of a title, italics, list items and cut sentences, over part names.

A query's rows are the parts; each is set into one of the cases, `{}` being its name in capitals. What must come out is written
beside each case by hand, and the SQL is that table: it knows nothing of patterns or their order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.spans import italic_citation, list_item, period_segments
from quire.functions.text import let
from quire.operators.parse import parse_title, trace_title
from quire.queries import register, table
from quire.storage import spread

NAMED = "(SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM part)"


def quoted(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def expected(rows: list[tuple], columns: str) -> str:
    """SQL for the rows of each part's case; `{}` becomes the name. rows begin with the case's number."""
    texts = [c.strip() for c in columns.split(",")]
    filled = ", ".join(f"replace({c}, '{{}}', name) AS {c}" if any(isinstance(r[k + 1], str) for r in rows) else c for k, c in enumerate(texts))
    cases = max(r[0] for r in rows) + 1
    return f"SELECT p_partkey, {filled} FROM {NAMED} JOIN (VALUES {', '.join('(' + ', '.join(quoted(x) for x in r) + ')' for r in rows)}) AS t(k, {columns}) ON p_partkey % {cases} = k"


def parts_as(spark, sf_dir, *cases: list[str]):
    """p_partkey and, for each list of cases, the part's case with its name in it."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"))
    chosen = lambda texts: F.replace(F.element_at(F.array(*(F.lit(t) for t in texts)), (F.col("p_partkey") % len(texts) + 1).cast("int")), F.lit("{}"), F.initcap("p_name"))
    return p.select("p_partkey", *(chosen(texts).alias(f"c{k}") for k, texts in enumerate(cases)))


#: (title, subtitle, format, book title, first, last, edited, several)
CITED = [
    ("Minds at work", "Ann Lee: {} and Mind. Oxford: OUP, 2001", "SUB-A", "{} and Mind", "Ann", "Lee", False, False),
    ("Minds at work", "{} and Mind, Ann Lee, Oxford University Press, 2001", "SUB-B", "Minds at work", "Ann", "Lee", False, False),
    ("Book Review: {} and Mind. Thomas Nagel", "", "book_review_colon", "{} and Mind", "Thomas", "Nagel", False, False),
    ("Review of {}, by Jane Q. Doe", "", "review_of_by", "{}", "Jane Q.", "Doe", False, False),
    ("<i>{} and Mind</i>. Philip J. Ivanhoe", "", "italic_then_author", "{} and Mind", "Philip J.", "Ivanhoe", False, False),
    ("Ann Lee: <i>{}</i>", "", "italic_author_colon_title", "{}", "Ann", "Lee", False, False),
    ("Ann Lee (ed.), <b>{}</b>", "", "italic_tags", "{}", "Ann", "Lee", True, False),
    ("<em>{} and Mind</em>", "", "italic_title_only", "{} and Mind", "", "", False, False),
    ("Book Review: {} and Mind", "", "book_review_colon_title_only", "{} and Mind", "", "", False, False),
    ("Review of {} and Mind", "", "review_of_title_only", "{} and Mind", "", "", False, False),
    ("{} and Mind, written by Ann Lee", "", "written_by", "{} and Mind", "Ann", "Lee", False, False),
    ("{} and Mind Edited by Ann Lee Oxford University Press", "", "edited_by_house", "{} and Mind", "Ann", "Lee", True, False),
    ("{} and Mind, edited by Ann Lee", "", "edited_by", "{} and Mind", "Ann", "Lee", True, False),
    ("{} and Mind. By Ann Lee. (Oxford University Press)", "", "dot_by_parenthesis", "{} and Mind", "Ann", "Lee", False, False),
    ("{} and Mind. By Ann Lee", "", "dot_by", "{} and Mind", "Ann", "Lee", False, False),
    ("{} et Esprit. Par Anne Lee", "", "par", "{} et Esprit", "Anne", "Lee", False, False),
    ("{} and the Mind, Ann Lee. Oxford University Press", "", "title_author_house", "{} and the Mind", "Ann", "Lee", False, False),
    ("{} and Mind by Ann Lee (review)", "", "by_review", "{} and Mind", "Ann", "Lee", False, False),
    ("{} and Mind (review)", "", "title_review", "{} and Mind", "", "", False, False),
    ("{} and Mind, by Ann Lee", "", "comma_by", "{} and Mind", "Ann", "Lee", False, False),
    ("Review: Ann Lee: {} and Mind", "", "review_author_title", "{} and Mind", "Ann", "Lee", False, False),
    ("Ann Lee's {} and Mind", "", "possessive", "{} and Mind", "Ann", "Lee", False, False),
    ('Ann Lee, "{} and Mind"', "", "author_quoted", "{} and Mind", "Ann", "Lee", False, False),
    ("Ann Lee and Bo Ek, eds. {} and Mind", "", "author_eds_title", "{} and Mind", "Ann", "Lee", True, True),
    ("Ann Lee, {} and the Mind", "", "author_comma_title", "{} and the Mind", "Ann", "Lee", False, False),
    ("Lee. {} and Mind", "", "author_dot_title", "{} and Mind", "", "Lee", False, False),
    ("Ann Lee: {} and Mind", "", "author_colon_title", "{} and Mind", "Ann", "Lee", False, False),
    ("{} and the Mind by Ann Lee, Ed.", "", "title_by_editors", "{} and the Mind", "Ann", "Lee", False, False),
    ("{} and the Mind by Ann Lee", "", "title_by_author", "{} and the Mind", "Ann", "Lee", False, False),
    ("{} and Mind - Ann Lee", "", "title_dash_author", "{} and Mind", "Ann", "Lee", False, False),
    ("{} and Mind – Ann Lee and Bo Ek", "", "title_dash_author", "{} and Mind", "Ann", "Lee", False, True),
    ("Lee, A. Mind 2", "", "last_first_title", "Mind 2", "A", "Lee", False, False),
    ("Book Reviews", "", "generic", "", "", "", False, False),
    ("the {} and its limits", "", None, None, None, None, None, None),
    # what two formats fit is the first one's
    ("Ann Lee's {} and Mind - Bo Ek", "", "possessive", "{} and Mind - Bo Ek", "Ann", "Lee", False, False),
    ("Ann Lee, <i>{}</i>, by Bo Ek", "", "italic_tags", "{}", "Ann", "Lee", False, False),
    ("{} and Mind. By Ann Lee (Oxford): Ethics", "", "dot_by_parenthesis", "{} and Mind", "Ann", "Lee", False, False),
    ("{} and Mind. By Ann Lee, by Bo Ek", "", "dot_by", "{} and Mind", "Ann", "Lee", False, False),
]


@register("title_formats", expected([(k, *c[2:]) for k, c in enumerate(CITED)], "format, book_title, first, last, edited, several"))
def title_formats(spark, sf_dir):
    """U1, survey 2.10: one title of each format, and titles that two formats fit"""
    p = parts_as(spark, sf_dir, [c[0] for c in CITED], [c[1] for c in CITED]).select("p_partkey", parse_title(F.col("c0"), F.col("c1")).alias("p"))
    return p.select("p_partkey", "p.format", "p.book_title", "p.first", "p.last", F.col("p.is_edited").alias("edited"), F.col("p.has_multiple").alias("several"))


#: (title, the formats that fit but do not hold up, and why, the format that holds up)
TRACED = [
    ("{} and the Mind by Ann Lee", "", "title_by_author"),
    ("Against the Theory: {} and Mind", "author_colon_title no name", None),
    ("<i>abc</i>, Ann Lee", "italics short title", None),
    ("Nature of Justice, {} and the Mind", "author_comma_title no name", None),
    ("Book Review: {} and Mind. Toward a Theory", "book_review_colon no name", "book_review_colon_title_only"),
]


@register("title_traces", expected([(k, *c[1:]) for k, c in enumerate(TRACED)], "failed, holds"))
def title_traces(spark, sf_dir):
    """Survey 2.10: why formats that fit were passed over, in their order, and the one that holds up"""
    p = parts_as(spark, sf_dir, [c[0] for c in TRACED]).select("p_partkey", trace_title(F.col("c0")).alias("v"))
    failed = F.filter("v", lambda x: ~x["verdict"].isin("no match", "fits"))
    last = F.element_at("v", -1)
    return p.select("p_partkey", F.array_join(F.transform(failed, lambda x: F.concat_ws(" ", x["format"], x["verdict"])), "; ").alias("failed"), F.when(last["verdict"] == "fits", last["format"]).alias("holds"))


#: (item, its reviews: (book, author, reviewer, venue, link))
LISTED = [
    ('<em>{} and Mind</em> by Ann Lee is reviewed by Bo Ek at <a href="http://v/1"><em>Mind</em></a>, and by Cy Dee at <a href="http://w/2"><em>Ethics</em></a>.', [("{} and Mind", "Ann Lee", "Bo Ek", "Mind", "http://v/1"), ("{} and Mind", "Ann Lee", "Cy Dee", "Ethics", "http://w/2")]),
    ('<a href="https://www.amazon.com/x"><em>{} One</em></a> by A. Lee and <em>{} Two</em> by B. Fox are reviewed by Cy Dee at <a href="http://v/3"><em>TLS</em></a>.', [("{} One", "A. Lee", "Cy Dee", "TLS", "http://v/3"), ("{} Two", "B. Fox", "Cy Dee", "TLS", "http://v/3")]),
    ('Cy Dee reviews <a href="http://v/4"><em><strong>{} Again</strong></em></a> by Ann Lee, at <em>The Times</em>.', [("{} Again", "Ann Lee", "Cy Dee", "The Times", "http://v/4")]),
    ("<em>{} and Mind</em> by Ann Lee is reviewed by Bo Ek at <em>Mind</em>.", [("{} and Mind", "Ann Lee", "Bo Ek", "Mind", "")]),
    ('<em>{} and Mind</em>, edited by Ann Lee, is reviewed by Bo Ek at <a href="http://v/5"><em>Mind</em></a> and in <a href="http://v/6"><em>Noûs</em></a>', [("{} and Mind", "Ann Lee", "Bo Ek", "Mind", "http://v/5"), ("{} and Mind", "Ann Lee", "Bo Ek", "Noûs", "http://v/6")]),
    ("A list without marks, {}", []),
]


@register("list_items", f"SELECT * FROM ({expected([(k, *r) for k, c in enumerate(LISTED) for r in c[1] or [(None,) * 5]], 'book_title, author, reviewer, venue, review_link')}) WHERE book_title IS NOT NULL")
def list_items(spark, sf_dir):
    """Books and venues of list items by their spans, each venue with its own link"""
    p = parts_as(spark, sf_dir, [c[0] for c in LISTED])
    return p.select("p_partkey", F.explode(list_item(F.col("c0"))).alias("e")).select("p_partkey", "e.*")


#: (marked title, format, title, author, edited)
ITALICS = [
    ("Ann Lee, <i>{}</i>", "italic_tags", "{}", "Ann Lee", False),
    ("<i>Ann Lee</i>: {} and Machines. Cambridge 2001", "italic_author_colon_title", "{} and Machines", "Ann Lee", False),
    ("<i>{}</i>, by Ann Lee. New York: Holt, 1990", "italic_then_author", "{}", "Ann Lee", False),
    ("<i>{}</i>, edited by Ann Lee and Bo Ek, 2001", "italic_then_author", "{}", "Ann Lee and Bo Ek", True),
    ("<i>{}</i>, by Ann Lee. Edited by Bo Ek", "italic_then_author", "{}", "Ann Lee", True),
    ("<i>{}</i> by Ann Lee <i>Another</i> by Bo Ek", "italic_then_author", "{}", "Ann Lee", False),
    ("<i>{}</i>. Philip J. Ivanhoe. Oxford", "italic_then_author", "{}", "Philip J. Ivanhoe", False),
    ("<i>{}</i> and what they do to us", "italic_title_only", "{}", "", False),
    ("{} without italics", None, None, None, None),
]


@register("italic_citations", expected([(k, *c[1:]) for k, c in enumerate(ITALICS)], "format, title, author, edited"))
def italic_citations(spark, sf_dir):
    """Survey 2.10, row 6: the spans beside italics"""
    return parts_as(spark, sf_dir, [c[0] for c in ITALICS]).select("p_partkey", italic_citation(F.col("c0")).alias("c")).select("p_partkey", "c.*")


SENTENCES = ["J. H. {}. On Mind. Oxford. 1990.", "{}. A. Lee. Vol. 3. of. {}", "{}", "Ends. ", ". {} . . Cd", "etc.. {}. B.", "Mind.  {}. X.", "ab . {} . Y. Z"]


@register(
    "period_segments",
    f"""WITH RECURSIVE c AS (SELECT p_partkey, replace(([{", ".join(quoted(s) for s in SENTENCES)}])[(p_partkey % {len(SENTENCES)} + 1)::INT], '{{}}', name) AS t FROM {NAMED}),
    r AS (SELECT p_partkey, t, 1 AS i, '' AS now, []::VARCHAR[] AS out FROM c UNION ALL
      SELECT p_partkey, t, i + CASE WHEN cut THEN 2 ELSE 1 END, CASE WHEN cut THEN '' ELSE now || t[i] END, CASE WHEN cut THEN list_append(out, trim(now || '.')) ELSE out END FROM (
        SELECT *, t[i:i + 1] = '. ' AND NOT (trim(now) <> '' AND length(rtrim(string_split(trim(now), ' ')[-1], '.')) <= 2) AND NOT regexp_matches(t[i + 2:i + 4], '^[A-Z]\\.(\\s|$)') AS cut FROM r WHERE i <= length(t)))
    SELECT p_partkey, unnest(list_concat(out, CASE WHEN trim(now) <> '' THEN [trim(now)] ELSE []::VARCHAR[] END)) AS segment, generate_subscripts(list_concat(out, CASE WHEN trim(now) <> '' THEN [trim(now)] ELSE []::VARCHAR[] END), 1) - 1 AS pos FROM r WHERE i > length(t)""",
)
def segments(spark, sf_dir):
    """U8: sentences cut at periods that end no initials, against a walk over characters"""
    return parts_as(spark, sf_dir, SENTENCES).select("p_partkey", F.posexplode(let(F.col("c0"), period_segments)).alias("pos", "segment")).select("p_partkey", "segment", F.col("pos").cast("long").alias("pos"))
