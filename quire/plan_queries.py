"""Plans and the functions that only plans use, as queries: name repairs, titles, re-verification, ingest, look-ups, chains of inserts.

Where cases are set into part names, what must come out is written beside them by hand, as in citation_queries; the others have SQL
over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from quire.citation_queries import expected, parts_as
from quire.functions import dates_urls, text
from quire.operators import browse, matching, upsert
from quire.plans import cleanup, ingest
from quire.queries import CUSTOMERS, SIMILARITY, customer_catalog, register, table
from quire.schema import WORK_ITEM, conform


@register("chained_insert", """WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS seq, o_custkey % 89 = 0 AS no_doi, o_custkey % 97 = 0 AS no_link FROM orders),
    e AS (SELECT *, CASE WHEN seq % 2 = 1 THEN no_doi OR lag(no_doi, 1, true) OVER w ELSE no_link OR lag(no_link, 1, true) OVER w END AS begins FROM o WINDOW w AS (ORDER BY seq)),
    i AS (SELECT seq, sum(begins::INT) OVER (ORDER BY seq) AS island FROM e)
    SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY island ORDER BY seq) AS place FROM i) WHERE place % 2 = 1""")
def chained_insert(spark, sf_dir):
    """SK2: each row has a key of the row before it and one of the row after it, but for breaks; every second one of a chain is kept"""
    o = upsert.number_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey")).withColumn("seq", F.col("n") - 1)
    doi, link = (F.when(F.col("o_custkey") % k == 0, "").otherwise(F.concat(F.lit(sign), F.floor((F.col("seq") + add) / 2).cast("string"))) for k, sign, add in ((89, "d", 0), (97, "u", 1)))
    return upsert.settle_batch(o.select("seq", doi.alias("doi"), link.alias("review_link"))).select("seq")


LONG = "A Surname of many words that goes on for ever without any end"
#: (first, last, reviewer's last; what they become)
PERSONS = [
    ("Ann", "Lee (ed.)", "Roe", "Ann", "Lee", "Roe"),
    ("", "Ann Lee and Bo Ek", "Roe", "", "Ann Lee", "Roe"),
    ("", "Ann Lee (Eds)", "R", "", "Ann Lee", None),
    ("", "Routledge", "Roe", None, None, "Roe"),
    ("Cambridge:", "Cambridge University Press", "Roe", None, None, "Roe"),
    ("Ann", LONG, LONG, "Ann", None, None),
    ("Ann", "Lee 1990 and 250 leaves", "Roe and 250 leaves in 8vo", "Ann", "Lee 1990", None),
    ("Ann", "L", "R.", "Ann", None, "R."),
    ("Smith", "J.", "Roe", "J.", "Smith", "Roe"),
    ("Smith, Ann", "J.", "Roe", "Ann J.", "Smith", "Roe"),
    ("Smith", "Jr.", "Roe", "Smith", "Jr.", "Roe"),
    ("AnnLee", "(ed.)", "Roe", "Ann", "Lee", "Roe"),
    ("Ann Lee", "(ed.)", "Roe", "Ann", "Lee", "Roe"),
    ("Ann", "Lee", "Roe", "Ann", "Lee", "Roe"),
]


@register("repaired_persons", expected([(k, *c[3:]) for k, c in enumerate(PERSONS)], "first, last, reviewer"))
def repaired_persons(spark, sf_dir):
    """editors' marks, publishers, long and one-letter names, swapped names, by the phases in their order"""
    p = parts_as(spark, sf_dir, *([c[k] for c in PERSONS] for k in range(3)))
    key = F.col("p_partkey")
    rows = conform(p.select(key.alias("id"), F.concat(F.lit("On "), key.cast("string")).alias("book_title"), F.lit("J").alias("publication_source"), F.col("c0").alias("book_author_first_name"), F.col("c1").alias("book_author_last_name"), F.lit("Cy").alias("reviewer_first_name"), F.col("c2").alias("reviewer_last_name")))
    done = cleanup.run(rows, "editor_marks", "name_swaps")
    return done.select(F.col("id").alias("p_partkey"), F.col("book_author_first_name").alias("first"), F.col("book_author_last_name").alias("last"), F.col("reviewer_last_name").alias("reviewer"))


REST = " and the Mind: a longer account of what it may be and of what others said of it in many a year and many a place before this one was written by anyone"
#: (title, author's last name, entry type; the title, None if the row goes)
TITLED = [
    ("THE STRUCTURE OF THINGS", "Lee", "review", "The Structure of Things"),
    ("THE NATO READER: A HISTORY OF THE ALLIANCE IN THE EU", "Lee", "review", "The NATO Reader: A History of the Alliance in the EU"),
    (", {} and Mind", "Lee", "review", "{} and Mind"),
    ("...{} and Mind", "Lee", "review", "...{} and Mind"),
    ("On <i>{}</i> and the 4<sup>th</sup> Day", "Lee", "review", "On {} and the 4th Day"),
    ("{}" + REST + ". London: Holt, 1990. Pp. 300. $25.00.", "Lee", "review", "{}" + REST),
    ("{}" + REST + " and still more of the same", "Lee", "review", "{}" + REST + " and still more of the same"),
    ("{} and Mind. London: Holt, 1990", "Lee", "review", "{} and Mind. London: Holt, 1990"),
    ("{} by its Author", "Roe", "review", None),
    ("{} by its Author", "Roe", "symposium", "{} by its Author"),
    ("{} by another Roe", "roe", "review", "{} by another Roe"),
    ("{} by nobody", "", "review", "{} by nobody"),
]


@register("repaired_titles", f"SELECT * FROM ({expected([(k, c[3]) for k, c in enumerate(TITLED)], 'title')}) WHERE title IS NOT NULL")
def repaired_titles(spark, sf_dir):
    """Capitals, leading signs, tags, citations in long titles, rows whose author is the reviewer"""
    p = parts_as(spark, sf_dir, *([c[k] for c in TITLED] for k in range(3)))
    rows = conform(p.select(F.col("p_partkey").alias("id"), F.col("c0").alias("book_title"), F.lit("Cy").alias("book_author_first_name"), F.col("c1").alias("book_author_last_name"), F.lit("Cy").alias("reviewer_first_name"), F.lit("Roe").alias("reviewer_last_name"), F.col("c2").alias("entry_type")))
    return cleanup.run(rows, "capitals", "self_reviews").select(F.col("id").alias("p_partkey"), F.col("book_title").alias("title"))


#: (author in the catalog, landed title, landed type; action, title, first, last that the landed title tells)
LANDED = [
    ("", "{} and Mind by Ann Lee", "journal-article", "reparse", "{} and Mind", "Ann", "Lee"),
    ("Lee", "Book Review: {} and Mind. Ann Lee", "journal-article", "keep", "{} and Mind", "Ann", "Lee"),
    ("Lee", "the {} and its limits", "book-review", "keep", None, None, None),
    ("Lee", "the {} and its limits", "journal-article", "delete", None, None, None),
    ("University Press", "{} and Mind by Ann Lee", "journal-article", "reparse", "{} and Mind", "Ann", "Lee"),
]


@register("reverified_rows", expected([(k, *c[3:]) for k, c in enumerate(LANDED)], "action, book_title, first, last"))
def reverified_rows(spark, sf_dir):
    """Rows looked up again by DOI are kept, parsed anew or deleted"""
    p = parts_as(spark, sf_dir, *([c[k] for c in LANDED] for k in range(3)))
    doi = F.concat(F.lit("10.1000/"), F.col("p_partkey").cast("string"))
    rows = conform(p.select(F.col("p_partkey").alias("id"), doi.alias("doi"), F.lit("Old").alias("book_title"), F.col("c0").alias("book_author_last_name")))
    items = conform(p.select(doi.alias("DOI"), F.array("c1").alias("title"), F.col("c2").alias("type")), WORK_ITEM)
    return cleanup.reverified(rows, items).select(F.col("id").alias("p_partkey"), "action", "book_title", "first", "last")


#: (landed title; title, first, last of the catalog's row, None if it is no review)
ITEMS = [
    ("Book Review: Ann Lee, <i>{} and Mind</i>", "{} and Mind", "Ann", "Lee"),
    ("On the growth of {}", None, None, None),
    ("Editorial", None, None, None),
]
INGESTED = expected([(k, *c[1:]) for k, c in enumerate(ITEMS)], "title, first, last")


@register("ingested_items", f"""WITH e AS ({INGESTED}), r AS (SELECT * FROM e WHERE title IS NOT NULL AND p_partkey % 4 <> 0)
    SELECT '10.1000/' || p_partkey AS doi, title, first, last, 'Cy' AS reviewer, '2001-0' || (1 + p_partkey % 9) || '-01' AS date, CASE WHEN p_partkey % 2 = 0 THEN 'Open' ELSE 'Restricted' END AS access, 'review' AS type, CASE WHEN p_partkey % 5 = 0 THEN 'mind' END AS subfield FROM r
    UNION ALL SELECT '10.1000/' || p_partkey, 'Old', NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN p_partkey % 5 = 0 THEN 'mind' END FROM part WHERE p_partkey % 4 = 0""")
def ingested_items(spark, sf_dir):
    """Landed items to the catalog's next snapshot; known DOIs stay as they are, journals give subfields"""
    key = F.col("p_partkey")
    doi, journal = F.concat(F.lit("10.1000/"), key.cast("string")), F.concat(F.lit("Journal "), (key % 5).cast("string"))
    p = parts_as(spark, sf_dir, [c[0] for c in ITEMS])
    items = p.select(
        F.array("c0").alias("title"), doi.alias("DOI"), F.array(journal).alias("container-title"), F.array(F.struct(F.lit("Cy").alias("given"), F.lit("Roe").alias("family"))).alias("author"),
        F.struct(F.array(F.array(F.lit(2001), (key % 9 + 1).cast("int"))).alias("date-parts")).alias("issued"), F.when(key % 2 == 0, F.array(F.struct(F.lit("https://l").alias("URL")))).alias("license"),
        key.cast("string").alias("volume"), F.lit("1").alias("issue"), F.lit("1-2").alias("page"),
    )
    known = conform(table(spark, sf_dir, "part").where(key % 4 == 0).select(key.alias("id"), doi.alias("doi"), journal.alias("publication_source"), F.lit("Old").alias("book_title")))
    journals = spark.createDataFrame([("Journal 0", "mind", ""), ("Journal 7", "ethics", "")], "publication_source string, primary string, secondary string")
    out = ingest.ingest(known, conform(items, WORK_ITEM), journals=journals)
    return out.select("doi", F.col("book_title").alias("title"), F.col("book_author_first_name").alias("first"), F.col("book_author_last_name").alias("last"), F.col("reviewer_first_name").alias("reviewer"), F.col("publication_date").alias("date"), F.col("access_type").alias("access"), F.col("entry_type").alias("type"), F.when(journal_is("Journal 0"), F.col("subfield_primary")).alias("subfield"))


def journal_is(name: str):
    return F.col("publication_source") == name


@register("best_books", SIMILARITY + """, w AS (SELECT *, 2000 + length(a) % 9 AS y1, CASE WHEN length(b) % 7 <> 0 THEN 2000 - length(b) % 13 + 4 END AS y2 FROM s WHERE score >= 0.5 AND a IN (SELECT p_name FROM part) AND b IN (SELECT p_name || 's' FROM part)),
    g AS (SELECT a, b, CASE WHEN starts_with(b, a) OR starts_with(a, b) THEN 7 ELSE 5 END + CASE WHEN y2 IS NULL THEN 0 WHEN y1 - y2 BETWEEN 0 AND 2 THEN 5 WHEN y1 - y2 BETWEEN 3 AND 5 THEN 3 WHEN y1 - y2 BETWEEN 6 AND 10 THEN 1 ELSE -2 END AS score FROM w)
    SELECT a, b, score, 'Jane' AS first FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn FROM g WHERE score >= 5) WHERE rn = 1""")
def best_books(spark, sf_dir):
    """The best book of each title by whole scores of title and year"""
    name, part = F.col("p_name"), table(spark, sf_dir, "part")
    n = F.length("record")
    records = part.select(name.alias("record")).distinct().select("record", F.col("record").alias("title"), (n % 9 + 2000).alias("year"))
    m = F.length("work")
    books = part.select(F.concat(name, F.lit("s")).alias("work")).distinct().select("work", F.col("work").alias("title"), F.when(m % 7 != 0, 2004 - m % 13).alias("year"), F.lit(0).alias("rank"), F.lit("Jane Doe").alias("author"))
    return matching.best_book(records, books).select(F.col("record").alias("a"), F.col("work").alias("b"), "score", F.col("name.first").alias("first"))


@register("title_mentions", r"""SELECT doc_id FROM (SELECT doc_id, lower(regexp_replace(text, '<[^>]+>', '', 'g')) AS t FROM documents) WHERE regexp_matches(t, 'reply|replies|response to|symposium') OR contains(t, 'river and') OR contains(t, 'stone')""")
def title_mentions(spark, sf_dir):
    """Texts that name a book, its author's surname or a symposium, over whole texts"""
    return matching.title_mentions(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("title")), "River, and!", "Stone").select("doc_id")


@register("lookback_days", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN current_date - 14 ELSE o_orderdate::DATE - 2 END AS start FROM orders")
def lookback_days(spark, sf_dir):
    """two days before the last run, and fourteen days back where there was none"""
    return table(spark, sf_dir, "orders").select("o_orderkey", dates_urls.lookback_start(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("date"))).alias("start"))


@register("partial_updates", f"WITH {CUSTOMERS} SELECT id, CASE WHEN id % 4 = 0 THEN 'New ' || id ELSE title END AS title, CASE WHEN id % 6 = 0 THEN 'A' || (id % 5) ELSE c_mktsegment END AS last FROM cat JOIN customer ON id = c_custkey")
def partial_updates(spark, sf_dir):
    """SK4: titles alone, authors alone, or both by id; blank values change nothing"""
    i = F.col("id")
    changed = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).select("id", F.when(i % 4 == 0, F.concat(F.lit("New "), i.cast("string"))).otherwise("").alias("book_title"), F.when(i % 6 == 0, F.concat(F.lit("A"), (i % 5).cast("string"))).alias("book_author_last_name"))
    return upsert.update_by_key(customer_catalog(spark, sf_dir), changed, "id", ("book_title", "book_author_last_name")).select("id", F.col("book_title").alias("title"), F.col("book_author_last_name").alias("last"))


#: (text; as a name, as a logic journal's title, with plain quotes and dashes)
REFERENCES = [
    ("Lee &amp; {}, ", "Lee & {}", "Lee & {},", "Lee &amp; {},"),
    ("<i>{}</i>&nbsp;&mdash; on logic...", "<i>{}</i> — on logic", "{} — on logic", "<i>{}</i>&nbsp;&mdash; on logic..."),
    ("M&uuml;ller. ", "Müller", "Müller", "M&uuml;ller."),
    ("‘{}’ –  “mind”", "‘{}’ –  “mind”", "‘{}’ – “mind”", "'{}' - \"mind\""),
    ("{} a‐b", "{} a‐b", "{} a‐b", "{} a‐b"),
]


@register("references_in_text", expected([(k, *c[1:]) for k, c in enumerate(REFERENCES)], "as_name, logic, plain"))
def references_in_text(spark, sf_dir):
    """Character references, and signs of several kinds"""
    c = F.col("c0")
    return parts_as(spark, sf_dir, [x[0] for x in REFERENCES]).select("p_partkey", text.unescape_name(c).alias("as_name"), text.clean_logic_title(c).alias("logic"), text.clean_text(c).alias("plain"))


@register("symposium_members", f"WITH {CUSTOMERS} SELECT symposium_group, id, count(*) OVER (PARTITION BY symposium_group) AS size FROM cat WHERE symposium_group <> ''")
def symposium_members(spark, sf_dir):
    """J11 for all rows at once: each row with its group and the group's size, so that nothing grows with the square of a group"""
    return browse.members(browse.serving_view(customer_catalog(spark, sf_dir)))


@register("peers_of_rows", f"WITH {CUSTOMERS} SELECT a.id, b.id AS peer FROM cat a JOIN cat b ON a.symposium_group = b.symposium_group AND a.id <> b.id WHERE a.symposium_group <> '' AND a.id % 50 = 0")
def peers_of_rows(spark, sf_dir):
    """The peers of every row whose id is divisible by 50, among all rows"""
    return browse.peers(browse.serving_view(customer_catalog(spark, sf_dir)), asked=F.col("id") % 50 == 0)


@register("run_counts", f"WITH {CUSTOMERS} SELECT count(*) AS rows, count(*) FILTER (id % 3 <> 0) AS with_title, count(*) FILTER (id % 5 = 0) AS with_author FROM cat")
def run_counts(spark, sf_dir):
    """Counts that a run takes while it writes, without a pass of its own"""
    seen, i = Observation("run"), F.col("id")
    rows = customer_catalog(spark, sf_dir).withColumns({"book_title": F.when(i % 3 != 0, F.col("book_title")), "book_author_last_name": F.when(i % 5 == 0, F.col("book_author_last_name"))})
    ingest.observed(rows, seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(seen.get[k] for k in ("rows", "with_title", "with_author"))], "rows long, with_title long, with_author long")
