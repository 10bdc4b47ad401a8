"""Further operators over whole tables as queries: writing, matching, symposia, classifying, landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.case_queries import case_of, sql_case
from quire.functions.dates_urls import balanced_json
from quire.operators import browse, classify, matching, symposia, upsert
from quire.plans import cleanup
from quire.queries import CUSTOMERS, customer_catalog, register, table
from quire.schema import conform
from quire.sources import landed
from quire.storage import spread

FILTERS = browse.CatalogQuery(title="#0000", author="c", reviewer="a", subfields=("BUILDING", "MACHINERY"), access="OPEN", sort="title", descending=True, page=2, per_page=20)


@register("browse_filters", f"""WITH {CUSTOMERS} SELECT id, title, author, reviewer, subfield, access FROM cat WHERE contains(lower(title), '#0000') AND contains(lower(author), 'c') AND contains(lower(reviewer), 'a') AND subfield IN ('BUILDING', 'MACHINERY')
    AND lower(access) = 'open' ORDER BY lower(title) DESC, id LIMIT 20 OFFSET 20""")
def browse_filters(spark, sf_dir):
    """The second page of a request by fields"""
    return FILTERS.run(browse.serving_view(customer_catalog(spark, sf_dir))).select("id", "title", "author", "reviewer", "subfield", "access")


@register("browse_state", "SELECT * FROM (VALUES (5, 'title=%230000&author=c&reviewer=a&access=OPEN&sort=title&page=2&per_page=20&subfields=BUILDING&subfields=MACHINERY', true, 'BUILDING')) AS t(filters, params, same, known)")
def browse_state(spark, sf_dir):
    """A request as parameters and back, and names that are not known left out"""
    text = FILTERS.to_params()
    again, known = browse.CatalogQuery.from_params(text), browse.CatalogQuery.from_params(text, {"subfields": {"BUILDING"}})
    return spark.range(1).select(F.lit(FILTERS.active_filters()).alias("filters"), F.lit(text).alias("params"), F.lit(again == FILTERS).alias("same"), F.lit(",".join(known.subfields)).alias("known"))


@register("journal_order", "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'The ' ELSE '' END || n_name AS journal FROM nation WHERE n_nationkey % 5 <> 0")
def journal_order(spark, sf_dir):
    """A2"""
    n = table(spark, sf_dir, "nation")
    named = F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.when(F.col("n_nationkey") % 2 == 0, "The ").otherwise(""), F.col("n_name")))
    return browse.journal_names(n.select(named.alias("journal")).union(n.select(named.alias("journal"))))


@register("newest_unclassified", f"WITH {CUSTOMERS} SELECT id, title FROM cat WHERE subfield = '' ORDER BY id DESC LIMIT 200")
def newest_unclassified(spark, sf_dir):
    """O5"""
    return browse.newest_unclassified(customer_catalog(spark, sf_dir)).select("id", F.col("book_title").alias("title"))


@register("batch_insert", """WITH cat AS (SELECT c_custkey AS id, '10.1000/' || c_custkey AS doi, '' AS link, c_name AS title FROM customer WHERE c_custkey % 2 = 0),
    b AS (SELECT c_custkey AS seq, '10.1000/' || (c_custkey % 400) AS doi, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'https://x/' || (c_custkey % 311) END AS link, c_name AS title, c_mktsegment AS source FROM customer),
    f AS (SELECT * FROM b WHERE doi NOT IN (SELECT doi FROM cat)),
    s AS (SELECT list_reduce(list({'seq': [seq], 'd': [doi], 'l': CASE WHEN link = '' THEN []::VARCHAR[] ELSE [link] END} ORDER BY seq),
      lambda a, x: CASE WHEN list_has_any(a.d, x.d) OR list_has_any(a.l, x.l) THEN a ELSE {'seq': list_concat(a.seq, x.seq), 'd': list_concat(a.d, x.d), 'l': list_concat(a.l, x.l)} END) AS kept FROM f)
    SELECT id, doi, link, title FROM cat UNION ALL
    SELECT (SELECT max(id) FROM cat) + row_number() OVER (ORDER BY source, doi, link, title), doi, link, title FROM f JOIN (SELECT unnest(kept.seq) AS seq FROM s) USING (seq)""")
def batch_insert(spark, sf_dir):
    """SK1, SK2, SK7-SK9, J1: a batch into a catalog, ids going on from the largest"""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    catalog = conform(c.where(key % 2 == 0).select(key.alias("id"), F.concat(F.lit("10.1000/"), key.cast("string")).alias("doi"), F.lit("").alias("review_link"), F.col("c_name").alias("book_title")))
    batch = c.select(
        key.alias("seq"), F.concat(F.lit("10.1000/"), (key % 400).cast("string")).alias("doi"), F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("https://x/"), (key % 311).cast("string"))).alias("review_link"),
        F.col("c_name").alias("book_title"), F.col("c_mktsegment").alias("publication_source"),
    )
    return upsert.insert_or_ignore(catalog, batch).select("id", "doi", F.col("review_link").alias("link"), F.col("book_title").alias("title"))


@register("first_of_keys", "SELECT seq, doi FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY seq) AS rn FROM (SELECT o_orderkey AS seq, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'c' || o_custkey END AS doi FROM orders)) WHERE rn = 1 OR doi = ''")
def first_of_keys(spark, sf_dir):
    """Blank keys never collide"""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_custkey") % 5 == 0, "").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("doi"))
    return upsert.first_per_key(o, "doi").select("seq", "doi")


DUPLICATES = """d AS (SELECT c_custkey AS id, n_name AS book_title, c_mktsegment AS publication_source, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS book_author_last_name, CASE WHEN c_nationkey % 3 = 0 THEN 'R' || (c_custkey % 2) ELSE 'R' END AS reviewer_last_name,
    CASE WHEN c_custkey % 6 = 0 THEN 'x' ELSE '' END AS doi, CASE WHEN c_custkey % 50 = 0 THEN 'g' END AS symposium_group FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def duplicates(spark, sf_dir) -> DataFrame:
    c, key = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")), F.col("c_custkey")
    return conform(c.select(
        key.alias("id"), F.col("n_name").alias("book_title"), F.col("c_mktsegment").alias("publication_source"), F.lit("2001").alias("publication_date"), F.when(key % 4 == 0, F.col("c_name")).alias("book_author_last_name"),
        F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("R"), (key % 2).cast("string"))).otherwise("R").alias("reviewer_last_name"), F.when(key % 6 == 0, "x").otherwise("").alias("doi"), F.when(key % 50 == 0, "g").alias("symposium_group"),
    ))


SURVIVORS = f"""{DUPLICATES}, g AS (SELECT book_title, publication_source, count(DISTINCT reviewer_last_name) AS people FROM d WHERE symposium_group IS NULL GROUP BY 1, 2),
    s AS (SELECT id, symposium_group, people, row_number() OVER (PARTITION BY book_title, publication_source, symposium_group ORDER BY (book_author_last_name IS NOT NULL)::INT + (doi <> '')::INT DESC, id) AS rn FROM d LEFT JOIN g USING (book_title, publication_source)),
    kept AS (SELECT id FROM s WHERE symposium_group IS NOT NULL OR people > 1 OR rn = 1)"""


@register("survivors", f"WITH {SURVIVORS} SELECT id FROM kept")
def survivors(spark, sf_dir):
    """W1, A8, A9"""
    return upsert.survivors(duplicates(spark, sf_dir)).select("id")


@register("dry_run", f"""WITH {SURVIVORS} SELECT id, NULL AS "column", NULL AS old, NULL AS new FROM d WHERE id NOT IN (SELECT id FROM kept) UNION ALL SELECT id, 'doi', doi, 'y' FROM d JOIN kept USING (id) WHERE id % 9 = 0""")
def dry_run(spark, sf_dir):
    """SK12, A14, SK5: what an update and a deletion would change"""
    before = duplicates(spark, sf_dir)
    gone = before.join(upsert.survivors(before).select("id"), "id", "left_anti")
    after = upsert.delete_ids(before, gone).withColumn("doi", F.when(F.col("id") % 9 == 0, "y").otherwise(F.col("doi")))
    return upsert.changes(before, after, ("doi", "book_title"))


@register("fill_blanks", f"""WITH {DUPLICATES}, f AS (SELECT book_title, min(nullif(a, '')) AS a FROM (SELECT n_name AS book_title, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS a FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1)
    SELECT id, coalesce(book_author_last_name, a) AS author FROM d LEFT JOIN f USING (book_title)""")
def fill_blanks(spark, sf_dir):
    """Unset values from a look-up, of several the least"""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    found = s.select(F.col("n_name").alias("book_title"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("book_author_last_name"))
    return upsert.fill_by_key(duplicates(spark, sf_dir), found, "book_title", ("book_author_last_name",)).select("id", F.col("book_author_last_name").alias("author"))


@register("books_to_search", """WITH b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'Ethics' WHEN p_partkey % 7 = 0 THEN upper(p_name) || ' once more' ELSE p_name || ' once more' END AS title, CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS last FROM part),
    g AS (SELECT lower(title) AS t, lower(last) AS l, count(*) AS n, arg_min(title, id) AS title, arg_min(last, id) AS last FROM b WHERE last IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT t || '|' || l AS key, title, last, n FROM g WHERE t NOT IN ('introduction', 'ethics', 'philosophy', 'metaphysics', 'logic', 'reason', 'justice', 'freedom', 'truth', 'knowledge') AND len(regexp_extract_all(title, '[a-zA-Z]{3,}')) >= 3
    AND NOT EXISTS (SELECT 1 FROM part WHERE p_size < 5 AND lower(p_name || ' ONCE more') = t AND lower(p_brand) = l)""")
def books_to_search(spark, sf_dir):
    """A7, J5, P33"""
    p, key, name = table(spark, sf_dir, "part"), F.col("p_partkey"), F.concat("p_name", F.lit(" once more"))
    title = F.when(key % 10 == 0, "Ethics").when(key % 7 == 0, F.concat(F.upper("p_name"), F.lit(" once more"))).otherwise(name)
    covered = p.where("p_size < 5").select(F.concat("p_name", F.lit(" ONCE more")).alias("book_title"), F.col("p_brand").alias("book_author_last_name"))
    return matching.candidate_books(p.select(key.alias("id"), title.alias("book_title"), F.when(key % 11 != 0, F.col("p_brand")).alias("book_author_last_name")), covered)


SURNAMES = ["Doe", "de la Cruz", "O'Hara", "Smith-Jones", "Roe", "Ng"]
BOOKS = f"""books AS (SELECT n_nationkey AS key, (['The small green ring', 'A large plate of steel', 'On rings', 'Copper and brass in small parts', 'Small things'])[n_nationkey % 5 + 1] AS title, ([{', '.join("'" + s.replace("'", "''") + "'" for s in SURNAMES)}])[n_nationkey % 6 + 1] AS last FROM nation)"""
HEADLINES = ["Review: {} by Jane Doe", "{}, by R. de la Cruz - a review", "A REVIEW OF THE SMALL GREEN RING BY DOE", "O'Hara on {} (review)", "{} by Smith-Jones, reviewed: copper, brass, small parts", "News of {} by Roe", "review of large plate steel, de la cruz", "Ng: small things. Review", "Review. {}"]


def books(spark, sf_dir) -> DataFrame:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (k % len(values) + 1).cast("int"))
    return n.select(k.alias("key"), pick(["The small green ring", "A large plate of steel", "On rings", "Copper and brass in small parts", "Small things"]).alias("title"), pick(SURNAMES).alias("last"))


@register("headline_hits", rf"""WITH {BOOKS}, r AS (SELECT p_partkey AS url, lower({sql_case(HEADLINES)}) AS h FROM part), w AS (SELECT *, list_filter(regexp_extract_all(title, '[a-zA-Z]{{3,}}'), lambda x: length(x) >= 4) AS ws FROM books)
    SELECT DISTINCT url, key FROM r JOIN w ON contains(h, 'review') AND list_contains(regexp_extract_all(h, '[\p{{L}}''-]+'), split_part(lower(last), ' ', 1)) AND contains(' ' || regexp_replace(h, '[^\p{{L}}''-]+', ' ', 'g') || ' ', ' ' || lower(last) || ' ')
    WHERE len(ws) > 0 AND len(list_filter(ws, lambda x: contains(h, lower(x)))) / len(ws) >= 0.75""")
def headline_hits(spark, sf_dir):
    """J8"""
    return matching.headline_matches(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("url"), case_of(HEADLINES).alias("headline"), "p_partkey"), books(spark, sf_dir))


SNIPPETS = ["{} by Jane Doe, Oxford 2001. A review", "small green ring, says Doe", "Jan 15, 2024 - Reviews: Copper and brass in small parts by Smith-Jones", "On rings: O'Hara. Review", "nothing", "Small things by Ng, a review", "large plate of steel de la Cruz"]


@register("search_hits", rf"""WITH {BOOKS}, r AS (SELECT p_partkey, p_partkey % 25 AS key, p_name AS title, {sql_case(SNIPPETS)} AS snippet, 'https://www.' || (['lrb.co.uk', 'tls.org', 'blog.net'])[p_partkey % 3 + 1] || '/a/' || (p_partkey // 4) || '?q=1' AS url FROM part),
    j AS (SELECT r.*, b.title AS book, b.last, lower(r.title || ' ' || snippet) AS x, regexp_extract_all(b.title, '[a-zA-Z]{{3,}}') AS ws, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://(?:www\.)?', 'https://') AS link FROM r JOIN books b USING (key)),
    s AS (SELECT *, CASE WHEN contains(link, 'lrb.co.uk') THEN 'London Review' WHEN contains(link, 'tls.org') THEN 'TLS' END AS venue, coalesce(len(list_filter(ws, lambda w: contains(x, lower(w)))) / nullif(len(ws), 0), 0) AS ratio,
      regexp_matches(x, 'review|university press|oxford|cambridge|princeton|harvard|routledge|mit press') OR contains(x, 'on ' || left(lower(book), 30)) AS signal FROM j)
    SELECT book_title, last, venue, publication_date, review_link FROM (SELECT book AS book_title, last, venue, CASE WHEN starts_with(snippet, 'Jan 15') THEN '2024-01-15' ELSE '' END AS publication_date, link AS review_link, row_number() OVER (PARTITION BY link ORDER BY key) AS rn
      FROM s WHERE venue IS NOT NULL AND contains(x, lower(last)) AND CASE WHEN len(ws) < 4 THEN ratio >= 0.6 AND signal WHEN signal THEN ratio >= 0.4 ELSE ratio >= 0.6 END AND link NOT IN (SELECT 'https://tls.org/a/' || p_partkey FROM part WHERE p_size = 1)) WHERE rn = 1""")
def search_hits(spark, sf_dir):
    """J4, J9, J9b, U10"""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    host = F.element_at(F.array(*(F.lit(h) for h in ("lrb.co.uk", "tls.org", "blog.net"))), (key % 3 + 1).cast("int"))
    results = p.select((key % 25).cast("int").alias("key"), F.col("p_name").alias("title"), case_of(SNIPPETS).alias("snippet"), F.concat(F.lit("https://www."), host, F.lit("/a/"), F.floor(key / 4).cast("string"), F.lit("?q=1")).alias("url"))
    venues = spark.createDataFrame([("lrb.co.uk", "London Review", "Restricted"), ("tls.org", "TLS", "Restricted")], "domain string, venue string, access string")
    known = p.where("p_size = 1").select(F.concat(F.lit("http://tls.org/a/"), key.cast("string"), F.lit("/")).alias("review_link"))
    wanted = books(spark, sf_dir).select("key", F.col("title").alias("book_title"), F.lit("J").alias("first"), "last")
    return matching.verified_results(results, wanted, venues, known).select("book_title", F.col("book_author_last_name").alias("last"), F.col("publication_source").alias("venue"), "publication_date", "review_link")


@register("keyword_hits", rf"""WITH {BOOKS}, a AS (SELECT p_partkey AS web_url, p_name AS main, p_type AS abstract, ([{', '.join("'" + s.replace("'", "''") + ", J.'" for s in SURNAMES)}])[p_partkey % 6 + 1] AS person, CASE WHEN p_partkey % 4 = 0 THEN 'SMALL RING' ELSE p_name END AS named FROM part),
    w AS (SELECT *, regexp_extract_all(title, '[a-zA-Z]{{3,}}') AS ws FROM books)
    SELECT DISTINCT web_url, key FROM a JOIN w ON list_contains(regexp_extract_all(lower(person), '[\p{{L}}''-]+'), lower(string_split(last, ' ')[-1]))
    WHERE len(ws) > 0 AND (len(list_filter(ws, lambda x: contains(lower(named), lower(x)))) / len(ws) >= 0.5 OR len(list_filter(ws, lambda x: contains(lower(concat_ws(' ', main, abstract, 'a snippet')), lower(x)))) / len(ws) >= 0.75)""")
def keyword_hits(spark, sf_dir):
    """J10"""
    key = F.col("p_partkey")
    person = F.element_at(F.array(*(F.lit(f"{s}, J.") for s in SURNAMES)), (key % 6 + 1).cast("int"))
    named = F.when(key % 4 == 0, "SMALL RING").otherwise(F.col("p_name"))
    word = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    articles = table(spark, sf_dir, "part").select(key.alias("web_url"), F.struct(F.col("p_name").alias("main")).alias("headline"), F.col("p_type").alias("abstract"), F.lit("a snippet").alias("snippet"), F.array(word("Person", person), word("Title", named)).alias("keywords"))
    return matching.keyword_matches(articles, books(spark, sf_dir))


@register("batch_pairs", "SELECT conv_id, (i - 1)::INT AS place, l[i] AS request, r[i] AS response FROM (SELECT conv_id, list(text ORDER BY turn) AS l, list(role ORDER BY turn) AS r, unnest(range(1, count(*) + 1)) AS i FROM conversations GROUP BY conv_id)")
def batch_pairs(spark, sf_dir):
    """Requests and responses by their places"""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("t"))
    return matching.zipped_of(c.select("conv_id", F.col("t.text").alias("l"), F.col("t.role").alias("r")), "l", "r", ("conv_id",))


TURNS = ["Précis of a book", "A longer title: with more", "Reply to critics", "Front matter", "<i>The Nature of Small Things</i>: comments", "Small things: replies", "Plain remarks"]
ITEMS = f"""items AS (SELECT 'J' AS journal, conv_id::VARCHAR AS volume, '1' AS issue, conv_id || '-' || lpad(turn::VARCHAR, 4, '0') AS doi, ([{', '.join("'" + t.replace("'", "''") + "'" for t in TURNS)}])[((turn * 3 + conv_id) % {len(TURNS)} + 1)::INT] AS title, (turn * 7 + 1)::INT AS start_page FROM conversations)"""


def items_of_issues(spark, sf_dir) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    title = F.element_at(F.array(*(F.lit(t) for t in TURNS)), ((turn * 3 + conv) % len(TURNS) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select(
        F.lit("J").alias("journal"), conv.cast("string").alias("volume"), F.lit("1").alias("issue"), F.concat_ws("-", conv.cast("string"), F.lpad(turn.cast("string"), 4, "0")).alias("doi"), title.alias("title"), (turn * 7 + 1).cast("int").alias("start_page"),
    )


@register("marker_groups", f"""WITH {ITEMS}, m AS (SELECT volume, doi AS marker, start_page AS mp FROM items WHERE starts_with(title, 'Précis')), n AS (SELECT i.*, marker, mp FROM items i JOIN m USING (volume) WHERE start_page BETWEEN mp - 10 AND mp + 80),
    b AS (SELECT *, title = 'Front matter' AS odd, coalesce(max((title = 'Front matter' AND start_page > mp)::INT) OVER (PARTITION BY marker ORDER BY start_page, doi), 0) AS broken FROM n),
    r AS (SELECT *, coalesce(max((title = 'Reply to critics' OR title = 'Small things: replies')::INT) OVER (PARTITION BY marker ORDER BY start_page, doi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM b WHERE broken = 0 AND NOT odd),
    k AS (SELECT *, count(*) OVER (PARTITION BY marker) AS size FROM r WHERE over = 0)
    SELECT marker, doi, 'J|' || volume || '|1' AS symposium_group FROM k WHERE size >= 2""")
def marker_groups(spark, sf_dir):
    """C7, J15, W5"""
    return symposia.by_markers(items_of_issues(spark, sf_dir)).select("marker", "doi", "symposium_group")


@register("sibling_titles", f"""WITH {ITEMS}, t AS (SELECT *, CASE WHEN starts_with(title, '<i>') THEN 'The Nature of Small Things' WHEN title = 'Small things: replies' THEN 'Small things' END AS told FROM items)
    SELECT volume AS symposium_group, arg_min(told, (start_page, doi)) AS book_title FROM t WHERE told IS NOT NULL GROUP BY 1""")
def sibling_titles(spark, sf_dir):
    """C8"""
    return symposia.inferred_title(items_of_issues(spark, sf_dir).withColumn("symposium_group", F.col("volume")))


@register("last_items", """SELECT a.user_id::VARCHAR AS volume, a.event_id::INT AS range_start, max(b.event_id)::INT AS range_end FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id > a.event_id WHERE a.event_type = 'signup' GROUP BY 1, 2""")
def last_items(spark, sf_dir):
    """J13"""
    e = table(spark, sf_dir, "events").select(F.lit("J").alias("journal"), F.col("user_id").cast("string").alias("volume"), F.lit("1").alias("issue"), F.lit("s").alias("surname"), F.col("event_id").cast("int").alias("start_page"), F.col("event_id").cast("int").alias("end_page"), "event_type")
    return symposia.last_item_by(e, e.where("event_type = 'signup'"), symposia.ISSUE).select("volume", "range_start", "range_end")


CODES = ["{}", "x{y", '```json\n{"primary": "ethics", "secondary": "mind"}\n```', '{"primary": "unknown"}', 'Sure: {"primary": "mind", "secondary": "a } b"} and {"primary": "ethics"}', '{"secondary": "mind"}', '{"primary": "mind", "note": "say \\"{\\""}']


@register("subfields", f"""WITH {CUSTOMERS}, m AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0)
    SELECT id, CASE WHEN subfield <> '' THEN subfield ELSE coalesce(r_name, '') END AS primary, CASE WHEN subfield = '' AND r_name IS NOT NULL THEN 'second' ELSE '' END AS secondary FROM cat LEFT JOIN m ON journal = n_name""")
def subfields(spark, sf_dir):
    """J2, C9"""
    n = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    mapped = classify.by_journal(customer_catalog(spark, sf_dir), n.select(F.col("n_name").alias("publication_source"), F.col("r_name").alias("primary"), F.lit("second").alias("secondary")))
    return mapped.select("id", F.coalesce("subfield_primary", F.lit("")).alias("primary"), F.coalesce("subfield_secondary", F.lit("")).alias("secondary"))


@register("classifier_batches", f"WITH {CUSTOMERS} SELECT id // 500 AS batch, id, 'Title: ' || title || chr(10) || 'Journal: ' || journal AS prompt FROM cat WHERE subfield = ''")
def classifier_batches(spark, sf_dir):
    """C10, F66"""
    return classify.requests(customer_catalog(spark, sf_dir), 500)


@register("classifier_answers", f"""WITH a AS (SELECT p_partkey AS id, (p_partkey % {len(CODES)})::INT AS k FROM part) SELECT id, CASE k WHEN 2 THEN 'ethics' ELSE 'mind' END AS primary, CASE k WHEN 2 THEN 'mind' END AS secondary FROM a WHERE k IN (2, 4, 6)""")
def classifier_answers(spark, sf_dir):
    """Answers of a classifier, known codes only"""
    replies = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.array(*(F.lit(c) for c in CODES)), (F.col("p_partkey") % len(CODES) + 1).cast("int")).alias("reply"))
    return classify.answers(replies, ["ethics", "mind"])


@register("balanced_objects", "SELECT event_id, props AS object FROM events")
def balanced_objects(spark, sf_dir):
    """the first balanced object inside other text"""
    return table(spark, sf_dir, "events").select("event_id", balanced_json(F.concat(F.lit("Answer: "), "props", F.lit(" } and {\"k\": 0}"))).alias("object"))


@register("headed_lists", """WITH a AS (SELECT p_partkey, p_name, p_size FROM part), e AS (SELECT p_partkey, 0 AS pos, NULL AS year, 'early' AS entry FROM a UNION ALL SELECT p_partkey, 2, (1950 + p_size)::VARCHAR, p_name || ' one' FROM a UNION ALL SELECT p_partkey, 4, (1950 + p_size)::VARCHAR, 'two & three' FROM a
    UNION ALL SELECT p_partkey, 6, '2001', 'last' FROM a) SELECT p_partkey, pos::INT AS pos, year, entry FROM e""")
def headed_lists(spark, sf_dir):
    """SC17, SC19, W4: list entries under the year of the nearest heading"""
    html = F.concat(F.lit("<li>early</li><h2>Reviews of "), (F.col("p_size") + 1950).cast("string"), F.lit("</h2><ul><li class=x> <i>"), "p_name", F.lit("</i> one</li><h3>No year</h3><li>two & three</li></ul><H2>In 2001</H2><li>last</li>"))
    return landed.headed_entries(table(spark, sf_dir, "part").select("p_partkey", html.alias("html")), key="p_partkey")


@register("review_pages", r"""SELECT p_partkey, 'On ' || p_name AS title, 'Jane' AS author_first, 'Doe' AS author_last, p_partkey % 2 = 0 AS is_edited, 'John Q.' AS reviewer_first, 'Roe' AS reviewer_last, 'A College' AS affiliation, CASE WHEN p_size % 2 = 0 THEN '2020-03-0' || (p_size % 9 + 1) ELSE '2019-07-05' END AS published,
    '10.1000/' || p_partkey AS doi, 'Some text about ' || p_name || '.' AS summary FROM part WHERE p_partkey % 5 <> 0""")
def review_pages(spark, sf_dir):
    """SC13, P21, F52, U6: pages of reviews by their parts; other pages give nothing"""
    n = F.col("p_size")
    stamp = F.when(n % 2 == 0, F.concat(F.lit('<meta property="datePublished" content="2020-03-0'), (n % 9 + 1).cast("string"), F.lit('T10:00:00Z">'))).otherwise(F.lit(""))
    author = F.when(F.col("p_partkey") % 2 == 0, "Jane Doe (ed.)").otherwise("Jane Doe")
    page = F.concat(
        stamp, F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit('<div class="meta-item__bibliography">'), author, F.lit(", <em>On  "), "p_name", F.lit("</em>, Press</div>"))).otherwise(""),
        F.lit('<p class="meta-item__reviewer">John Q. Roe, A College</p><p class="meta-item__edition">2019.7.5</p><div class="article-content"><b>Some</b> text about '), "p_name", F.lit(".</div> doi 10.1000/"), F.col("p_partkey").cast("string"), F.lit(" end"),
    )
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")).select("p_partkey", F.explode(F.filter(F.array(landed.review_page(page)), lambda r: r.isNotNull())).alias("r")).select("p_partkey", *(f"r.{c}" for c in ("title", "author_first", "author_last", "is_edited", "reviewer_first", "reviewer_last", "affiliation", "published", "doi", "summary")))


@register("catalog_scans", f"""WITH {DUPLICATES} SELECT 'author' AS scan, id FROM d WHERE coalesce(book_author_last_name, '') = '' UNION ALL SELECT 'surname', id FROM d WHERE coalesce(book_author_last_name, '') = '' UNION ALL SELECT 'reviewer', id FROM d WHERE publication_source IN ('BUILDING', 'MACHINERY') AND coalesce(doi, '') = ''""")
def catalog_scans(spark, sf_dir):
    """SC2, SC27-SC29"""
    d = duplicates(spark, sf_dir)
    third = landed.missing_reviewer(d.withColumn("reviewer_last_name", F.col("doi")), ["BUILDING", "MACHINERY"])
    return landed.missing_author(d).select(F.lit("author").alias("scan"), "id").unionAll(landed.missing_surname(d).select(F.lit("surname"), "id")).unionAll(third.select(F.lit("reviewer"), "id"))


@register("run_report", f"WITH {DUPLICATES} SELECT '- ' || publication_source || ': ' || count(*) || ' rows, ' || count(*) FILTER (book_author_last_name <> '') || ' with author' AS line FROM d GROUP BY publication_source")
def run_report(spark, sf_dir):
    """SK11"""
    return landed.run_report(duplicates(spark, sf_dir))


@register("changed_items", "SELECT o_orderkey AS orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def changed_items(spark, sf_dir):
    """SC6"""
    return landed.changed_since(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_orderdate").cast("timestamp").alias("indexed")), "1996-01-01").select("orderkey")


@register("newest_posts", "SELECT c_custkey AS id, c_name AS slug FROM customer WHERE starts_with(c_name, 'Customer#00000') ORDER BY c_mktsegment DESC, c_custkey DESC LIMIT 50")
def newest_posts(spark, sf_dir):
    """SC10"""
    return landed.posts_with_slug(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("slug"), F.col("c_mktsegment").alias("date")), "Customer#00000", 50).select("id", "slug")


@register("logic_dates", """SELECT p_partkey::VARCHAR AS "DOI", CASE p_size % 3 WHEN 0 THEN (1950 + p_size) || '-02-03' WHEN 1 THEN (1950 + p_size)::VARCHAR ELSE '' END AS date FROM part""")
def logic_dates(spark, sf_dir):
    """F51"""
    n = F.col("p_size")
    parts = lambda *x: F.struct(F.array(F.array(*x)).alias("date-parts"))
    none = F.lit(None).cast("struct<`date-parts`: array<array<int>>>")
    return landed.logic_dates(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("DOI"), none.alias("published-print"), F.when(n % 3 == 0, parts(n + 1950, F.lit(2), F.lit(3))).alias("published-online"), F.when(n % 3 == 1, parts(n + 1950, F.lit(5))).alias("issued")))


@register("cleanup_phases", r"""WITH c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'Book Review: ' || p_name ELSE p_name END AS t, CASE p_partkey % 4 WHEN 0 THEN 'Boston Globe' WHEN 1 THEN 'ARC Digital' ELSE p_brand END AS s, CASE p_partkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN 'Doe,, ' ELSE 'Roe' END AS l, CASE p_partkey % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'Other' END AS a FROM part)
    SELECT id, CASE WHEN starts_with(t, 'Book Review: ') THEN substr(t, 14) ELSE t END AS title, CASE s WHEN 'Boston Globe' THEN 'The Boston Globe' WHEN 'ARC Digital' THEN 'Arc Digital' ELSE s END AS source, CASE WHEN trim(l) = '' THEN NULL WHEN l = 'Doe,, ' THEN 'Doe' ELSE l END AS last,
      CASE WHEN a = 'OPEN' THEN 'open' ELSE a END AS access, 'review' AS type FROM c""")
def cleanup_phases(spark, sf_dir):
    """A range of phases"""
    key = F.col("p_partkey")
    catalog = conform(table(spark, sf_dir, "part").select(
        key.alias("id"), F.when(key % 3 == 0, F.concat(F.lit("Book Review: "), "p_name")).otherwise(F.col("p_name")).alias("book_title"), F.when(key % 4 == 0, "Boston Globe").when(key % 4 == 1, "ARC Digital").otherwise(F.col("p_brand")).alias("publication_source"),
        F.when(key % 5 == 0, "  ").when(key % 5 == 1, "Doe,, ").otherwise("Roe").alias("book_author_last_name"), F.when(key % 3 == 0, "OPEN").when(key % 3 == 1, "Other").alias("access_type"),
    ))
    done = cleanup.run(catalog, "journal_names", "trailing_commas")
    return done.select("id", F.col("book_title").alias("title"), F.col("publication_source").alias("source"), F.col("book_author_last_name").alias("last"), F.col("access_type").alias("access"), F.col("entry_type").alias("type"))


@register("action_counts", f"WITH {DUPLICATES} SELECT publication_source, count(*) FILTER (id % 3 = 0) AS keep, count(*) FILTER (id % 3 = 1) AS reparse, count(*) FILTER (id % 3 = 2) AS delete FROM d GROUP BY 1")
def action_counts(spark, sf_dir):
    """A10, A11"""
    d = duplicates(spark, sf_dir)
    return cleanup.action_counts(d.select("id", F.when(F.col("id") % 3 == 0, "keep").when(F.col("id") % 3 == 1, "reparse").otherwise("delete").alias("action")), d)


@register("single_row_look_ups", "SELECT c_custkey AS custkey FROM customer WHERE c_custkey % 3 <> 0 AND (c_custkey % 7 <> 0 OR c_custkey % 2 = 0)")
def single_row_look_ups(spark, sf_dir):
    """SC3, SC4: by DOI, and by link, a blank key being in no catalog"""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    rows = c.select(key.alias("custkey"), F.when(key % 2 == 0, "").otherwise(key.cast("string")).alias("review_link"), key.cast("string").alias("doi"))
    known = c.where(key % 3 == 0).select(key.cast("string").alias("doi"), F.lit("").alias("review_link")).unionAll(c.where(key % 7 == 0).select(F.lit(""), F.when(key % 2 == 0, "").otherwise(key.cast("string"))))
    return upsert.unknown(rows, known).select("custkey")
