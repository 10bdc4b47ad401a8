"""The catalog operators as queries over the test tables, with their DuckDB counterparts.

There is no table of reviews, so each operator runs over a table of like shape: customers of
nations as a catalog, parts as titles, events and conversations as ordered items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import dates_urls, names, text
from quire.operators import browse, detect, matching, symposia, upsert, windows
from quire.operators.parse import parse_title
from quire.schema import conform, from_headings, is_blank, titled
from quire.sources import landed
from quire.storage import spread
from quire.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a catalog: the name is the title, the nation the journal, a year from the key."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return conform(
        joined.select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("book_title"), F.split_part("c_name", F.lit("#"), F.lit(1)).alias("book_author_first_name"), F.col("c_mktsegment").alias("book_author_last_name"),
            F.lit("").alias("reviewer_first_name"), F.col("r_name").alias("reviewer_last_name"), F.col("n_name").alias("publication_source"),
            F.format_string("%04d-01-01", (F.col("c_custkey") % 30 + 1995).cast("int")).alias("publication_date"), F.lit("").alias("review_link"), F.concat(F.lit("10.1000/"), F.col("c_custkey").cast("string")).alias("doi"),
            F.when(F.col("c_acctbal") > 0, "Open").otherwise("Restricted").alias("access_type"), F.when(F.col("c_custkey") % 5 == 0, "symposium").otherwise("").alias("entry_type"),
            F.when(F.col("c_custkey") % 5 == 0, F.concat_ws("|", "n_name", (F.col("c_custkey") % 7).cast("string"))).alias("symposium_group"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("subfield_primary"),
        )
    )


CUSTOMERS = """
cat AS (
  SELECT c_custkey AS id, c_name AS title, trim(split_part(c_name, '#', 1) || ' ' || c_mktsegment) AS author, r_name AS reviewer, n_name AS journal,
    printf('%04d-01-01', c_custkey % 30 + 1995) AS date, 'https://doi.org/10.1000/' || c_custkey AS link, CASE WHEN c_acctbal > 0 THEN 'Open' ELSE 'Restricted' END AS access,
    CASE WHEN c_custkey % 5 = 0 THEN 'symposium' ELSE 'review' END AS type, CASE WHEN c_custkey % 5 = 0 THEN n_name || '|' || (c_custkey % 7) ELSE '' END AS symposium_group,
    CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE '' END AS subfield
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


@register("serving_projection", f"WITH {CUSTOMERS} SELECT id, title, author, reviewer, journal, date, link, '' AS summary, access, type, symposium_group, subfield, '' AS subfield2 FROM cat")
def serving_projection(spark, sf_dir):
    """P1"""
    return browse.serving_view(customer_catalog(spark, sf_dir))


@register("search_global", "SELECT p_partkey AS partkey, p_name AS name, p_brand AS brand FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')")
def search_global(spark, sf_dir):
    """P5"""
    return table(spark, sf_dir, "part").where(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).contains("brand#1")).select(F.col("p_partkey").alias("partkey"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))


BROWSE = browse.CatalogQuery(search="customer", journals=("FRANCE", "GERMANY", "CHINA", "NATION_1", "NATION_2", "NATION_3"), type="review", year_from=1998, year_to=2019, sort="journal", descending=False, page=1, per_page=25)


@register(
    "browse_page",
    f"""WITH {CUSTOMERS} SELECT id, title, author, journal, date, type FROM cat WHERE contains(lower(concat_ws(' ', title, author, reviewer, journal, date, subfield)), 'customer')
    AND journal IN ('FRANCE', 'GERMANY', 'CHINA', 'NATION_1', 'NATION_2', 'NATION_3') AND type = 'review' AND TRY_CAST(substr(date, 1, 4) AS INT) BETWEEN 1998 AND 2019
    ORDER BY lower(regexp_replace(journal, '^(?i:the )', '')), id LIMIT 25""",
)
def browse_page(spark, sf_dir):
    """P5, P7, P10, P11, O1-O3 together: one page of a browse request"""
    return BROWSE.run(browse.serving_view(customer_catalog(spark, sf_dir))).select("id", "title", "author", "journal", "date", "type")


@register("facet_filter", "SELECT d.doc_id, source, lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE source IN ('src1', 'src2', 'src3') AND (lang = 'fr' OR coalesce(quality, -1) = 1) AND lower(lang) <> 'de'")
def facet_filter(spark, sf_dir):
    """P7-P9"""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.where(F.col("source").isin("src1", "src2", "src3") & (F.lower("lang") != "de")).join(l, "doc_id", "left").where((F.col("lang") == "fr") | (F.coalesce("quality", F.lit(-1)) == 1)).select("doc_id", "source", "lang")


@register("year_range", "SELECT o_orderkey AS orderkey, year(o_orderdate)::INT AS year FROM orders WHERE TRY_CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS INT) BETWEEN 1995 AND 1996")
def year_range(spark, sf_dir):
    """P11, P37"""
    y = dates_urls.year_of(F.col("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").where(y.between(1995, 1996)).select(F.col("o_orderkey").alias("orderkey"), y.alias("year"))


@register("year_bounds", "SELECT coalesce(min(year(o_orderdate)), 2000)::INT AS year_min, coalesce(max(year(o_orderdate)), 2026)::INT AS year_max FROM orders")
def year_bounds(spark, sf_dir):
    """A3"""
    return browse.year_bounds(table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("string").alias("date")))


@register("page_sorted", "SELECT c_custkey AS custkey, lower(c_name) AS sort_key FROM customer ORDER BY lower(c_name) DESC, c_custkey LIMIT 25 OFFSET 50")
def page_sorted(spark, sf_dir):
    """O1, O3"""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.lower("c_name").alias("sort_key")).orderBy(F.desc("sort_key"), "custkey").offset(50).limit(25)


@register("facet_counts", "SELECT source, count(*) AS n FROM documents WHERE source <> '' GROUP BY source ORDER BY n DESC, source")
def facet_counts(spark, sf_dir):
    """A1"""
    return browse.facet(table(spark, sf_dir, "documents"), "source")


@register("facets_one_pass", f"WITH {CUSTOMERS} SELECT 'journal' AS facet, journal AS value, count(*) AS n FROM cat GROUP BY journal UNION ALL SELECT 'subfield', subfield, count(*) FROM cat WHERE subfield <> '' GROUP BY subfield UNION ALL SELECT 'type', type, count(*) FROM cat GROUP BY type")
def facets_one_pass(spark, sf_dir):
    """A1, A5"""
    return browse.facets(browse.serving_view(customer_catalog(spark, sf_dir)))


@register("coverage_stats", f"""WITH {CUSTOMERS} SELECT count(*) AS total, count(*) FILTER (subfield <> '') AS classified, count(*) FILTER (subfield = '') AS unclassified,
    (count(*) FILTER (subfield <> '') * 100 // count(*))::BIGINT AS classified_pct, count(*) AS with_title, count(*) AS with_author, count(DISTINCT journal) AS journals, count(*) FILTER (length(title) > 200) AS long_titles,
    count(DISTINCT nullif(symposium_group, '')) AS symposia FROM cat""")
def coverage_stats(spark, sf_dir):
    """A4, A12, A17, A19"""
    return browse.coverage(customer_catalog(spark, sf_dir))


@register("topk_unlabelled", "SELECT source, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY source ORDER BY n DESC, source LIMIT 20")
def topk_unlabelled(spark, sf_dir):
    """A6"""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return browse.top_unclassified(d.select(F.lit("").alias("subfield_primary"), F.col("source").alias("publication_source"))).withColumnRenamed("publication_source", "source")


@register("having_group", "SELECT lower(p_brand) AS brand, lower(p_type) AS type, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1, 2 HAVING count(*) >= 2")
def having_group(spark, sf_dir):
    """A7"""
    return table(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("brand"), F.lower("p_type").alias("type")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key")).where("n >= 2")


@register("revenue_by_key", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL")
def revenue_by_key(spark, sf_dir):
    """A10, A11 at scale: conditional sums by key"""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@register("conditional_counts", "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_returnflag <> 'R') AS kept FROM lineitem GROUP BY 1 ORDER BY returned DESC, month")
def conditional_counts(spark, sf_dir):
    """A10"""
    return table(spark, sf_dir, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.expr("count_if(l_returnflag = 'R')").alias("returned"), F.expr("count_if(l_returnflag <> 'R')").alias("kept")).orderBy(F.desc("returned"), "month")


@register("anti_ingest", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_ingest(spark, sf_dir):
    """J1, X3, SC3"""
    new = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("doi"))
    return upsert.unknown(new, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doi")), ("doi",)).select("doc_id")


@register("dedupe_survivor", "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY md5(text), lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def dedupe_survivor(spark, sf_dir):
    """W1, A15"""
    return windows.best(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.md5(F.col("text").cast("binary")).alias("h")), ["h", "lang"], [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "lang")


@register("two_key_insert", """WITH o AS (SELECT o_orderkey AS seq, 'c' || (o_custkey % 97) AS doi, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'd' || (trunc(o_totalprice)::BIGINT % 89) END AS review_link FROM orders),
    s AS (SELECT list_reduce(list({'seq': [seq], 'd': [doi], 'l': CASE WHEN review_link = '' THEN []::VARCHAR[] ELSE [review_link] END} ORDER BY seq),
      lambda a, x: CASE WHEN list_has_any(a.d, x.d) OR list_has_any(a.l, x.l) THEN a ELSE {'seq': list_concat(a.seq, x.seq), 'd': list_concat(a.d, x.d), 'l': list_concat(a.l, x.l)} END) AS kept FROM o)
    SELECT o.* FROM o JOIN (SELECT unnest(kept.seq) AS seq FROM s) USING (seq)""")
def two_key_insert(spark, sf_dir):
    """SK2: insert-or-ignore on two keys, first wins (tests hold it against a sequential insert)"""
    o = table(spark, sf_dir, "orders")
    batch = o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("c"), (F.col("o_custkey") % 97).cast("string")).alias("doi"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("d"), (F.col("o_totalprice").cast("long") % 89).cast("string"))).alias("review_link"))
    return upsert.settle_batch(batch)


@register("dimension_map", "SELECT coalesce(r_name, 'none') AS region, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def dimension_map(spark, sf_dir):
    """Small dimensions joined after the aggregation that makes the big side small"""
    per_nation = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    dims = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return per_nation.join(dims, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.coalesce("r_name", F.lit("none")).alias("region")).agg(F.sum("n").alias("n"))


@register("map_names", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE lang END AS lang FROM documents")
def map_names(spark, sf_dir):
    """J3, J4"""
    return matching.mapped(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", {"en": "English", "fr": "French", "de": "German"})


@register("group_peers", "SELECT a.conv_id, a.turn, b.turn AS peer_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn")
def group_peers(spark, sf_dir):
    """J11"""
    return browse.paired(table(spark, sf_dir, "conversations"), "conv_id", "turn").withColumnRenamed("peer", "peer_turn")


@register("symposium_peers", f"WITH {CUSTOMERS} SELECT a.id, b.id AS peer FROM cat a JOIN cat b ON a.symposium_group = b.symposium_group AND a.id <> b.id WHERE a.symposium_group <> ''")
def symposium_peers(spark, sf_dir):
    """J11"""
    return browse.peers(browse.serving_view(customer_catalog(spark, sf_dir)))


@register("anchor_interval", """WITH s AS (SELECT user_id, event_id AS start_id, ts FROM events WHERE event_type = 'signup'), p AS (SELECT user_id, event_id AS end_id, ts AS end_ts FROM events WHERE event_type = 'purchase'),
    r AS (SELECT s.user_id, start_id, ts, end_id, end_ts, row_number() OVER (PARTITION BY s.user_id, start_id ORDER BY end_ts, end_id) AS rn FROM s JOIN p ON p.user_id = s.user_id AND end_ts > ts)
    SELECT r.user_id, start_id, end_id, count(*) AS n FROM r JOIN events e ON e.user_id = r.user_id AND e.ts BETWEEN r.ts AND end_ts WHERE rn = 1 GROUP BY 1, 2, 3""")
def anchor_interval(spark, sf_dir):
    """The nearest later end by one window over the user's events, no range join"""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("micros").rangeBetween(1, Window.unboundedFollowing)
    timed = e.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    end = F.min(F.when(F.col("event_type") == "purchase", F.struct("micros", "event_id"))).over(w)
    starts = timed.withColumn("end", end).where("event_type = 'signup' AND end IS NOT NULL").select("user_id", F.col("event_id").alias("start_id"), F.col("micros").alias("from_ts"), F.col("end.event_id").alias("end_id"), F.col("end.micros").alias("to_ts"))
    inside = timed.select("user_id", F.col("micros").alias("at")).join(starts, "user_id").where("at BETWEEN from_ts AND to_ts")
    return inside.groupBy("user_id", "start_id", "end_id").agg(F.count("*").alias("n"))


@register("carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_signup_id FROM events")
def carry_forward(spark, sf_dir):
    """W4"""
    e = table(spark, sf_dir, "events")
    return windows.carry_forward(e, F.when(F.col("event_type") == "signup", F.col("event_id")), "last_signup_id", ["user_id"], ["ts", "event_id"]).select("event_id", "last_signup_id")


@register("stop_after_flag", "SELECT conv_id, turn FROM (SELECT *, coalesce(max((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM conversations) WHERE s = 0")
def stop_after_flag(spark, sf_dir):
    """W5"""
    return windows.until_first(table(spark, sf_dir, "conversations"), F.col("role") == "assistant", ["conv_id"], ["turn"]).select("conv_id", "turn")


@register("running_budget", "SELECT user_id, event_id, round(spent, 4) AS spent FROM (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) WHERE spent <= 450")
def running_budget(spark, sf_dir):
    """W6"""
    return windows.within_budget(table(spark, sf_dir, "events"), F.col("value"), 450, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", F.round("spent", 4).alias("spent"))


@register("first_positions", "SELECT event_type, min(event_id) AS event_id FROM events GROUP BY 1 ORDER BY 2")
def first_positions(spark, sf_dir):
    """A16, SC12"""
    return windows.first_seen(table(spark, sf_dir, "events"), "event_type", "event_id")


SIMILARITY = r"""WITH p AS (SELECT n, trim(regexp_replace(lower(n), '[^a-z0-9 ]', '', 'g')) AS k FROM (SELECT p_name AS n FROM part UNION SELECT p_name || 's' FROM part)),
    q AS (SELECT a.n AS a, b.n AS b, a.k AS x, b.k AS y, list_distinct(list_filter(string_split(a.k, ' '), lambda w: w <> '')) AS p, list_distinct(list_filter(string_split(b.k, ' '), lambda w: w <> '')) AS q FROM p a JOIN p b ON a.n <> b.n),
    o AS (SELECT *, len(list_intersect(p, q)) / greatest(len(p), len(q), 1) AS o, least(length(x), length(y)) / greatest(length(x), length(y)) AS r, starts_with(x, y) OR starts_with(y, x) AS f FROM q),
    s AS (SELECT a, b, round(CASE WHEN x = y THEN 1.0 WHEN f THEN 0.95 * r WHEN o > 0.8 THEN 0.95 * o ELSE 0.6 * o END, 6) AS score FROM o)"""


def distinct_names(spark, sf_dir):
    """Pairs of different names, singular or plural, of similarity 0.5 or more, through the blocking keys."""
    part = table(spark, sf_dir, "part")
    n = part.select("p_name").union(part.select(F.concat("p_name", F.lit("s")))).distinct()
    pairs = matching.similar_titles(n.select(F.col("p_name").alias("record"), F.col("p_name").alias("title")), n.select(F.col("p_name").alias("work"), F.col("p_name").alias("title")))
    return pairs.where("record <> work").select(F.col("record").alias("a"), F.col("work").alias("b"), F.round("score", 6).alias("score"))


@register("title_similarity", SIMILARITY + " SELECT a, b, score FROM s WHERE score >= 0.5 AND a < b")
def title_similarity(spark, sf_dir):
    """F25, X4, J6"""
    return distinct_names(spark, sf_dir).where("a < b")


@register("best_match", SIMILARITY + " SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn FROM s WHERE score >= 0.5) WHERE rn = 1")
def best_match(spark, sf_dir):
    """J6, W2"""
    return windows.best(distinct_names(spark, sf_dir), ["a"], [F.desc("score"), F.col("b")])


@register("name_scores", r"""SELECT p_partkey, round(CASE WHEN x = y THEN 1.0 WHEN starts_with(x, y) OR starts_with(y, x) THEN 0.95 * least(length(x), length(y)) / greatest(length(x), length(y)) WHEN o > 0.8 THEN 0.95 * o ELSE 0.6 * o END, 6) AS score
    FROM (SELECT p_partkey, x, 'small ring' AS y, len(list_intersect(list_distinct(string_split(x, ' ')), ['small', 'ring'])) / greatest(len(list_distinct(string_split(x, ' '))), 2) AS o FROM (SELECT p_partkey, lower(p_name) AS x FROM part))""")
def name_scores(spark, sf_dir):
    """F25 as a projection over all rows"""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.title_similarity(F.col("p_name"), F.lit("small ring")), 6).alias("score"))


@register("url_normalize", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://(?:www\.)?', 'https://'), '/+$', '') AS norm_url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '') AS domain FROM pages")
def url_normalize(spark, sf_dir):
    """F57, F58"""
    return table(spark, sf_dir, "pages").select("page_id", dates_urls.normalize_url(F.col("url")).alias("norm_url"), dates_urls.domain(F.col("url")).alias("domain"))


@register("text_clean", r"SELECT doc_id, trim(regexp_replace(lower(split_part(regexp_replace(text, '<[^>]+>', '', 'g'), ':', 1)), '[^a-z0-9 ]', '', 'g')) AS key, len(regexp_extract_all(text, '[a-zA-Z]{3,}'))::INT AS n_words, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS short FROM documents")
def text_clean(spark, sf_dir):
    """F3, F13-F15"""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.comparison_key(t).alias("key"), F.size(text.significant_words(t)).alias("n_words"), text.truncated(t).alias("short"))


#: What F1 replaces, as code points: spaces, single quotes, double quotes, dashes and hyphens; and Unicode's white space.
PLAIN = "translate(text, " + " || ".join(f"chr({c})" for c in (0xA0, 0x2002, 0x2018, 0x2019, 0x201C, 0x201D, 0x2013, 0x2014, 0x2010, 0x2011)) + """, '  ''''""----')"""
WHITE = r"[\x{0009}-\x{000D} \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@register("normalize_space", f"SELECT doc_id, md5(trim(regexp_replace({PLAIN}, '{WHITE}', ' ', 'g'))) AS h FROM documents")
def normalize_space(spark, sf_dir):
    """F1"""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize(F.col("text")).cast("binary")).alias("h"))


@register("name_split", r"WITH n AS (SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey + 1000000000, 'Dr ' || replace(s_name, '#', ' ') FROM supplier), w AS (SELECT key, regexp_extract_all(name, '\S+') AS w FROM n) SELECT key, array_to_string(w[1:len(w) - 1], ' ') AS first, coalesce(w[-1], '') AS last FROM w")
def name_split(spark, sf_dir):
    """F30, X1"""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    n = c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).unionByName(s.select((F.col("s_suppkey") + 1000000000).alias("key"), F.concat(F.lit("Dr "), F.replace("s_name", F.lit("#"), F.lit(" "))).alias("name")))
    return n.withColumn("n", names.split_name(F.col("name"))).select("key", "n.first", "n.last")


@register("garbled_predicate", r"""SELECT doc_id, list_has_any(string_split_regex(lower(t), '[^\p{L}]+'), ['isbn', 'press', 'presses', 'university', 'publisher', 'publishers', 'verlag', 'edition', 'editions', 'pp', 'pages', 'dollar', 'dollars', 'rs', 'hardcover', 'paperback', 'hbk', 'pbk'])
    OR regexp_matches(t, '[0-9]') OR length(t) > 25 OR t IN ('Approaches', 'Alternative', 'Blackwell', 'Thought', 'rapports', 'pages', 'Press', 'Club', 'Allegory', 'Hegel') AS garbled FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def garbled_predicate(spark, sf_dir):
    """P24, P25 on whole texts"""
    return table(spark, sf_dir, "documents").select("doc_id", names.is_garbled(F.lit(""), F.col("text")).alias("garbled"))


@register("json_props", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    """F62"""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@register("html_links", r"""SELECT page_id, (u.i - 1)::INT AS pos, l[u.i] AS href FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS l FROM pages), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) u""")
def html_links(spark, sf_dir):
    """SC11, G4"""
    return landed.links(table(spark, sf_dir, "pages"))


@register("html_blocks", r"""SELECT page_id, (u.i - 1)::INT AS pos, md5(l[u.i]) AS h FROM (SELECT page_id, regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1) AS l FROM pages), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) u""")
def html_blocks(spark, sf_dir):
    """G4, SC14-SC18"""
    return landed.blocks(table(spark, sf_dir, "pages"), "p").select("page_id", "pos", F.md5(F.col("block").cast("binary")).alias("h"))


@register("html_page_record")
def html_page_record(spark, sf_dir):
    """SC13, F4: title with its references decoded, and the length of the article's text"""
    page = table(spark, sf_dir, "pages")
    title = text.html_unescape(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    body = text.squeeze(text.strip_tags(F.regexp_extract("html", r"(?is)<article>(.*?)(?:</article>|<footer|$)", 1)))
    return page.select("page_id", title.alias("title"), F.length(body).alias("text_len"))


@register("page_metadata")
def page_metadata(spark, sf_dir):
    """SC26, F63"""
    return landed.page_metadata(table(spark, sf_dir, "pages"))


TITLES = ["Julian Reiss's Philosophy of economics: a contemporary introduction", 'Thomas Kelly, "Bias: A Philosophical Study"', "Greek Skepticism. by Charlotte L. Stough. (Berkeley: University of California Press, 1969)", "Climate Matters: Ethics in a Warming World, John Broome. Norton, 2012, 224 pages."]


@register("title_parse")
def title_parse(spark, sf_dir):
    """U1 over part names set in the forms of citations"""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", F.initcap("p_name").alias("t")))
    cited = F.element_at(F.array(F.concat(F.lit("Review of "), "t", F.lit(", by Jane Q. Doe")), F.concat(F.lit("<i>"), "t", F.lit("</i>. Philip J. Ivanhoe")), F.concat(F.lit("Book Review: "), "t", F.lit(". Thomas Nagel")), *(F.lit(x) for x in TITLES)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return part.select("p_partkey", parse_title(cited).alias("p")).select("p_partkey", "p.*")


@register("review_detect")
def review_detect(spark, sf_dir):
    """P14, P16-P18 over whole documents"""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", detect.is_review(t).alias("review"), detect.is_logic_review(t).alias("logic"), detect.is_indexed_review(t).alias("indexed"), detect.reads_as_review(t).alias("reads"))


@register("flags", r"SELECT p_partkey, concat_ws('; ', CASE WHEN length(trim(p_name)) < 3 THEN 'short title' END, CASE WHEN regexp_matches(p_brand, '\d') THEN 'digits in name' END) AS reason FROM part")
def flags(spark, sf_dir):
    """P32"""
    return table(spark, sf_dir, "part").select("p_partkey", detect.flags(F.col("p_name"), F.lit(""), F.col("p_brand")).alias("reason"))


@register("all_caps", r"SELECT doc_id, t = upper(t) AND length(t) > 10 AND regexp_matches(t, '\p{Lu}') AND NOT regexp_matches(t, '\p{Ll}') AS caps FROM (SELECT doc_id, text AS t FROM documents)")
def all_caps(spark, sf_dir):
    """P35 on whole texts"""
    return table(spark, sf_dir, "documents").select("doc_id", text.is_all_caps(F.col("text")).alias("caps"))


@register("blank_scan", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL OR CAST(l.quality AS VARCHAR) = ''")
def blank_scan(spark, sf_dir):
    """SC2, SC27, P40"""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").where(is_blank(F.col("quality").cast("string"))).select("doc_id")


@register("distinct_sources", "SELECT DISTINCT source FROM documents WHERE source <> ''")
def distinct_sources(spark, sf_dir):
    """SC25, A2"""
    return table(spark, sf_dir, "documents").where(~is_blank("source")).select("source").distinct()


@register("update_join", "SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' END, d.source) AS source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def update_join(spark, sf_dir):
    """SK3, J18"""
    change = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("k"), F.lit("toxic").alias("source"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("k"), "source")
    return upsert.update_by_key(d, change, "k", ("source",)).select("doc_id", "source")


@register("ratio_threshold", "SELECT conv_id, count(*) FILTER (role = 'user') AS hits, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user') >= greatest(2, 0.3 * count(*))")
def ratio_threshold(spark, sf_dir):
    """A18"""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("journal"), F.lit(0).alias("volume"), F.lit(0).alias("issue"), "role")
    return symposia.dense_issues(c, F.col("role") == "user").select(F.col("journal").alias("conv_id"), "hits", "n")


@register("symposium_groups", """
    WITH e AS (SELECT CAST(user_id AS VARCHAR) AS v, event_id AS p, event_type AS t FROM events WHERE user_id IS NOT NULL),
    s AS (SELECT v, p, row_number() OVER (PARTITION BY v ORDER BY p) AS k, ends FROM (SELECT *, count(*) FILTER (t = 'purchase') OVER (PARTITION BY v ORDER BY p) AS ends FROM e) WHERE t = 'signup'),
    m AS (SELECT v, p, k + max(ends + 1 - k) OVER (PARTITION BY v ORDER BY p) AS j FROM s),
    x AS (SELECT v, p AS hi, row_number() OVER (PARTITION BY v ORDER BY p) AS j FROM e WHERE t = 'purchase'),
    last AS (SELECT v, max(p) AS top FROM e GROUP BY 1),
    r AS (SELECT v, p AS lo, coalesce(hi, top) AS hi FROM m LEFT JOIN x USING (v, j) JOIN last USING (v) WHERE coalesce(hi, top) > p)
    SELECT 'J|' || v || '|1' AS symposium_group, CAST(p AS VARCHAR) AS doi, t AS event_type FROM e WHERE EXISTS (SELECT 1 FROM r WHERE r.v = e.v AND e.p BETWEEN r.lo AND r.hi)""")
def symposium_groups(spark, sf_dir):
    """Signups and purchases of a user as anchors, an end used once"""
    e = table(spark, sf_dir, "events")
    items = e.select(F.lit("J").alias("journal"), F.col("user_id").cast("string").alias("volume"), F.lit("1").alias("issue"), F.col("event_id").cast("string").alias("doi"), "event_type", F.lit("s").alias("surname"), F.col("event_id").cast("int").alias("start_page"), F.col("event_id").cast("int").alias("end_page"))
    return symposia.by_anchors(items, F.col("event_type") == "signup", F.col("event_type") == "purchase").select("symposium_group", "doi", "event_type")


@register("set_operations", "SELECT DISTINCT x FROM (SELECT o_custkey AS x FROM orders UNION SELECT c_custkey FROM customer) EXCEPT SELECT s_suppkey FROM supplier")
def set_operations(spark, sf_dir):
    """X1-X3"""
    o, c, s = (table(spark, sf_dir, t).select(F.col(k).alias("x")) for t, k in (("orders", "o_custkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey")))
    return o.union(c).distinct().join(s, "x", "left_anti")


@register("title_case")
def title_case(spark, sf_dir):
    """F7-F9 on part names in capitals"""
    t = F.concat(F.upper("p_name"), F.lit(": A STUDY OF THE UK, PART II"))
    return table(spark, sf_dir, "part").select("p_partkey", text.smart_title_case(t).alias("title"))


CITATION_TAILS = [
    ". Oxford University Press, 1999. Pp. xii + 240. $12.95", " (Berkeley: University of California Press, 1969)", ". Pp. xii + 30", ", 240 pages.", ". 1998.", ", London: Routledge, 1999", " ISBN 0-19-824", " £40",
    ". By Ann Lee, Professor of Logic at X",
]


@register("citation_tail", "SELECT p_partkey, p_name AS title FROM part")
def citation_tail(spark, sf_dir):
    """part names with nine kinds of tails, which leave the names"""
    tails = F.array(*(F.lit(t) for t in CITATION_TAILS))
    t = F.concat("p_name", F.element_at(tails, (F.col("p_partkey") % len(CITATION_TAILS) + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", text.strip_citation_tail(t).alias("title"))


@register("row_position", "SELECT conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS place, role FROM conversations")
def row_position(spark, sf_dir):
    """Places in groups of any size, no group in one task"""
    return upsert.place_in_group(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["role"], ["conv_id", "turn"])


@register("issue_lists", "SELECT 'c' || (o_custkey % 50) AS journal, o_orderpriority AS volume, o_orderstatus AS issue, count(*) AS n, min(o_orderkey) AS first_key, string_agg(o_orderkey, ',' ORDER BY o_orderdate, o_orderkey) AS keys FROM orders GROUP BY 1, 2, 3")
def issue_lists(spark, sf_dir):
    """Items of an issue in their order, joined again from the parts of its list"""
    o = table(spark, sf_dir, "orders")
    items = o.select(F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("journal"), F.col("o_orderpriority").alias("volume"), F.col("o_orderstatus").alias("issue"), F.col("o_orderdate").alias("start_page"), F.col("o_orderkey").alias("doi"))
    parts = symposia.issue_lists(items).select(*symposia.ISSUE, F.struct("part", F.col("items.doi").alias("keys")).alias("p"))
    whole = parts.groupBy(*symposia.ISSUE).agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["keys"])).alias("k"))
    return whole.select(*symposia.ISSUE, F.size("k").cast("long").alias("n"), F.array_min("k").alias("first_key"), F.array_join(F.transform("k", lambda x: x.cast("string")), ",").alias("keys"))


@register("not_in_list", "SELECT o_orderkey AS orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def not_in_list(spark, sf_dir):
    """J20"""
    listed = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    return upsert.not_in(table(spark, sf_dir, "orders"), "o_custkey", listed, "c_custkey").select(F.col("o_orderkey").alias("orderkey"))


@register("not_in_with_null", "SELECT o_orderkey AS orderkey FROM orders WHERE o_custkey NOT IN (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey END FROM customer)")
def not_in_with_null(spark, sf_dir):
    """J20 with nulls in the list: nothing is left"""
    listed = table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).alias("k"))
    return upsert.not_in(table(spark, sf_dir, "orders"), "o_custkey", listed, "k").select(F.col("o_orderkey").alias("orderkey"))


@register("merged_markers", "SELECT doi, arg_min(title, (list, start_page)) AS title FROM (SELECT 0 AS list, 'u' || user_id AS doi, event_type AS title, event_id AS start_page FROM events WHERE event_type = 'signup' UNION ALL SELECT 1, 'u' || user_id, event_type, event_id FROM events WHERE event_type = 'purchase') GROUP BY doi")
def merged_markers(spark, sf_dir):
    """J19"""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("doi"), F.col("event_type").alias("title"), F.col("event_id").alias("start_page"))
    return symposia.merged_markers(e.where("title = 'signup'"), e.where("title = 'purchase'")).select("doi", "title")


@register("first_n", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def first_n(spark, sf_dir):
    """O6, O7"""
    return browse.first_n(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "value"), 100, F.desc("value")).select(F.col("id").alias("event_id"), "value")


@register("headings", "SELECT p_name AS book_title, p_brand AS publication_source, '' AS doi FROM part WHERE p_partkey % 4 <> 0")
def headings(spark, sf_dir):
    """P2, P36"""
    part = table(spark, sf_dir, "part")
    return titled(from_headings(part.select(F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("Book Title"), F.col("p_brand").alias("Publication Source")))).select("book_title", "publication_source", "doi")


@register("function_words", r"SELECT doc_id, list_has_any(string_split_regex(lower(trim(text)), '\s+'), ['the', 'a', 'an', 'of', 'on', 'in', 'for', 'and', 'to', 'from', 'with', 'at', 'by', 'or', 'nor', 'but', 'is', 'are', 'was', 'not', 'no', 'its', 'their', 'our', 'all']) AS has FROM documents")
def function_words(spark, sf_dir):
    """X6 on whole texts"""
    return table(spark, sf_dir, "documents").select("doc_id", names.has_function_word(F.col("text")).alias("has"))


@register("generic_titles", "SELECT p_partkey, p_name FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'Book Reviews' ELSE p_name END AS p_name FROM part) WHERE lower(p_name) NOT IN ('book review', 'book reviews')")
def generic_titles(spark, sf_dir):
    """F27"""
    named = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 == 0, "Book Reviews").otherwise(F.col("p_name")).alias("p_name"))
    return named.where(~detect.is_generic(F.col("p_name")))


@register("stream_fresh_events", "SELECT event_id, user_id, event_type FROM events")
def stream_fresh_events(spark, sf_dir):
    """Streaming (survey section 2.13): events polled in micro-batches, each once, written and read again"""
    once = table(spark, sf_dir, "events")
    landed_events = spark.readStream.schema(once.schema).parquet(f"{sf_dir}/events*.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return incremental.drained(incremental.fresh_events(landed_events, "event_id", "ts")).select("event_id", "user_id", "event_type")


#: Older names of the same queries.
for name, older in (("garbled_predicate", "garbled_texts"), ("all_caps", "all_caps_texts"), ("function_words", "function_words_texts")):
    QUERIES[older], ORACLES[older] = QUERIES[name], ORACLES[name]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the catalog, filtered, sorted and cut."""
    return browse_page(spark, sf_dir)
