"""More catalog operators as queries: functions of text, names and dates over citations made from part names.

A query's rows are the parts; each is set into one of some hard cases, `{}` being its name, so
that every branch of a function has rows. The SQL has the same cases.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import dates_urls, names, text
from quire.operators import detect
from quire.queries import register, table


def case_of(cases: list[str]) -> Column:
    chosen = F.element_at(F.array(*(F.lit(c) for c in cases)), (F.col("p_partkey") % len(cases) + 1).cast("int"))
    return F.replace(chosen, F.lit("{}"), F.col("p_name"))


def sql_case(cases: list[str]) -> str:
    quoted = ", ".join("'" + c.replace("'", "''") + "'" for c in cases)
    return f"replace(([{quoted}])[(p_partkey % {len(cases)} + 1)::INT], '{{}}', p_name)"


def words_sql(c: str) -> str:
    return f"list_filter(string_split_regex(trim({c}), '\\s+'), lambda w: w <> '')"


TITLES = [
    "Book Review: {}", "book review - {}", "Book Review: ab", "{}", "...{}", ", {}", ". ,{}", "The {}", "4<sup>th</sup>Century {}", "4<sup>TH</sup> day of <i>{}</i>", '<b class="x">{}</b><sup>12</sup>', "  ",
    "{}, ", "{},,", "The the {}", "<jats:p>{}</jats:p>", "<unknown>{}</unknown>", ",", "Book  Review:{}",
]


@register("tidy_titles", rf"""WITH c AS (SELECT p_partkey, {sql_case(TITLES)} AS t FROM part), r AS (SELECT *, trim(regexp_replace(t, '(?i)^book\s+review\s*[-:]\s*', '')) AS rest, rtrim(regexp_replace(t, '[,\s]+$', '')) AS bare FROM c)
    SELECT p_partkey, CASE WHEN length(rest) > 3 THEN rest ELSE t END AS no_prefix, CASE WHEN starts_with(t, '...') THEN t WHEN regexp_matches(t, '^\s*[,.]') THEN regexp_replace(t, '^[\s,.]+', '') ELSE t END AS no_lead,
      trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i:<sup>(st|nd|rd|th)</sup>)([A-Z])', '\1 \2', 'g'), '(?i)<sup>(st|nd|rd|th)</sup>', '\1', 'g'), '<sup>\d+</sup>', '', 'g'), '(?i)</?(?:{text.KNOWN_TAGS})(?:\s[^>]*)?>', '', 'g')) AS no_tags,
      regexp_replace(t, '^The ', '') AS no_article, regexp_replace(t, '(?i)^the ', '') AS sort_name, CASE WHEN trim(t) <> '' THEN t END AS or_null, CASE WHEN regexp_matches(t, ',\s*$') AND bare <> '' THEN bare ELSE t END AS no_commas FROM r""")
def tidy_titles(spark, sf_dir):
    """F6, F8, F9, F12, F16, F18"""
    t = F.col("t")
    return table(spark, sf_dir, "part").select("p_partkey", case_of(TITLES).alias("t")).select(
        "p_partkey", text.strip_review_prefix(t).alias("no_prefix"), text.strip_leading_punctuation(t).alias("no_lead"), text.strip_known_tags(t).alias("no_tags"), text.without_article(t).alias("no_article"),
        text.without_article(t, ignore_case=True).alias("sort_name"), text.null_if_blank(t).alias("or_null"), text.strip_trailing_commas(t).alias("no_commas"),
    )


AUTHORS = [
    "Jane Q. {}", "{}, Jane", "Jane Doe and John {}", "Smith, John, Jr.", "Uriah Kriegel (ed.)", "John Smith and Jane Doe (eds.)", "A. B. Cee, D. E. Eff, and G. Aitch", "", "Plato", "Doe, Jane; Roe, Rick",
    "Philip J. Ivanhoe and Hwa Yeong Wang", "J. Doe, trans.", "Davis, Sammy, Jr. and Roe, R.",
]


@register("first_authors", rf"""WITH a AS (SELECT p_partkey, {sql_case(AUTHORS)} AS t FROM part),
    b AS (SELECT p_partkey, t, trim(regexp_replace(regexp_replace(replace(t, ';', ','), '(?i),?\s*\(?\b(?:eds?|trans|translator|editor)\b\.?\)?', '', 'g'), '[,.\s]+$', '')) AS x FROM a),
    c AS (SELECT *, regexp_extract(x, '(?i),\s*((?:Jr|Sr)\.?)\s*(?:$|,| and )', 1) AS suffix FROM b),
    d AS (SELECT *, contains(lower(x), ' and ') OR len(string_split(x, ',')) - 1 - (suffix <> '')::INT > 1 AS several FROM c),
    e AS (SELECT *, trim(regexp_replace(CASE WHEN several THEN string_split_regex(x, '(?i)\s+and\s+')[1] ELSE x END, '[,\s]+$', '')) AS head FROM d),
    f AS (SELECT *, trim(split_part(head, ',', 1)) AS one, trim(split_part(head, ',', 2)) AS two, len(string_split(head, ',')) AS parts, {words_sql("head")} AS w FROM e),
    g AS (SELECT *, {words_sql("one")} AS v, several AND parts > 2 AND contains(one, ' ') AS listed FROM f)
    SELECT p_partkey, CASE WHEN listed THEN array_to_string(v[1:len(v) - 1], ' ') WHEN parts > 1 THEN two ELSE coalesce(array_to_string(w[1:len(w) - 1], ' '), '') END AS first,
      coalesce(CASE WHEN listed THEN v[-1] WHEN NOT several AND suffix <> '' AND parts > 2 THEN one || ', ' || suffix WHEN parts > 1 THEN one ELSE w[-1] END, '') AS last, several AS has_multiple,
      regexp_matches(t, '(?i)\(\s*eds?\.?\s*\)|\beds?\.|\bedited\b') AS edited FROM g""")
def first_authors(spark, sf_dir):
    """F31-F34, P39, U3"""
    rows = table(spark, sf_dir, "part").select("p_partkey", case_of(AUTHORS).alias("t"))
    return rows.select("p_partkey", names.first_author(F.col("t")).alias("a"), names.is_edited(F.col("t")).alias("edited")).select("p_partkey", "a.*", "edited")


PERSONS = [
    "A.W. Moore, University of Oxford", "Timothy O'Connor and Nickolas Montgomery, Indiana University", "Frisbee C. C. Sheffield, King's College London", "{}", "", "Martin Luther King Jr.", "John Smith, III", "de la Cruz", "Sammy Davis, Jr",
    "By Jane Doe", "Reviewed by John Q. Public | Books", "https://example.org", "Jane Doe, Ph.D.", "John Roe, MD", "Jane Doe, edited by R. Roe", "Jane Doe, and ", "Reviewed By Jane Q. Doe in May", "by John",
]


@register("persons", rf"""WITH a AS (SELECT p_partkey, {sql_case(PERSONS)} AS t FROM part),
    b AS (SELECT p_partkey, t, split_part(t, ',', 1) AS people, regexp_replace(t, ',?\s*\b(?:Ph\.?D|M\.?D|M\.?A|B\.?A|J\.?D|D\.?Phil|M\.?Phil|Th\.?D)\b\.?', '', 'g') AS plain,
      trim(regexp_replace(regexp_replace(regexp_replace(t, '(?i)^\s*(?:reviewed\s+)?by\s+', ''), '(?i)\s*(?:\||[-–—]\s|,\s*(?:the\s|special to)|\s+for\s+the\s).*$', ''), '\s+', ' ', 'g')) AS byline,
      regexp_extract(t, '[Bb]y\s+([A-Z][a-zA-Z''-]+(?:\s+[A-Z]\.?)?(?:\s+[A-Z][a-zA-Z''-]+)+)', 1) AS told FROM a),
    c AS (SELECT *, {words_sql("string_split_regex(people, '(?i)\\s+and\\s+')[1]")} AS r, {words_sql("plain")} AS p, {words_sql("told")} AS s,
      list_filter({words_sql("t")}, lambda x: rtrim(lower(trim(x, ',')), '.') NOT IN ('jr', 'sr', 'ii', 'iii', 'iv')) AS k FROM b)
    SELECT p_partkey, array_to_string(r[1:len(r) - 1], ' ') AS reviewer_first, coalesce(r[-1], '') AS reviewer_last, trim(regexp_extract(t, '^[^,]*,(.*)$', 1)) AS affiliation, contains(lower(people), ' and ') AS several,
      coalesce(rtrim(lower(k[-1]), ','), '') AS surname, coalesce(p[-1], '') AS without_degree, CASE WHEN byline <> '' AND NOT regexp_matches(byline, '(?i)https?://|www\.|@|\d{{4}}') AND length(byline) <= 60 THEN byline END AS byline,
      CASE WHEN len(s) BETWEEN 2 AND 4 THEN s[-1] ELSE '' END AS in_snippet,
      trim(regexp_replace(regexp_replace(regexp_replace(t, '(?i),?\s*(?:translated|edited|trans\.|ed\.)\s+by\s.*$', ''), '(?i)[\s,]+(?:and)?[\s,]*$', ''), '\s+', ' ', 'g')) AS author FROM c""")
def persons(spark, sf_dir):
    """F35-F40"""
    t = F.col("t")
    rows = table(spark, sf_dir, "part").select("p_partkey", case_of(PERSONS).alias("t")).select("p_partkey", "t", names.reviewer(t).alias("r"))
    return rows.select(
        "p_partkey", F.col("r.first").alias("reviewer_first"), F.col("r.last").alias("reviewer_last"), "r.affiliation", F.col("r.has_multiple").alias("several"), names.surname_key(t).alias("surname"),
        names.without_degrees(t)["last"].alias("without_degree"), names.clean_byline(t).alias("byline"), names.reviewer_in_snippet(t)["last"].alias("in_snippet"), names.clean_author(t).alias("author"),
    )


DATED = [
    "2025-fall", "2024-Winter", "2023-autumn", "2022-none", "RP 2.20 (Winter 2026)", "RP 2.19 (Autumn 2025)", "Issue of March 1999", "vol. 3, Sept 2001", "no year", "Jan 15, 2024", "15 Jan 2024 - more", "Feb 30, 2024", "12-34", "7",
    "xii-20", "5-", "https://doi.org/10.1000/ab.{}", "see 10.12345/x(1)y, and", "10.12/short", "/article/view/123/4", "/article/99", "{}",
]
SEASON_SQL = "CASE " + " ".join(f"WHEN contains(lower(t), '{k}') THEN {m}" for k, m in [*dates_urls.SEASONS.items(), *((n, i + 1) for i, n in enumerate(dates_urls.MONTHS)), *((n[:3], i + 1) for i, n in enumerate(dates_urls.MONTHS))]) + " END"
MON = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"


@register("dates_and_places", rf"""WITH a AS (SELECT p_partkey, p_size, {sql_case(DATED)} AS t FROM part),
    b AS (SELECT *, lower(regexp_extract(t, '^\d{{4}}-([A-Za-z]+)', 1)) AS season, regexp_extract(t, '\b((?:19|20)\d{{2}})\b', 1) AS y, {SEASON_SQL} AS m,
      concat_ws(' ', regexp_extract(t, '^{MON}\s+(\d{{1,2}}),?\s+(\d{{4}})', 1), regexp_extract(t, '^{MON}\s+(\d{{1,2}}),?\s+(\d{{4}})', 2), regexp_extract(t, '^{MON}\s+(\d{{1,2}}),?\s+(\d{{4}})', 3)) AS s1,
      concat_ws(' ', regexp_extract(t, '^(\d{{1,2}})\s+{MON}\s+(\d{{4}})', 2), regexp_extract(t, '^(\d{{1,2}})\s+{MON}\s+(\d{{4}})', 1), regexp_extract(t, '^(\d{{1,2}})\s+{MON}\s+(\d{{4}})', 3)) AS s2,
      TRY_CAST(trim(split_part(t, '-', 1)) AS INT) AS p1, regexp_extract(t, '(10\.\d{{4,9}}/[^\s"<>]+?)[.,;)]*(?:\s|$)', 1) AS doi FROM a)
    SELECT p_partkey, CASE WHEN season IN ('winter', 'spring', 'summer', 'autumn', 'fall') THEN left(t, 4) || CASE season WHEN 'winter' THEN '-01-01' WHEN 'spring' THEN '-03-01' WHEN 'summer' THEN '-06-01' ELSE '-09-01' END ELSE '' END AS of_season,
      CASE WHEN y = '' THEN '' WHEN m IS NULL THEN y || '-01-01' ELSE y || '-' || lpad(m::VARCHAR, 2, '0') || '-01' END AS of_issue,
      coalesce(strftime(coalesce(try_strptime(s1, '%b %d %Y'), try_strptime(s2, '%b %d %Y')), '%Y-%m-%d'), '') AS in_snippet, p1 AS page_start, coalesce(CASE WHEN contains(t, '-') THEN TRY_CAST(trim(split_part(t, '-', 2)) AS INT) END, p1) AS page_end,
      doi, CASE WHEN doi <> '' THEN 'https://doi.org/' || doi ELSE '' END AS doi_url, regexp_extract(t, '/article/(?:view/)?(\d+)', 1) AS article,
      CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN (1900 + p_size)::VARCHAR || '-01-01' WHEN 2 THEN (1900 + p_size)::VARCHAR || '-' || lpad((p_size % 12 + 1)::VARCHAR, 2, '0') || '-01' ELSE (1900 + p_size)::VARCHAR || '-' || lpad((p_size % 12 + 1)::VARCHAR, 2, '0') || '-07' END AS of_parts,
      concat_ws('|', t, CASE WHEN p_size > 20 THEN p_size::VARCHAR ELSE '' END) AS issue_key FROM b""")
def dates_and_places(spark, sf_dir):
    """F50, F53-F55, F59-F61, F64"""
    t, n = F.col("t"), F.col("p_size")
    parts = F.slice(F.array(1900 + n, n % 12 + 1, F.lit(7)), F.lit(1), n % 4)
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", case_of(DATED).alias("t")).select(
        "p_partkey", dates_urls.date_of_season(t).alias("of_season"), dates_urls.date_of_issue(t).alias("of_issue"), dates_urls.date_in_snippet(t).alias("in_snippet"), dates_urls.page_start(t).alias("page_start"), dates_urls.page_end(t).alias("page_end"),
        dates_urls.clean_doi(t).alias("doi"), dates_urls.doi_url(dates_urls.clean_doi(t)).alias("doi_url"), dates_urls.article_id(t).alias("article"), dates_urls.date_of_parts(parts).alias("of_parts"), dates_urls.issue_key(t, F.when(n > 20, n)).alias("issue_key"),
    )


URLS = [
    "https://ndpr.nd.edu/reviews/{}/", "https://ndpr.nd.edu/reviews/", "https://ndpr.nd.edu/reviews/archives/2025/", "https://ndpr.nd.edu/about/", "", "https://x.org/reviews/rss", "https://x.org/reviews/ab", "https://x.org/authors/{}?a=1",
    "https://x.org/highereducation", "https://x.org/tags/a#b", "https://x.org/Obituaries/{}", "https://x.org/a/b", "https://x.org/paper/v32/n07/jane-q-doe/title", "https://x.org/paper/v32/n07/doe/title", "https://x.org/lives/1921-2004",
]


@register("url_predicates", rf"""WITH a AS (SELECT p_partkey, p_name, p_type, {sql_case(URLS)} AS t FROM part),
    b AS (SELECT *, regexp_replace(t, '/+$', '') AS path, lower(regexp_replace(regexp_replace(t, '^[a-z]+://[^/?#]*', ''), '[?#].*$', '')) AS inner_path, regexp_extract(t, '/v\d+/n\d+/([a-z][\w.-]+)/', 1) AS slug FROM a)
    SELECT p_partkey, contains(path, '/reviews/') AND NOT contains(path, '/archives/') AND length(string_split(path, '/')[-1]) >= 3 AND string_split(path, '/')[-1] NOT IN ('admin', 'login', 'search', 'contact', 'about', 'rss', 'feed') AS review,
      regexp_matches(inner_path, '/(?:authors|contributors?|author|topics|tags|category|series|obituaries|obituary)/|/highereducation') AS other, regexp_matches(lower(p_name || ' ' || t), 'obituar(?:y|ies)|dies at|died|19(?:[234]\d|50)-') AS obituary,
      CASE WHEN len(string_split(slug, '-')) BETWEEN 2 AND 4 THEN upper(string_split(slug, '-')[-1][1]) || string_split(slug, '-')[-1][2:] ELSE '' END AS reviewer,
      left(concat_ws(' ', '"' || p_name || '"', p_type, 'review'), 20) AS search, concat_ws(chr(10), CASE WHEN p_name <> '' THEN 'Title: ' || p_name END, CASE WHEN t <> '' THEN 'Abstract: ' || left(t, 200) END, CASE WHEN p_type <> '' THEN 'Journal: ' || p_type END) AS prompt FROM b""")
def url_predicates(spark, sf_dir):
    """P19, P20, F40, F65, F66"""
    t = F.col("t")
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", case_of(URLS).alias("t")).select(
        "p_partkey", dates_urls.is_review_url(t).alias("review"), dates_urls.is_other_page(t).alias("other"), dates_urls.is_obituary(F.col("p_name"), t).alias("obituary"), names.reviewer_in_url(t)["last"].alias("reviewer"),
        dates_urls.search_text(F.col("p_name"), F.col("p_type"), 20).alias("search"), dates_urls.classifier_prompt(F.col("p_name"), t, F.col("p_type")).alias("prompt"),
    )


NOISE = [
    "{}", "Errata to {}", "Fe de erratas", "Book Notes", "Booknotes 12", "In Memoriam", "Corrigendum: {}", "Fall 1967 through May", "Books Received", "Other Books of Interest", "Note on {}", "The full issue", "Reviews", "Book Review", "{} ISBN 123", "A Book, 240 pages",
    "Reply to {}", "Précis of {}", "Front Matter", "<i>{}</i>. Doe", "Book Review: {}", "Smith, <i>{}</i>", "Erratum", "Recent Publications", "", "Author Responses",
]
PATTERNS_SQL = " OR ".join(f"(t ILIKE '{p}'" + (f" AND j IN ({', '.join(repr(x) for x in js)})" if js else "") + ")" for p, js in ((p.replace("'", "''"), js) for p, js in detect.NON_REVIEWS))


@register("noise_predicates", rf"""WITH c AS (SELECT p_partkey, {sql_case(NOISE)} AS t, (['Philosophy', 'Ethics', 'Phronesis', 'Crítica', 'Hypatia'])[(p_partkey % 5 + 1)::INT] AS j, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS l, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN 'Of the Mind' ELSE 'Jane' END AS f FROM part),
    d AS (SELECT *, regexp_replace(t, '<[^>]+>', '', 'g') AS bare FROM c)
    SELECT p_partkey, (t ILIKE '%errata%' AND NOT t ILIKE '%de erratas%') OR (t ILIKE 'fe de erratas%' AND j ILIKE '%Cr_tica%') OR {PATTERNS_SQL} AS no_review, lower(t) IN ('book review', 'book reviews', 'reviews', 'review', 'book notes') AND l = '' AS placeholder,
      regexp_matches(t, '(?i)isbn|\bpp\.|\d+ pages|university press|\$\d|£\d|hardcover|paperback') AS metadata, (f = '' AND l <> '') OR regexp_matches(f, '(?i) (?:of|and|the|in|for|to|a|an|on|with|from|or|is|as) ') OR regexp_matches(l, '^.* .* .*$') AS suspect,
      regexp_matches(t, '(?i)ISBN|Press|University|Publisher|Verlag|pp|pages|978-|0-|Hardcover|Paperback') OR length(t) > 30 AS may_be_garbled, trim(lower(t)) IN ('other books of interest', 'books received') OR starts_with(trim(lower(t)), 'note on') OR contains(lower(t), 'full issue') AS skipped,
      regexp_matches(lower(bare), 'issue information|front matter|back matter|notes on contributors|book notes|book received|recent publications|critical notices|recent work|erratum|corrigendum|correction to:') OR starts_with(lower(bare), 'book review')
        OR (regexp_matches(t, '^<i>.+</i>\.\s+[A-Z]') AND NOT contains(lower(t), 'precis')) OR regexp_matches(t, '^[A-Z][a-z]+.*?,\s*<i>') AS no_symposium,
      regexp_matches(lower(bare), 'reply to|replies|response to|author response') AS reply, regexp_matches(lower(translate(t, 'éÉ', 'eE')), '\bprecis\b') AS precis, f <> '' AND lower(f) = lower(l) AND j <> 'Analysis' AS self_review FROM d""")
def noise_predicates(spark, sf_dir):
    """P22, P23, P26-P30, P34"""
    t, j, first, last = (F.col(c) for c in "tjfl")
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", case_of(NOISE).alias("t"), F.element_at(F.array(*(F.lit(x) for x in ("Philosophy", "Ethics", "Phronesis", "Crítica", "Hypatia"))), (key % 5 + 1).cast("int")).alias("j"),
        F.when(key % 3 == 0, "").otherwise(F.col("p_brand")).alias("l"), F.when(key % 4 == 0, "").when(key % 4 == 1, "Of the Mind").otherwise("Jane").alias("f"),
    )
    return rows.select(
        "p_partkey", detect.is_no_review(t, j).alias("no_review"), detect.is_placeholder(t, last).alias("placeholder"), detect.has_metadata(t).alias("metadata"), detect.is_suspect(first, last).alias("suspect"), detect.may_be_garbled(t).alias("may_be_garbled"),
        detect.is_skipped(t).alias("skipped"), detect.is_no_symposium(t).alias("no_symposium"), detect.is_reply(t).alias("reply"), detect.is_precis(t).alias("precis"), detect.is_self_review(first, last, j).alias("self_review"),
    )
