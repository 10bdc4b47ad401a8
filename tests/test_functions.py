from pyspark.sql import functions as F

from quire.functions import dates_urls, names, text
from quire.sources.landed import review_page


def values(spark, rows, f, schema="x string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(f(*(F.col(c) for c in df.columns)).alias("y")).collect()]


def test_names_of_the_reference_cases(spark):
    cases = {"Thomas Nagel": ("Thomas", "Nagel"), "A.W. Moore": ("A.W.", "Moore"), "Donald C. Ainslie": ("Donald C.", "Ainslie"), "Frisbee C. C. Sheffield": ("Frisbee C. C.", "Sheffield"), "Jean-Paul Sartre": ("Jean-Paul", "Sartre"), "Philip J. Ivanhoe": ("Philip J.", "Ivanhoe"), "Nagel": ("", "Nagel"), "": ("", "")}
    assert [tuple(v) for v in values(spark, list(cases), names.split_name)] == list(cases.values())
    assert tuple(values(spark, [None], names.split_name)[0]) == ("", "")


def test_author_strings(spark):
    cases = {"Thomas Nagel": ("Thomas", "Nagel", False, False), "Uriah Kriegel (ed.)": ("Uriah", "Kriegel", False, True), "Philip J. Ivanhoe and Hwa Yeong Wang": ("Philip J.", "Ivanhoe", True, False), "John Smith and Jane Doe (eds.)": ("John", "Smith", True, True), "Nagel, Thomas": ("Thomas", "Nagel", False, False), "Smith, John, Jr.": ("John", "Smith, Jr", False, False)}
    got = values(spark, list(cases), lambda c: F.struct(names.first_author(c).alias("a"), names.is_edited(c).alias("e")))
    assert [(g.a.first, g.a["last"], g.a.has_multiple, g.e) for g in got] == list(cases.values())


def test_reviewer_strings(spark):
    cases = {"A.W. Moore, University of Oxford": ("A.W.", "Moore", "University of Oxford", False), "Timothy O'Connor and Nickolas Montgomery, Indiana University": ("Timothy", "O'Connor", "Indiana University", True), "Frisbee C. C. Sheffield, King's College London": ("Frisbee C. C.", "Sheffield", "King's College London", False)}
    assert [tuple(v) for v in values(spark, list(cases), names.reviewer)] == list(cases.values())


def test_review_urls(spark):
    host = "https://ndpr.nd.edu"
    cases = {f"{host}/reviews/analytic-philosophy-and-human-life/": True, f"{host}/reviews/plato/": True, f"{host}/reviews/": False, f"{host}/reviews/archives/2025/": False, f"{host}/reviews/archives/2003/": False, f"{host}/about/": False, "": False}
    assert values(spark, list(cases), dates_urls.is_review_url) == list(cases.values())


def test_titles(spark):
    assert values(spark, ["4<sup>th</sup>Century", "a <i>b</i> c<sup>2</sup>"], text.strip_known_tags) == ["4th Century", "a b c"]
    assert values(spark, ["THE REPUBLIC OF PLATO: A STUDY IN WORLD WAR II"], text.smart_title_case) == ["The Republic of Plato: A Study in World War II"]
    assert values(spark, ["Book Review: On Liberty", "Book Review: Abc", "Plain"], text.strip_review_prefix) == ["On Liberty", "Book Review: Abc", "Plain"]
    assert values(spark, [", On Liberty", "...and then", ". A"], text.strip_leading_punctuation) == ["On Liberty", "...and then", "A"]
    assert values(spark, ["On Liberty. Oxford University Press, 1999", "Mind. Pp. xii + 30", "12"], text.strip_citation_tail) == ["On Liberty", "Mind", "12"]
    tailed = ["<i>The Civil War</i>. By Ann Lee, Professor at X", "A Book (Berkeley: University of California Press, 1969)", "The $100 Question: Essays", "Mind, 240 pages.", "Plato. 1998. £12.50", "Acts ISBN: 0-19-824", "(Oxford: Clarendon Press, 1990)", "Pp. and QQ", None]
    assert values(spark, tailed, text.strip_citation_tail) == ["The Civil War", "A Book", "The $100 Question: Essays", "Mind", "Plato", "Acts", "(Oxford: Clarendon Press, 1990)", "Pp. and QQ", None]
    assert values(spark, ["a b – “c”  d"], text.normalize) == ['a b - "c" d']
    assert values(spark, ["Tom &amp; J&eacute;r&ocirc;me,. "], text.unescape_name) == ["Tom & Jérôme"]
    assert values(spark, ["ALL CAPITALS HERE", "Not All Capitals", "SHORT"], text.is_all_caps) == [True, False, False]
    assert values(spark, ["  ", " a "], text.null_if_blank) == [None, " a "]
    assert values(spark, ["x" * 501, "y"], text.truncated) == ["x" * 500 + "...", "y"]


def test_similarity(spark):
    rows = [("On Liberty", "on liberty!"), ("Mind: A Study", "Mind"), ("Mind: A Study", "Mind: Essays"), ("Being and Time", "Time and Being"), ("Plato", "Kant"), ("", "x"), (None, "x")]
    got = values(spark, rows, text.title_similarity, "a string, b string")
    assert [round(g, 3) for g in got] == [1.0, round(0.95 * 4 / 12, 3), 0.8, 0.95, 0.0, 0.0, 0.0]


def test_repairs(spark):
    schema = "a string, b string"
    assert [tuple(v) for v in values(spark, [("RichardMenary", "(ed"), ("Ann", "Smith (eds.)"), ("", "Hilary Gatti (ed.)"), ("A", "B")], names.repaired_editor, schema)] == [("Richard", "Menary"), ("Ann", "Smith"), ("Hilary", "Gatti"), ("A", "B")]
    assert [tuple(v) for v in values(spark, [("Jarrett, James", "S."), ("Moore", "G.E"), ("John", "Jr."), ("A. B.", "C.")], names.repaired_swap, schema)] == [("James S.", "Jarrett"), ("G.E", "Moore"), ("John", "Jr."), ("A. B.", "C.")]
    assert values(spark, [("Cambridge:", "Cambridge University Press"), ("Sara", "Brill"), ("", "Routledge")], names.is_publisher, schema) == [True, False, True]
    assert values(spark, [("", "ISBN 978-0"), ("Ann", "Lee"), ("", ""), ("x;y", "Lee"), ("Ann", "Press")], names.is_garbled, schema) == [True, False, False, True, True]
    assert values(spark, ["Smith Jr.", "de la Cruz", "Lewis III", ""], names.surname_key) == ["smith", "cruz", "lewis", ""]
    assert values(spark, ["Thomas Nagel", "the nature of things", "J. Value", "a b c d e f g"], names.looks_like_name) == [True, False, True, False]


def test_dates_and_urls(spark):
    assert values(spark, [([2020, 3, 4],), ([2020],), ([0],), (None,)], dates_urls.date_of_parts, "x array<int>") == ["2020-03-04", "2020-01-01", "", ""]
    assert values(spark, ["2025-fall", "2024-winter", "x"], dates_urls.date_of_season) == ["2025-09-01", "2024-01-01", ""]
    assert values(spark, ["RP 2.20 (Winter 2026)", "July 1999", "none"], dates_urls.date_of_issue) == ["2026-01-01", "1999-07-01", ""]
    assert values(spark, ["Jan 15, 2024 - x", "15 Jan 2024 x", "Feb 31, 2024", "no"], dates_urls.date_in_snippet) == ["2024-01-15", "2024-01-15", "", ""]
    assert values(spark, ["http://www.a.org/b/?q=1#x", "https://a.org"], dates_urls.normalize_url) == ["https://a.org/b", "https://a.org"]
    assert values(spark, ["https://www.A.org:80/b", "x"], dates_urls.domain) == ["a.org", ""]
    assert values(spark, ["12-20", "x", "7"], dates_urls.page_start) == [12, None, 7]
    assert values(spark, ["12-20", "x", "7"], dates_urls.page_end) == [20, None, 7]
    assert values(spark, ['```{"a": {"b": "}"}} tail', "none", None], dates_urls.balanced_json) == ['{"a": {"b": "}"}}', None, None]
    assert values(spark, ['{"author": [{"name": "A B"}]}', '{"@graph": [{"x": 1}, {"author": "C"}]}', "["], dates_urls.linked_data_author) == ["A B", "C", None]
    assert values(spark, ["see doi:10.1000/ab.c. Next"], dates_urls.clean_doi) == ["10.1000/ab.c"]


PAGE = """<div class="meta-item__bibliography">Uriah Kriegel (ed.), <em>Current Controversies</em>, Routledge, 2014</div>
<p class="meta-item__reviewer">Timothy O'Connor and Nickolas Montgomery, Indiana University</p><meta property="datePublished" content="2014-05-01T10:00:00">
<p class="meta-item__edition">2014.05.01</p><div class="article-content">A good   book.</div>"""


def test_review_page(spark):
    got = values(spark, [PAGE, "<html></html>"], review_page)
    assert (got[0].title, got[0].author_last, got[0].is_edited, got[0].reviewer_last, got[0].has_multiple_reviewers, got[0].published, got[0].summary) == ("Current Controversies", "Kriegel", True, "O'Connor", True, "2014-05-01", "A good book.")
    assert got[1] is None
