import random

import pytest
from pyspark.sql import functions as F

from quire.functions import names
from quire.operators import browse, classify, detect, matching, symposia, upsert, windows
from quire.operators.parse import list_rows, parse_title
from quire.plans import cleanup, ingest
from quire.schema import CATALOG, POST, WORK_ITEM, conform, from_headings, titled
from quire.streaming import incremental


def catalog(spark, rows):
    names = sorted({k for r in rows for k in r})
    kinds = {f.name: f.dataType.simpleString() for f in CATALOG}
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {kinds[n]}" for n in names))
    return conform(df)


def test_two_key_insert_keeps_chains_in_order(spark):
    rows = [(1, "d1", "u1"), (2, "d1", "u2"), (3, "d2", "u2"), (4, "", "u3"), (5, "", "u3"), (6, "", ""), (7, None, "")]
    df = spark.createDataFrame(rows, "seq long, doi string, review_link string")
    assert sorted(r.seq for r in upsert.settle_batch(df).collect()) == [1, 3, 4, 6, 7]


@pytest.mark.parametrize("seed", [1, 2])
def test_two_key_insert_against_sequential(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["", *(f"d{k}" for k in range(25))]), rng.choice(["", *(f"u{k}" for k in range(25))])) for i in range(150)]
    dois, links, want = set(), set(), []
    for seq, d, u in rows:
        if not (d and d in dois or u and u in links):
            want.append(seq)
            dois |= {d} - {""}
            links |= {u} - {""}
    df = spark.createDataFrame(rows, "seq long, doi string, review_link string").repartition(5)
    assert sorted(r.seq for r in upsert.settle_batch(df).collect()) == want


def test_long_chains_are_settled_in_few_rounds(spark, caplog):
    """100,000 rows, each with a key of the row before it and one of the row after it, but for some breaks; beside them a small tangle."""
    chain = spark.range(100_000).select(F.col("id").alias("seq"), F.expr("IF(id % 1009 = 5, '', 'd' || id div 2)").alias("doi"), F.expr("IF(id % 733 = 7, '', 'u' || (id + 1) div 2)").alias("review_link"))
    rng = random.Random(7)
    tangle = [(200_000 + i, f"x{rng.randrange(12)}", f"y{rng.randrange(12)}") for i in range(60)]
    seen, want = set(), set()
    for seq, d, u in [*((r.seq, r.doi, r.review_link) for r in chain.collect()), *tangle]:
        keys = {d, u} - {""}
        if not keys & seen:
            want.add(seq)
            seen |= keys
    with caplog.at_level("DEBUG", logger=upsert.__name__):
        got = {r.seq for r in upsert.settle_batch(chain.unionAll(spark.createDataFrame(tangle, chain.schema)).repartition(7)).collect()}
    assert got == want
    assert sum("round" in m for m in caplog.messages) <= 5


@pytest.mark.parametrize("seed", range(4))
def test_contracted_chains_against_sequential(spark, seed):
    """Few rows for each key: chains that split, meet and share both keys."""
    rng = random.Random(seed)
    rows = [(i, rng.choice(["", *(f"d{k}" for k in range(60))]), rng.choice(["", *(f"u{k}" for k in range(60))])) for i in range(130)]
    seen, want = set(), []
    for seq, d, u in rows:
        if not {d, u} & seen:
            want.append(seq)
            seen |= {d, u} - {""}
    assert sorted(r.seq for r in upsert.settle_batch(spark.createDataFrame(rows, "seq long, doi string, review_link string")).collect()) == want


def test_chains_are_written_few_times(spark, monkeypatch):
    """A chain of 20,000 rows with breaks: all checkpoints together hold less than four times its rows."""
    written, cut = [], upsert.cut
    monkeypatch.setattr(upsert, "cut", lambda df: [written.append((out := cut(df)).count()), out][1])
    chain = spark.range(20_000).select(F.col("id").alias("seq"), F.expr("IF(id % 89 = 5, '', 'd' || id div 2)").alias("doi"), F.expr("IF(id % 97 = 7, '', 'u' || (id + 1) div 2)").alias("review_link"))
    seen, want = set(), set()
    for r in chain.collect():
        if not {r.doi, r.review_link} - {""} & seen:
            want.add(r.seq)
            seen |= {r.doi, r.review_link} - {""}
    assert {r.seq for r in upsert.settle_batch(chain.repartition(5)).collect()} == want
    assert sum(written) < 80_000


@pytest.mark.parametrize("far", [1, 37, 499])
def test_chains_over_batches_against_sequential(spark, far):
    """Batches of five rows; the rows of a chain are `far` places from each other (modulo 997), so that links leave their batches."""
    rng = random.Random(far)
    rows = [(i * far % 997, "" if rng.random() < 0.02 else f"d{i // 2}", "" if rng.random() < 0.02 else f"u{(i + 1) // 2}") for i in range(600)]
    rows += [(1_000 + i, f"d{rng.randrange(400)}", f"u{rng.randrange(400)}") for i in range(200)]
    seen, want = set(), []
    for seq, d, u in sorted(rows):
        if not {d, u} & seen - {""}:
            want.append(seq)
            seen |= {d, u} - {""}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        assert sorted(r.seq for r in upsert.settle_batch(spark.createDataFrame(rows, "seq long, doi string, review_link string")).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_insert_again_changes_nothing(spark):
    base = catalog(spark, [{"id": 5, "doi": "d0", "review_link": "u0", "book_title": "A"}])
    batch = spark.createDataFrame([(1, "d0", "x", "B"), (2, "d1", "u1", "C"), (3, "", "u0", "D"), (4, "d1", "u9", "E")], "seq long, doi string, review_link string, book_title string")
    once = upsert.insert_or_ignore(base, batch)
    assert sorted((r.id, r.book_title) for r in once.collect()) == [(5, "A"), (6, "C")]
    assert upsert.insert_or_ignore(once, batch).count() == 2
    assert once.where("id = 6").first().entry_type == ""


@pytest.mark.parametrize("asked", [None, "id % 50 = 0"])
def test_peers_of_large_groups_are_dealt_over_tasks(spark, monkeypatch, asked):
    """400 rows of one group, some others, repeated and null ids: no task makes half of the pairs, and none is lost."""
    rows = [*((i, "a") for i in range(400)), *((i, "b") for i in range(390, 430)), (7, "a"), (None, "a"), (900, "c"), (901, ""), (902, None), (903, "d"), (904, "d")]
    view = spark.createDataFrame(rows, "id long, symposium_group string").coalesce(1)
    want = [(a, b) for a, g in rows if g and a is not None and (asked is None or a % 50 == 0) for b, h in rows if g == h and b is not None and a != b]
    monkeypatch.setattr(browse, "BLOCK", 20, raising=False)
    monkeypatch.setattr(browse, "PAIRS_A_TASK", len(want) // 16, raising=False)
    got = browse.peers(view, asked=asked and F.expr(asked)).select("id", "peer", F.spark_partition_id().alias("part")).collect()
    assert sorted((r.id, r.peer) for r in got) == sorted(want)
    made = {}
    for r in got:
        made[r.part] = made.get(r.part, 0) + 1
    assert max(made.values()) < len(want) / 2


def test_survivors(spark):
    same = {"book_title": "T", "publication_source": "S", "publication_date": "2020", "symposium_group": ""}
    rows = [{"id": 1, **same}, {"id": 2, **same, "doi": "d"}, {"id": 3, **same, "doi": "e"}, {"id": 4, **same, "publication_date": "2021"}, {"id": 5, **same, "publication_source": "P", "reviewer_last_name": "A"}, {"id": 6, **same, "publication_source": "P", "reviewer_last_name": "B"}]
    assert sorted(r.id for r in upsert.survivors(catalog(spark, rows)).collect()) == [2, 4, 5, 6]


def test_browse(spark):
    view = browse.serving_view(catalog(spark, [{"id": 1, "book_title": "On Mind", "publication_source": "The Mind", "publication_date": "2001-05-01", "doi": "10/x", "access_type": "Open"}, {"id": 2, "book_title": None, "publication_source": "Ethics", "publication_date": "n.d.", "entry_type": "symposium"}]))
    ids = lambda **k: [r.id for r in browse.CatalogQuery(sort="journal", descending=False, **k).run(view).collect()]
    assert ids() == [2, 1]
    assert ids(search="mind") == [1] and ids(access="open") == [1] and ids(year_from=2000) == [1] and ids(type="review") == [1] and ids(journals=()) == [] and ids(journals=("Ethics",)) == [2]
    assert view.where("id = 1").first().link == "https://doi.org/10/x"
    q = browse.CatalogQuery(search="a&b", journals=("X, Y", "Z"), year_from=1990, page=3)
    assert browse.CatalogQuery.from_params(q.to_params()) == q
    none = browse.CatalogQuery(journals=())
    assert browse.CatalogQuery.from_params(none.to_params()) == none
    assert q.active_filters() == 3 and browse.page_strip(5, 9) == [1, None, 3, 4, 5, 6, 7, None, 9]
    assert browse.CatalogQuery(page=9).clamped(view).page == 1


def test_parsing(spark):
    cases = {
        "Greek Skepticism. by Charlotte L. Stough. (Berkeley: University of California Press, 1969)": ("Greek Skepticism", "Stough"),
        "Climate Matters: Ethics in a Warming World, John Broome. Norton, 2012, 224 pages.": ("Climate Matters: Ethics in a Warming World", "Broome"),
        "Julian Reiss's Philosophy of economics: a contemporary introduction. Routledge, 2013": ("Philosophy of economics: a contemporary introduction", "Reiss"),
        'Thomas Kelly, "Bias: A Philosophical Study"': ("Bias: A Philosophical Study", "Kelly"),
        "Monica Mueller, Contrary to Thoughtlessness: Rethinking Practical Wisdom": ("Contrary to Thoughtlessness: Rethinking Practical Wisdom", "Mueller"),
        "Review of The Good Life, by Jane Doe": ("The Good Life", "Doe"),
        "Thomas Nagel, <i>The View from Nowhere</i>": ("The View from Nowhere", "Nagel"),
        "<i>The View from Nowhere</i>. Thomas Nagel": ("The View from Nowhere", "Nagel"),
        "Book Review: The Methods of Ethics. Henry Sidgwick": ("The Methods of Ethics", "Sidgwick"),
        "The Methods of Ethics by Henry Sidgwick (review)": ("The Methods of Ethics", "Sidgwick"),
        "Reasons and Persons (review)": ("Reasons and Persons", ""),
        "The Concept of Mind, edited by Julia Tanney": ("The Concept of Mind", "Tanney"),
        "Being and Time—Martin Heidegger": ("Being and Time", "Heidegger"),
        "Being and Time- Martin Heidegger (eds.)": ("Being and Time", "Heidegger"),
        "Self-Knowledge and Truth (review)": ("Self-Knowledge and Truth", ""),
        "Minds and Machines by Ann Lee and Bo Ek, eds.": ("Minds and Machines", "Lee"),
        "Ann Lee, Contrary to Thoughtlessness: Rethinking Wisdom. Lanham: Lexington, 2012": ("Contrary to Thoughtlessness: Rethinking Wisdom", "Lee"),
        "Ann Lee, Contrary to Thoughtlessness: Rethinking Wisdom (MIT Press), 200 pages": ("Contrary to Thoughtlessness: Rethinking Wisdom", "Lee"),
        "Ann Lee, Contrary to Thoughtlessness: Rethinking Wisdom. 240 pp. $30": ("Contrary to Thoughtlessness: Rethinking Wisdom", "Lee"),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select(parse_title(F.col("t")).alias("p"))
    assert [(r.p.book_title, r.p["last"]) for r in df.collect()] == list(cases.values())
    sub = spark.createDataFrame([("Minds at work", "Ann Lee: Thinking machines. Oxford: OUP, 2001")], "t string, s string").select(parse_title(F.col("t"), F.col("s")).alias("p")).first().p
    assert (sub.format, sub.book_title, sub["last"]) == ("SUB-A", "Thinking machines", "Lee")
    assert spark.range(1).select(parse_title(F.lit("Book Review")).alias("p")).first().p.format == "generic"


def test_sibling_parsers(spark):
    from quire.operators import parse

    cases = [
        (parse.LOGIC_FORMATS, "Review: Ann Lee, Proof and Truth", "Proof and Truth", "Lee"),
        (parse.LOGIC_FORMATS, "Ann B. Lee. Models and sets. Studies in logic. North-Holland Publishing, Amsterdam, 1980, xii + 200 pp.", "Models and sets", "Lee"),
        (parse.LOGIC_FORMATS, "Models and sets, edited by Bo Ek, Oxford University Press, 1980, 200 pp.", "Models and sets", "Ek"),
        (parse.MORAL_FORMATS, "Review of _Book Title_ by Author Name (Editor)", "Book Title", "Name"),
        (parse.MORAL_FORMATS, 'Review: "Book Title" by Author Name', "Book Title", "Name"),
        (parse.INDEX_FORMATS, "Book Title by Ann Lee. Cambridge: Cambridge University Press, 2001. pp.200", "Book Title", "Lee"),
        (parse.INDEX_FORMATS, "Just a Title", "Just a Title", ""),
        (parse.LOOKUP_FORMATS, "Book Review. The Nature of Perception John Foster", "The Nature of Perception", "Foster"),
        (parse.ETHICS_FORMATS, "Lee, Ann, ed. <i>On Duty</i>. Pp. 20", "On Duty", "Lee"),
        (parse.SUBTITLE_FORMATS, "Reivew of Ann Lee and Bo Ek, <em>On Duty</em> (London: Verso, 2010)", "On Duty", "Lee"),
        (parse.SUBTITLE_FORMATS, "<em>On Duty</em> (London: Verso, 2010)", "On Duty", ""),
    ]
    for formats, title, book, last in cases:
        p = spark.createDataFrame([(title,)], "t string").select(parse_title(F.col("t"), formats=formats).alias("p")).first().p
        assert (p.book_title, p["last"]) == (book, last), (title, p)


def test_small_predicates(spark):
    df = spark.createDataFrame([("", "Lee"), ("nature of the mind", "x"), ("Ann", "van der Lee"), ("Ann", "Lee"), (None, None)], "f string, l string")
    assert [r[0] for r in df.select(detect.is_suspect(F.col("f"), F.col("l"))).collect()] == [True, True, True, False, False]
    t = spark.createDataFrame([("Books Received",), ("Note on X",), ("Volume 2 full issue",), ("On Liberty",), (None,)], "t string")
    assert [r[0] for r in t.select(detect.is_skipped(F.col("t"))).collect()] == [True, True, True, False, False]


def test_detection(spark):
    yes = ["<i>The View from Nowhere</i>", "Review of Mind", "On Liberty by John Mill", "Smith, John. Some Book", "Ann Lee: Thinking Machines", "A Book. New York: X, 1990. 200 pp."]
    no = ["Reply to critics of <i>The View from Nowhere</i>", "The nature of <i>de re</i> belief", "Erratum", "Justice and its limits", None]
    got = spark.createDataFrame([(t,) for t in yes + no], "t string").select(detect.is_review(F.col("t")).alias("y")).collect()
    assert [r.y for r in got] == [True] * len(yes) + [False] * len(no)


FORMS = {
    "indicator": ["Kant (Review)", "A review of a book", "Reviewed work: X"],
    "prefix": ["Review: A Title"],
    "quoted": ['Smith, "A Long Enough Title"', "Jones, J. (ed.), ‘On Everything There Is’"],
    "bold": ["<b>Ann Lee</b>: Thinking", "<b>A Title of Fifteen Letters</b>"],
    "dot by": ["Thinking. By Ann Lee", "Thinking. by Ann Lee"],
    "by at the end": ["A Theory of Justice by John Rawls"],
}
LIKELY = {
    "genitive": ["Ann Lee's Thinking", "John B. Smith’s Mind"],
    "pages": ["Thinking, 240 pp", "Thinking, 240pp.", "xii+ 30 PP., $4"],
    "surname first": ["Rawls, John Political Liberalism"],
    "comma by": ["Thinking, by Ann Lee"],
    "edited": ["Ann Lee, ed. Essays", "Ann Lee and Bo Ek, eds. Essays"],
    "name: title": ["Ann Lee: Thinking"],
    "name. title": ["Ann Lee. Thinking Again"],
}
OTHERS = ["Editorial: Review of the Year", "Justice and its limits", "Stand by me", "Nature, Nurture and Us", "the 240 ppl we met", "Thinking: A Study", "On What Matters. A reply", "Smith, 'short'", "<b>Lee</b>: x", "It's fine", "", "A Theory, by and large"]


def test_forms_of_review_titles(spark):
    rows = [(t, True, True) for ts in FORMS.values() for t in ts] + [(t, True, False) for ts in LIKELY.values() for t in ts] + [(t, False, False) for t in OTHERS]
    got = spark.createDataFrame([(t,) for t, _, _ in rows], "t string").select("t", detect.is_review(F.col("t")).alias("a"), detect.is_review(F.col("t"), "italic_only").alias("b")).collect()
    assert [tuple(r) for r in got if tuple(r) not in rows] == []


def test_publishers_and_matter_in_names(spark):
    publishers = [("Oxford", "University Press"), ("", "Routledge"), ("London:", "Verso"), ("New York: Harper", "x"), ("Springer, 2003", ""), ("Macmillan", "pp. 12"), ("1999", "Some University")]
    persons = [("Ann", "Lee"), ("Susan", "Oxford"), ("", "Wiley Smith"), ("Bo", "Press"), (None, None)]
    garbled = [("Ann", "ISBN 0-123"), ("x; y", "Lee"), ("", "$12"), ("A", "B2"), ("£3", "Lee"), ("Ann", "a surname that goes on and on"), ("Born 1950", "Lee"), ("Paperback", "Lee"), ("&amp; Ann", "Lee"), ("Jack", "Hegel")]
    clean = [("Ann", "Lee"), ("Jean-Luc", "O'Éa"), ("", ""), (None, "Pressman"), ("Edi", "Tion")]
    df = lambda rows: spark.createDataFrame(rows, "f string, l string")
    assert [r[0] for r in df(publishers + persons).select(names.is_publisher(F.col("f"), F.col("l"))).collect()] == [True] * len(publishers) + [False] * len(persons)
    assert [r[0] for r in df(garbled + clean).select(names.is_garbled(F.col("f"), F.col("l"))).collect()] == [True] * len(garbled) + [False] * len(clean)


def test_list_items(spark):
    html = '<ul><li><a href="http://x/1"><i>On Mind</i></a> by Ann Lee is reviewed by Bo Ek at Mind and at Noûs.</li><li>Cy Dee reviews <i>B</i> by E Fox, at Ethics.</li></ul>'
    posts = spark.createDataFrame([(1, "2020-01-01", "s", "l", (html,))], POST)
    got = sorted((r.book_title, r.author, r.reviewer, r.venue) for r in list_rows(posts).collect())
    assert got == [("B", "E Fox", "Cy Dee", "Ethics"), ("On Mind", "Ann Lee", "Bo Ek", "Mind"), ("On Mind", "Ann Lee", "Bo Ek", "Noûs")]


def items(spark, rows):
    return spark.createDataFrame([("J", "1", "2", *r) for r in rows], "journal string, volume string, issue string, doi string, title string, surname string, start_page int, end_page int")


def test_symposia(spark):
    rows = [("a", "Précis of <i>The Long Book Title</i>", "lee", 10, 14), ("b", "On Lee", "ek", 15, 20), ("c", "Reply to Ek", "lee", 21, 25), ("d", "Other paper", "fox", 30, 40), ("e", "Book reviews", "gee", 50, 60), ("f", "Way off", "hay", 200, 210)]
    df = items(spark, rows)
    found = symposia.by_markers(df)
    assert sorted(r.doi for r in found.collect()) == ["a", "b", "c"]
    assert symposia.inferred_title(found).first().book_title == "The Long Book Title"
    anchors = symposia.by_anchors(df, detect.is_precis(F.col("title")), detect.is_reply(F.col("title")))
    assert sorted(r.doi for r in anchors.collect()) == ["a", "b", "c"]
    once = [("s1", "start", "lee", 1, 2), ("s2", "start", "lee", 5, 6), ("e1", "end", "lee", 8, 9)]
    kinds = items(spark, once).withColumn("kind", F.col("title"))
    assert [(r.range_start, r.range_end) for r in symposia.greedy_pairs(kinds, symposia.ISSUE).collect()] == [(1, 9)]


def test_items_meet_the_markers_of_two_bands_only(spark):
    pages = items(spark, [(f"d{n}", "Précis" if n % 50 == 0 else "x", "lee", n, n) for n in range(1, 3001)])
    markers = pages.where("title = 'Précis'").select(*symposia.ISSUE, F.col("doi").alias("marker"), F.col("start_page").alias("marker_page"))
    met = symposia.near_markers(pages, markers, 10, 80)
    near = (F.col("start_page") >= F.col("marker_page") - 10) & (F.col("start_page") <= F.col("marker_page") + 80)
    assert met.where(near).count() == pages.crossJoin(markers.drop(*symposia.ISSUE)).where(near).count()
    assert met.count() < 3000 * 60 / 15  # all pairs of the issue: 3,000 x 60


def test_matching(spark):
    records = spark.createDataFrame([(1, "Thinking Machines: A Study", 2001), (2, "Unknown Thing", 1990)], "record long, title string, year int")
    works = spark.createDataFrame([(10, "Thinking machines", 2000, 0, "Ann Lee"), (11, "Thinking Machines: A Study", 2001, 1, "Bo Ek")], "work long, title string, year int, rank int, author string")
    assert [(r.record, r.work, r.name["last"]) for r in matching.best_work(records, works).collect()] == [(1, 11, "Ek")]
    assert [(r.record, r.work) for r in matching.best_book(records, works).collect()] == [(1, 10)]
    reviews = spark.createDataFrame([("u1", "Thinking Machines by Ann van Lee: review"), ("u2", "Lee in the news")], "url string, headline string")
    books = spark.createDataFrame([("k1", "Thinking Machines", "van Lee"), ("k2", "Other Things", "Lee")], "key string, title string, last string")
    assert [(r.url, r.key) for r in matching.headline_matches(reviews, books).collect()] == [("u1", "k1")]


def test_blocks_lose_no_similar_title(spark):
    from quire.functions.text import title_similarity

    rng = random.Random(3)
    words = ["mind", "world", "the", "of", "reason", "truth", "being", "time", "self", "law"]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) + (": " + " ".join(rng.choice(words) for _ in range(3)) if rng.random() < 0.4 else "") for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(titles)), "record long, title string")
    other = df.select(F.col("record").alias("work"), "title")
    every = df.withColumnRenamed("title", "a").crossJoin(other.withColumnRenamed("title", "b")).where(title_similarity(F.col("a"), F.col("b")) >= 0.5)
    assert {(r.record, r.work) for r in matching.similar_titles(df, other).collect()} == {(r.record, r.work) for r in every.collect()}


def test_windows_and_pairs(spark):
    df = spark.createDataFrame([("p", 1, "2001"), ("p", 2, None), ("p", 3, "2002"), ("p", 4, None)], "g string, n int, head string")
    assert [r.year for r in windows.carry_forward(df, F.col("head"), "year", ["g"], ["n"]).orderBy("n").collect()] == ["2001", "2001", "2002", "2002"]
    assert [r.n for r in windows.until_first(df, F.col("head") == "2002", ["g"], ["n"]).orderBy("n").collect()] == [1, 2, 3]
    z = spark.createDataFrame([([1, 2], ["a", "b"])], "q array<int>, r array<string>")
    assert [(r.place, r.request, r.response) for r in matching.zipped(z, "q", "r").collect()] == [(0, 1, "a"), (1, 2, "b")]


def test_cleanup(spark):
    rows = [
        {"id": 1, "book_title": "Books Received", "publication_source": "X"}, {"id": 2, "book_title": "Book Review", "publication_source": "X"}, {"id": 3, "book_title": "Book Review: THE STRUCTURE OF THINGS", "publication_source": "Boston Globe", "book_author_last_name": "Smith (ed.)", "book_author_first_name": "Ann"},
        {"id": 4, "book_title": "Tom &amp; <i>Jerry</i>", "publication_source": "Philosophy &amp; Life", "access_type": "Open", "book_author_first_name": "Cambridge:", "book_author_last_name": "Cambridge University Press"},
    ]
    before = catalog(spark, rows)
    after = {r.id: r for r in cleanup.run(before).collect()}
    assert sorted(after) == [3, 4]
    assert (after[3].book_title, after[3].publication_source, after[3].book_author_last_name, after[3].entry_type) == ("The Structure of Things", "The Boston Globe", "Smith", "review")
    assert (after[4].book_title, after[4].publication_source, after[4].access_type, after[4].book_author_last_name) == ("Tom & Jerry", "Philosophy & Life", "open", None)
    seen = cleanup.preview(before, last="placeholders").collect()
    assert {(r.id, r.column) for r in seen} == {(1, None), (2, None)}


def test_classify(spark):
    cat = catalog(spark, [{"id": 1, "publication_source": "Ethics", "book_title": "x"}, {"id": 2, "publication_source": "Y", "book_title": "A study of mind"}, {"id": 3, "publication_source": "Ethics", "subfield_primary": "logic"}])
    journals = spark.createDataFrame([("Ethics", "ethics", "political")], "publication_source string, primary string, secondary string")
    got = {r.id: (r.subfield_primary, r.subfield_secondary) for r in classify.classify(cat, journals).collect()}
    assert got == {1: ("ethics", "political"), 2: ("mind", None), 3: ("logic", None)}
    replies = spark.createDataFrame([(1, 'Sure: {"primary": "mind", "secondary": "zzz"}')], "id long, reply string")
    assert tuple(classify.answers(replies, ["mind"]).first()) == (1, "mind", None)


def work(doi, title, family, page="1-2", **more):
    return {"title": [title], "DOI": doi, "container-title": ["J"], "author": [{"given": "R", "family": family}], "issued": {"date-parts": [[2020, 5]]}, "URL": f"http://x/{doi}", "volume": "1", "issue": "1", "page": page, **more}


def test_incremental_replay(spark, tmp_path):
    import json

    landed = tmp_path / "landed"
    landed.mkdir()
    (landed / "a.json").write_text("\n".join(json.dumps(w) for w in [work("d1", "Review of The Good Life, by Jane Doe", "Ek"), work("d2", "Erratum", "Ek"), work("d1", "Review of Again, by Jane Doe", "Ek")]))
    step = lambda cat, new: ingest.ingest(cat, new)
    args = (spark, str(landed), str(tmp_path / "root"))
    n = incremental.follow(*args, str(tmp_path / "check"), step)
    cat = incremental.latest(spark, str(tmp_path / "root"), n + 1)
    assert [(r.book_title, r.book_author_last_name, r.publication_date) for r in cat.collect()] == [("The Good Life", "Doe", "2020-05-01")]
    (landed / "b.json").write_text(json.dumps(work("d1", "Review of The Good Life, by Jane Doe", "Ek")) + "\n" + json.dumps(work("d3", "Review of New Things, by Al Bo", "Ek")))
    n = incremental.follow(*args, str(tmp_path / "check"), step)
    assert sorted(r.doi for r in incremental.latest(spark, str(tmp_path / "root"), n + 1).collect()) == ["d1", "d3"]
    # the same files again, with no memory of having read them, change nothing
    n2 = incremental.follow(spark, str(landed), str(tmp_path / "root2"), str(tmp_path / "check2"), step)
    assert sorted(r.doi for r in incremental.latest(spark, str(tmp_path / "root2"), n2 + 1).collect()) == ["d1", "d3"]


def test_events_are_taken_once(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-01 02:00:00")], "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = incremental.fresh_events(stream, "event_id", "ts").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT * FROM once").count() == 2


def test_schema_reads_items(spark):
    assert WORK_ITEM["container-title"].dataType.simpleString() == "array<string>"


def test_places_in_groups(spark):
    rows = [(g, i) for g in ("a", None, "b") for i in range(40 if g == "a" else 3)]
    df = spark.createDataFrame(rows, "g string, i int").repartition(7)
    assert sorted((r.g or "", r.i, r.place) for r in upsert.place_in_group(df, ["g"], ["i"]).collect()) == sorted((g or "", i, i + 1) for g, i in rows)
    assert upsert.place_in_group(df.where("false"), ["g"], ["i"]).count() == 0


def test_not_in_as_sql(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    listed = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    for values in ((), (1,), (1, None), (None,)):
        df.createOrReplaceTempView("outer_rows")
        listed(*values).createOrReplaceTempView("listed_rows")
        want = spark.sql("SELECT k FROM outer_rows WHERE k NOT IN (SELECT v FROM listed_rows)")
        key = lambda d: sorted(str(r.k) for r in d.collect())
        assert key(upsert.not_in(df, "k", listed(*values), "v")) == key(want)


def test_merged_markers_and_issue_lists(spark):
    kinds = "journal string, volume string, issue string, doi string, title string, start_page int"
    a = spark.createDataFrame([("J", "1", "2", "d2", "precis", 5), ("J", "1", "2", "", "no key", 6)], kinds)
    b = spark.createDataFrame([("J", "1", "2", "d2", "symposium", 1), ("J", "1", "2", "d1", "symposium", None), ("J", "", "2", "d3", "reply", 1)], kinds)
    assert [(r.doi, r.title) for r in symposia.merged_markers(a, b).collect()] == [("d1", "symposium"), ("d2", "precis"), ("d3", "reply")]
    got = symposia.issue_lists(a.union(b), size=2).orderBy("part").collect()
    assert [[x.doi for x in r["items"]] for r in got] == [["d1", "d2"], ["d2", ""]]


def test_headings_titles_and_menus(spark):
    df = spark.createDataFrame([("T", None), ("", "u"), (None, "v")], "`Book Title` string, `Review Link` string")
    rows = titled(from_headings(df)).collect()
    assert [(r.book_title, r.review_link, r.entry_type) for r in rows] == [("T", "", "")]
    assert browse.choices({"b": "Aesthetics", "a": "Zeno"}) == [("b", "Aesthetics"), ("a", "Zeno")]


def test_long_and_generic_titles(spark):
    long = "A Study of " + "Reason and " * 14 + "Will"
    rows = [{"id": 1, "book_title": long}, {"id": 2, "book_title": long + ". Oxford University Press, 1999. Pp. xii + 240. $12.95"}, {"id": 3, "book_title": "Book Reviews", "book_author_last_name": "X"}]
    once = {r.id: r.book_title for r in cleanup.run(catalog(spark, rows), "long_titles", "long_titles").collect()}
    assert once[1] == long and once[2] == long
    assert sorted(r.id for r in cleanup.run(catalog(spark, rows), "generic_titles", "generic_titles").collect()) == [1, 2]


def test_no_author_of_function_words(spark):
    df = spark.createDataFrame([("Guide for Readers: Plato and the Forms",), ("Jane Doe: Plato and the Forms",)], "t string")
    assert [(r.p.format, r.p["last"]) for r in df.select(parse_title(F.col("t")).alias("p")).collect() if r.p][-1] == ("author_colon_title", "Doe")
    assert all(r.p is None or r.p.format != "author_colon_title" for r in df.limit(1).select(parse_title(F.col("t")).alias("p")).collect())


def test_greedy_pairs_and_ranges_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice(["1", None]), "2", f"d{k}", rng.choice(["start", "end", "other"]), rng.choice(["lee", "ek", "", None]), start := rng.choice([None, *range(1, 40)]), start and start + rng.randrange(4)) for k in range(300)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "journal string, volume string, issue string, doi string, title string, surname string, start_page int, end_page int")
    pairs, ranges = [], set()
    for group in {r[:3] for r in rows}:
        anchors = [r for r in rows if r[:3] == group and r[6] is not None and r[5]]
        ends = sorted((r[7], r[6], i) for i, r in enumerate(anchors) if r[4] == "end")
        used = set()
        for r in sorted((r for r in anchors if r[4] == "start"), key=lambda r: r[6:]):
            hit = next((e for e in ends if e[0] > r[6] and e[2] not in used and anchors[e[2]][5] == r[5]), None)
            if hit:
                used.add(hit[2])
                pairs.append((*group, r[5], r[6], hit[0]))
        had = {p[3:5] for p in pairs if p[:3] == group}
        ranges |= {(group, p[4], p[5]) for p in pairs if p[:3] == group}
        for r in anchors:
            last = max((a[6:] for a in anchors if a[5] == r[5]))
            if r[4] == "start" and (r[5], r[6]) not in had and last[0] > r[6]:
                ranges.add((group, r[6], last[1]))
    text_key = lambda rs: sorted(map(str, rs))
    got = symposia.greedy_pairs(df.withColumn("kind", F.col("title")), symposia.ISSUE).collect()
    assert text_key(tuple(r) for r in got) == text_key(pairs) and len(pairs) > 20
    want = set()
    for group, lo, hi in ranges:
        inside = [r for r in rows if r[:3] == group and None not in group and r[6] is not None and lo <= r[6] <= hi]
        want |= set(inside) if len(inside) >= 2 else set()
    members = symposia.by_anchors(df, F.col("title") == "start", F.col("title") == "end").collect()
    assert text_key(tuple(r)[:8] for r in members) == text_key(want) and want
