import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions.spans import italic_citation, list_item, period_segments, spans
from quire.operators.parse import list_rows
from quire.schema import POST


def one(spark, texts, function):
    return [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select(function(F.col("t")).alias("o"), "k").orderBy("k").collect()]


def test_spans_of_nested_marks(spark):
    html = ['a <i>b <b>c</b></i> d', '<a href="u?x=1&amp;y">p <em>q</em></a>r', "<A class='k' HREF='v'>s</a>", "no < sign", None, "", "<i>x</em><i></i>y", "<a>z</a><em>m<i>n</i>o</em>p"]
    got = [[(s.text, s.italic, s.href) for s in r] for r in one(spark, html, spans)]
    assert got == [
        [("a ", False, None), ("b c", True, None), (" d", False, None)], [("p ", False, "u?x=1&amp;y"), ("q", True, "u?x=1&amp;y"), ("r", False, None)], [("s", False, "v")], [("no < sign", False, None)], [], [],
        [("x", True, None), ("y", False, None)], [("z", False, None), ("mno", True, None), ("p", False, None)],
    ]


ITEMS = {
    '<em>The First Book</em> by Ann Lee is reviewed by Bo Ek at <a href="http://v/1"><em>Mind</em></a>, and by Cy Dee at <a href="http://w/2"><em>Ethics</em></a>.': [("The First Book", "Ann Lee", "Bo Ek", "Mind", "http://v/1"), ("The First Book", "Ann Lee", "Cy Dee", "Ethics", "http://w/2")],
    '<a href="https://www.amazon.com/x"><em>One Long Title</em></a> by A. Lee and <em>Another Title</em> by B. Fox are reviewed by Cy Dee at <a href="http://v/3"><em>TLS</em></a>.': [("One Long Title", "A. Lee", "Cy Dee", "TLS", "http://v/3"), ("Another Title", "B. Fox", "Cy Dee", "TLS", "http://v/3")],
    'Cy Dee reviews <a href="http://v/4"><em><strong>Some Title</strong></em></a> by Ann Lee, at <em>The Times</em>.': [("Some Title", "Ann Lee", "Cy Dee", "The Times", "http://v/4")],
    '<em>Linkless Book</em> by Ann Lee is reviewed by Bo Ek at <em>Mind</em>.': [("Linkless Book", "Ann Lee", "Bo Ek", "Mind", "")],
    '<em>Shared Book</em>, edited by Ann Lee, is reviewed by Bo Ek at <a href="http://v/5"><em>Mind</em></a> and in <a href="http://v/6"><em>Noûs</em></a>': [("Shared Book", "Ann Lee", "Bo Ek", "Mind", "http://v/5"), ("Shared Book", "Ann Lee", "Bo Ek", "Noûs", "http://v/6")],
    "A list without marks": None, "<em>Only One</em>": None, "": None,
}


def test_each_venue_has_its_own_link(spark):
    got = one(spark, list(ITEMS), list_item)
    assert [r and [tuple(x) for x in r] for r in got] == list(ITEMS.values())


def test_items_of_posts(spark):
    html = "<ol>" + "".join(f"<li>{t}</li>" for t in ITEMS) + "<li>Cy Dee reviews <i>B</i> by E Fox, at Ethics.</li></ol>"
    rows = list_rows(spark.createDataFrame([(1, "2020-01-01", "s", "l", (html,))], POST)).collect()
    want = [r for rs in ITEMS.values() if rs for r in rs] + [("B", "E Fox", "Cy Dee", "Ethics", "")]
    assert sorted((r.book_title, r.author, r.reviewer, r.venue, r.review_link) for r in rows) == sorted(want)


CITED = {
    "Ann Lee, <i>Thinking Machines</i>": ("italic_tags", "Thinking Machines", "Ann Lee", False),
    "Ann Lee (ed.), <i>Thinking Machines</i>. Oxford": ("italic_tags", "Thinking Machines", "Ann Lee", True),
    "Ann Lee: <i>Thinking Machines</i>": ("italic_author_colon_title", "Thinking Machines", "Ann Lee", False),
    "<i>Ann Lee</i>: Thinking About Machines. Cambridge 2001": ("italic_author_colon_title", "Thinking About Machines", "Ann Lee", False),
    "<i>Thinking Machines</i>. Ann Lee": ("italic_then_author", "Thinking Machines", "Ann Lee", False),
    "<i>Thinking Machines</i>, by Ann Lee. New York: Holt, 1990": ("italic_then_author", "Thinking Machines", "Ann Lee", False),
    "<i>Thinking Machines</i>, edited by Ann Lee and Bo Ek, 2001": ("italic_then_author", "Thinking Machines", "Ann Lee and Bo Ek", True),
    "<i>Thinking Machines</i>, by Ann Lee. Edited by Bo Ek": ("italic_then_author", "Thinking Machines", "Ann Lee", True),
    "<i>Thinking</i> by Ann Lee <i>Another</i> by Bo Ek": ("italic_then_author", "Thinking", "Ann Lee", False),
    "<i>Thinking Machines</i>": ("italic_title_only", "Thinking Machines", "", False),
    "<i>Thinking Machines</i> and what they do to us": ("italic_title_only", "Thinking Machines", "", False),
    "no italics": None, "<i> </i>": None,
}


def test_italic_family(spark):
    got = one(spark, list(CITED), italic_citation)
    assert [r and tuple(r) for r in got] == list(CITED.values())


def loop(text):
    """The rule, a character at a time."""
    out, now, i = [], "", 0
    while i < len(text):
        if text[i : i + 2] == ". ":
            held = now.strip()
            initial = held and len(held.split()[-1].rstrip(".")) <= 2
            if not initial and not re.match(r"[A-Z]\.(?:\s|$)", text[i + 2 : i + 5]):
                out.append((now + ".").strip())
                now, i = "", i + 2
                continue
        now, i = now + text[i], i + 1
    return out + ([now.strip()] if now.strip() else [])


@pytest.mark.parametrize("seed", range(3))
def test_segments_against_a_loop(spark, seed):
    rng = random.Random(seed)
    words = ["J.", "H.", "Smith.", "Smith", "On", "Mind.", "of.", "a", ".", "..", "etc..", "", "X.\n", "é.", "Vol.", "12.", "(ed.)", "tab\tend."]
    texts = ["J. H. Smith. On Mind. Oxford. 1990.", "", ". . .", "ab . . Cd", "Ends.", "Ends. ", "A. B."] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    assert one(spark, texts, period_segments) == [loop(t) for t in texts]
