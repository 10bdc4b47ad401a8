import html
import re
import time

import pytest

from quire.llm import op5_html
from quire.llm.dom import Page
from quire.llm.labelled_pages import labelled_pages

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return op5_html.train()


def test_held_out_labelled_pages(model):
    wrong = total = 0
    for text in labelled_pages(80, seed=77):
        page = Page(text)
        for node, p in zip(page.nodes, model.marginals(page)):
            if node.label is None:
                node.label = node.parent.label
            if node.direct:
                total += 1
                wrong += (p >= 0.5) != bool(node.label)
    assert wrong <= 0.03 * total


def test_messages_give_exact_marginals(model):
    page = Page("<div class='content'><p>One two three four, five.</p><ul><li>a b</li></ul></div><div class='ad'>x y</div>")
    n = len(page.nodes)
    z = [op5_html.features(x) @ model.weights for x in page.nodes]
    import itertools
    import math

    total, one = 0.0, [0.0] * n
    for labels in itertools.product((0, 1), repeat=n):
        w = 1.0
        for i, x in enumerate(page.nodes):
            p = 1 / (1 + math.exp(-min(max(z[i], -12), 12)))
            w *= p if labels[i] else 1 - p
            if x.parent is not None:
                w *= model.edge[labels[page.nodes.index(x.parent)], labels[i]]
        total += w
        for i in range(n):
            one[i] += w * labels[i]
    assert [x / total for x in one] == pytest.approx(model.marginals(page).tolist(), abs=1e-9)


def test_pages_of_the_test_table(spark):
    got = {r.page_id: r for r in op5_html.query(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    same = 0
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|<footer|</artic|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        same += got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert same == len(rows)


def test_parts_and_edges(spark, model):
    page = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
    <header class="top"><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav>
    <article><h1>A &amp; B&nbsp;title</h1><p>First  paragraph,
    with a <a href="/x">link</a> and <b>bold</b> text.<p>Second &lt;one&gt;, long enough to stand alone.
    <div class="ad">Buy now</div><ul><li>Item one, said the man.<li>Item two, said the woman.</ul></article>
    <section id="comments"><p>Nice post, I liked it.</p></section><form><label>Name</label><input></form><footer>(c) us</footer></body></html>"""
    assert model.text(page).split("\n") == ["A & B title", "First paragraph, with a link and bold text.", "Second <one>, long enough to stand alone.", "Item one, said the man.", "Item two, said the woman."]
    deep = "<div>" * 3000 + "<p>deep text, deep text, deep text.</p>"
    df = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "<p", "z"), (2, deep, "z")], "page_id long, html string, text string")
    rows = op5_html.extract(df, model).collect()
    assert len(rows) == 4 and rows[0].text == "" and rows[1].text == ""
    assert op5_html.extract(df.limit(0), model).collect() == []


FIRST, SECOND = "The first paragraph has a sentence, and then one more.", "The second paragraph is as long, and has commas, too."


@pytest.mark.parametrize("tag", ["select", "iframe", "svg", "noscript", "object", "canvas", "video", "audio", "datalist", "template"])
def test_unclosed_elements_hide_no_later_block(model, tag):
    around = lambda inside: f"<body><nav><a href=/>Home</a></nav><article><h1>A title</h1>{inside}</article></body>"
    want = f"A title\n{FIRST}\n{SECOND}"
    assert model.text(around(f"<p>{FIRST} <{tag} class=x><p>{SECOND}</p>")) == want
    assert model.text(around(f"<p>{FIRST} <{tag}>hidden</{tag}></p><p>{SECOND}</p>")) == want
    assert model.text(around(f"<p>{FIRST}</p><{tag}><p>hidden</p></{tag}><p>{SECOND}</p>")) == want
    if tag not in ("svg", "object"):
        assert model.text(around(f"<p>{FIRST} <{tag}><p>{SECOND}</p><{tag}>hidden</{tag}>")) == want


def test_formulas_unknown_elements_and_plain_text(model):
    assert model.text(f"<article><p>{FIRST} <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></math></p><p>{SECOND}</p></article>") == f"{FIRST} x=2\n{SECOND}"
    assert model.text(f"<article><p>{FIRST} <my-mark>here</my-mark>.</p></article>") == f"{FIRST} here."
    assert model.text("Just some words, without any mark-up &amp; so on.\nMore.") == "Just some words, without any mark-up & so on. More."
    assert model.text("<script>var a = 1") == ""


def test_time_is_linear(model):
    began = time.time()
    deep = f"<article>{'<div>' * 20_000}<p>{FIRST}</p>{'</i></b>' * 20_000}"
    model.text(deep)
    model.text(f"<article>{'<span>' * 20_000}{'<p>' * 20_000}{FIRST}")
    model.text(f"<article>{'<select>' * 5_000}<p>{FIRST}</p>")
    assert model.text(f"<article>{f'<p>{FIRST}</p>' * 20_000}</article>").count("\n") == 19_999
    assert time.time() - began < 60


A = "The committee met on Tuesday, and after some hours of talk it agreed on a plan for the harbour. Nobody was happy with it, but nobody had a better one."
B = "Work is to begin in the spring, if the money can be found. Until then, the old pier stays closed, and the ferries will go on landing at the northern quay."
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Contact</a></li></ul>'
#: Layouts that training has no template of, and the text that must come out.
LAYOUTS = {
    "p in body": (f"<body><p>{A}</p></body>", [A]),
    "two p in body": (f"<body><p>{A}</p><p>{B}</p></body>", [A, B]),
    "div in body": (f"<body><div>{A}</div></body>", [A]),
    "text without blocks": (A, [A]),
    "plain divs between named ones": (f'<div class="nav">Home About</div><div>{A}</div><div>{B}</div><div class="footer">c</div>', [A, B]),
    "nav before p": (f"<nav>{MENU}</nav><p>{A}</p><p>{B}</p>", [A, B]),
    "footer after p": (f"<p>{A}</p><footer><p>{B}</p></footer>", [A]),
    "nested plain divs": (f"<div><div><div><p>{A}</p><p>{B}</p></div></div></div>", [A, B]),
    "layout table": (f"<table><tr><td>{MENU}</td><td><p>{A}</p><p>{B}</p></td></tr></table>", [A, B]),
    "aside in article": (f"<article><h1>Harbour</h1><p>{A}</p><aside><p>See also our other stories.</p></aside><p>{B}</p></article>", ["Harbour", A, B]),
    "script and style": (f"<style>p {{}}</style><p>{A}</p><script>var x = '<p>no</p>';</script>", [A]),
    "comments after": (f'<div><p>{A}</p></div><div class="comments"><p>First!</p><p>So true, thank you for this.</p></div>', [A]),
    "blockquote": (f"<p>{A}</p><blockquote>{B}</blockquote>", [A, B]),
    "section": (f"<section><h2>Harbour</h2><p>{A}</p></section>", ["Harbour", A]),
    "inline marks": (f"<p><b>{A[:13]}</b>{A[13:40]}<a href='/x'>{A[40:60]}</a>{A[60:]}</p><p>{B}</p>", [A, B]),
    "cookie notice": (f'<div id="cookie-notice"><p>We use cookies, as all do.</p></div><p>{A}</p><p>{B}</p>', [A, B]),
    "hidden": (f"<p>{A}</p><div hidden><p>{B}</p></div>", [A]),
    "references": ("<p>Fish &amp; chips&nbsp;for all, said the mayor, and the whole town came to the harbour.</p>", ["Fish & chips for all, said the mayor, and the whole town came to the harbour."]),
}


def test_layouts_without_containers_or_headings():
    model = op5_html.train()
    got = {name: model.text(html) for name, (html, _) in LAYOUTS.items()}
    assert got == {name: "\n".join(lines) for name, (_, lines) in LAYOUTS.items()}
