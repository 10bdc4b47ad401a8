"""Labelled pages for training the extractor: composed from parts whose label is known.

data-label is 1 on main text and 0 on anything else; a block without it has its parent's label.
"""

from __future__ import annotations

import random


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("bcdfghklmnprstvwaeiou") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def _sentences(rng: random.Random, low: int, high: int) -> str:
    return " ".join(f"{_words(rng, rng.randrange(4, 14)).capitalize()}{rng.choice(['.', '.', ',', '?'])}" for _ in range(rng.randrange(low, high)))


def _links(rng: random.Random, n: int, tag: str = "li") -> str:
    return "".join(f'<{tag}><a href="/{i}">{_words(rng, rng.randrange(1, 4))}</a></{tag}>' for i in range(n))


def _boilerplate(rng: random.Random) -> str:
    w = lambda a, b: _words(rng, rng.randrange(a, b))
    s = lambda a, b: _sentences(rng, a, b)
    return rng.choice(
        [
            f'<nav data-label="0"><ul>{_links(rng, rng.randrange(2, 8))}</ul></nav>',
            f'<div data-label="0" class="menu"><ul>{_links(rng, 5)}</ul></div>',
            f'<ul data-label="0" class="breadcrumb">{_links(rng, 3)}</ul>',
            f'<header data-label="0" class="site-header"><h1>{w(1, 4)}</h1><p>{w(2, 8)}</p></header>',
            f'<div data-label="0" id="header"><a href="/">{w(1, 3)}</a> <span>{w(2, 6)}</span></div>',
            f'<footer data-label="0">&copy; {w(1, 3)} &middot; {s(1, 3)}</footer>',
            f'<div data-label="0" class="footer"><p>{s(1, 3)}</p><ul>{_links(rng, 4)}</ul></div>',
            f'<aside data-label="0"><h3>{w(1, 4)}</h3><ul>{_links(rng, 4)}</ul><p>{s(1, 3)}</p></aside>',
            f'<div data-label="0" class="sidebar"><h4>{w(1, 3)}</h4><p>{s(1, 3)}</p><ul>{_links(rng, 3)}</ul></div>',
            f'<div data-label="0" class="related"><h2>{w(1, 3)}</h2>{_links(rng, 4, "p")}</div>',
            f'<div data-label="0" class="ad">{s(1, 4)}</div>',
            f'<div data-label="0" class="advert banner"><p>{s(1, 3)}</p><a href="/x">{w(1, 4)}</a></div>',
            f'<section data-label="0" class="promo">{s(1, 3)}</section>',
            f'<div data-label="0" class="cookie-notice" role="dialog"><p>{s(1, 3)}</p><button>{w(1, 2)}</button></div>',
            f'<div data-label="0" id="notice">{s(1, 2)}</div>',
            f'<form data-label="0" action="/s"><label>{w(1, 3)}</label><input name="q"><button>{w(1, 2)}</button></form>',
            f'<div data-label="0" class="newsletter"><p>{s(1, 2)}</p><form><input><button>{w(1, 2)}</button></form></div>',
            f'<div data-label="0" class="share">{_links(rng, 3, "span")}</div>',
            f'<div data-label="0" hidden><p>{s(1, 4)}</p></div>',
        ]
    )


def _comments(rng: random.Random) -> str:
    one = lambda: f'<div class="comment"><b>{_words(rng, 2)}</b><p>{_sentences(rng, 1, 5)}</p></div>'
    body = "".join(one() for _ in range(rng.randrange(1, 6)))
    return rng.choice([f'<section data-label="0" id="comments"><h3>{_words(rng, 2)}</h3>{body}</section>', f'<div data-label="0" class="comments">{body}</div>', f'<ol data-label="0" class="comment-list">{"".join(f"<li><p>{_sentences(rng, 1, 4)}</p></li>" for _ in range(3))}</ol>'])


def _content(rng: random.Random) -> str:
    s = lambda a, b: _sentences(rng, a, b)
    return rng.choice(
        [
            f"<p>{s(1, 8)}</p>", f"<p>{s(1, 8)}</p>", f"<p>{s(2, 8)}", f"<p><b>{s(1, 6)}<br>", f"<p>{_words(rng, rng.randrange(1, 5))}.</p>",
            f'<p>{s(1, 3)} <a href="/y">{_words(rng, 3)}</a> {s(1, 3)}</p>', f"<h2>{_words(rng, rng.randrange(2, 7))}</h2><p>{s(2, 5)}</p>",
            f"<ul>{''.join(f'<li>{s(1, 3)}</li>' for _ in range(3))}</ul>", f"<blockquote><p>{s(1, 4)}</p></blockquote>", f"<div>{s(1, 5)}</div>",
            f"<table><tr><td>{_words(rng, 3)}</td><td>{_words(rng, 2)}</td></tr></table>", f"<pre>{_words(rng, 8)}</pre>", f"<h3>{_words(rng, 4)}</h3>",
        ]
    )


def _bare_page(rng: random.Random) -> str:
    """A page whose main text has no container of a telling name, and mostly no heading: blocks right in the body, plain divs, cells of a table."""
    text = lambda low, high: _sentences(rng, low, high)
    blocks = rng.choice([1, 1, 1, 2, 3, 6])
    kind = rng.randrange(6)
    if kind == 0:
        core = "".join(f'<p data-label="1">{text(1, 9)}</p>' for _ in range(blocks))
    elif kind == 1:
        core = "".join(f'<div data-label="1">{text(1, 9)}</div>' for _ in range(blocks))
    elif kind == 2:
        core = f'<div data-label="1">{"".join(_content(rng) for _ in range(blocks))}</div>'
    elif kind == 3:
        core = "".join(f'<{t} data-label="1">{text(1, 7)}</{t}>' for t in (rng.choice(["p", "div", "pre", "blockquote", "section", "article", "main"]) for _ in range(blocks)))
    elif kind == 4:
        core = f'<table data-label="1"><tr data-label="1"><td data-label="0"><ul>{_links(rng, 4)}</ul></td><td data-label="1">{"".join(f"<p>{text(1, 8)}</p>" for _ in range(blocks))}</td></tr></table>'
    else:
        core = f'<h2 data-label="1">{_words(rng, rng.randrange(2, 7))}</h2>' + "".join(f'<p data-label="1">{text(1, 8)}</p>' for _ in range(blocks))
    plain = lambda: rng.choice([f'<div data-label="0" class="{c}">{_words(rng, rng.randrange(1, 6))}</div>' for c in ("nav", "menu", "footer", "breadcrumb", "copyright", "related")])
    around = lambda: "".join(rng.choice([_boilerplate, _boilerplate, lambda _: plain()])(rng) for _ in range(rng.choice([0, 0, 1, 2])))
    return f"<html><body data-label='1'>{around()}{core}{around()}</body></html>"


def labelled_pages(n: int = 240, seed: int = 5, bare: int = 300) -> list[str]:
    """n pages with a headed article in a container, and `bare` without."""
    rng = random.Random(seed)
    pages = []
    for _ in range(n):
        body = f"<h1>{_words(rng, rng.randrange(2, 9))}</h1>" + "".join(_content(rng) for _ in range(rng.randrange(1, 12)))
        inside = [_boilerplate(rng) for _ in range(rng.choice([0, 0, 0, 1, 2]))] + ([_comments(rng)] if rng.random() < 0.25 else [])
        body += "".join(inside)
        tag, mark = rng.choice([("article", ""), ("article", ""), ("main", ""), ("div", ' class="content"'), ("div", ' id="main"'), ("section", ' class="post"'), ("div", ' class="entry-content"'), ("div", "")])
        core = f'<{tag}{mark} data-label="1">{body}</{tag}>'
        if rng.random() < 0.4:
            core = rng.choice([f'<main data-label="0">{core}</main>', f'<div id="page" data-label="0">{core}</div>', f'<div class="wrapper" data-label="0"><div data-label="0">{core}</div></div>'])
        before, after = [_boilerplate(rng) for _ in range(rng.randrange(0, 4))], [_boilerplate(rng) for _ in range(rng.randrange(0, 4))]
        if rng.random() < 0.4:
            after.insert(0, _comments(rng))
        pages.append(f"<!DOCTYPE html><html><head><title>t</title></head><body data-label='0'>{''.join(before)}{core}{''.join(after)}</body></html>")
    return pages + [_bare_page(rng) for _ in range(bare)]
