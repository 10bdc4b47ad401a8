"""HTML as a tree of blocks, with the features of each."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from html.parser import HTMLParser

#: Element names by role, and words of class, id and role attributes. All other elements are inline.
UNSEEN = frozenset("script style template noscript svg iframe object canvas audio video head title select option datalist annotation annotation-xml".split())
MAY_NEST = frozenset(("svg", "object", "head"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body li dt dd tr td th thead tbody tfoot caption colgroup legend optgroup option button textarea".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section search summary table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table div article section body main aside nav".split())
TAGS = "body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption header footer nav aside form fieldset button textarea details address menu dialog".split()
WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip toolbar",
    "edge": "header footer masthead copyright legal colophon bottom top topbar site-header site-footer",
    "side": "sidebar side aside related recommended widget popular trending more rail tags",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion banner outbrain taboola adsense",
    "notice": "cookie cookies consent notice notification gdpr alert popup modal overlay newsletter subscribe subscription signup paywall disclaimer",
    "talk": "comment comments reply replies respond disqus discussion reader-comments review-form",
    "share": "share sharing social follow login search searchbox form",
    "main": "article content main post entry story text body page-content article-body post-content entry-content",
}
WORD_OF = {w: kind for kind, words in WORDS.items() for w in words.split()}
KINDS = list(WORDS)
AREAS = frozenset("nav aside footer header form article main".split())
SPLIT = re.compile(r"[^a-z]+")


class Node:
    __slots__ = ("tag", "parent", "kids", "kinds", "chars", "links", "stops", "direct", "hidden", "label", "under")

    def __init__(self, tag: str, parent: Node | None, attrs: list[tuple[str, str | None]]):
        self.tag, self.parent, self.kids = tag, parent, 0
        self.chars = self.links = self.stops = self.direct = 0
        self.kinds, self.hidden, self.label = set(), False, None
        self.under = parent.under | parent.kinds | ({parent.tag} & AREAS) if parent is not None else frozenset()
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                low = value.lower()
                for word in (*SPLIT.split(low), *low.split()):
                    if word in WORD_OF:
                        self.kinds.add(WORD_OF[word])
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "").lower()):
                self.hidden = True
            elif name == "data-label":
                self.label = int(value or 0)
        if parent is not None:
            parent.kids += 1


class Page(HTMLParser):
    """nodes: blocks in page order, each after its parent. runs: (node, text) in page order.

    An element that is not shown hides what it holds up to its end tag. One without an end tag of
    its own hides no more than what stands before the next block or the end of what it is in.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("body", None, [])]
        self.open: list[tuple[str, Node]] = [("body", self.nodes[0])]
        self.unseen: list[str] = []
        self.loose = False  # the element that hides has no end tag
        self.count = Counter(("body",))  # of open elements
        self.in_link = 0
        self.runs: list[tuple[Node, str]] = []
        self.held: list[str] = []
        self.html, self.lines = html, None
        self.feed(html)
        self.close()
        self.flush()
        for node in reversed(self.nodes[1:]):  # sums over all that a block holds
            above = node.parent
            above.chars += node.chars
            above.stops += node.stops
            above.links += node.links

    def has_end(self, tag: str) -> bool:
        """Whether the element that begins here has an end tag, and not only a later one of its kind."""
        if self.lines is None:
            self.lines = [0, *(m.end() for m in re.finditer("\n", self.html))]
            self.tags: dict[str, list[tuple[int, bool]]] = {}
        if tag not in self.tags:
            self.tags[tag] = [(m.start(), m[1] == "/") for m in re.finditer(rf"<(/?){tag}(?=[\s/>])", self.html, re.I)]
        line, column = self.getpos()
        at = bisect_right(self.tags[tag], (self.lines[line - 1] + column, True))
        later = self.tags[tag]
        return any(end for _, end in later[at:]) if tag in MAY_NEST else at < len(later) and later[at][1]

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.runs.append((self.open[-1][1], text))
            self.held = []

    def pop_to(self, at: int) -> None:
        if any(not is_inline(tag) or node is not self.open[at - 1][1] for tag, node in self.open[at:]):
            self.flush()
        for tag, _ in self.open[at:]:
            self.in_link -= tag == "a"
            self.count[tag] -= 1
        del self.open[at:]

    def shut(self, names: frozenset[str] | set[str], stop: frozenset[str]) -> None:
        if not any(self.count[n] for n in names):
            return
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at][0]
            if tag in names:
                self.pop_to(at)
                return
            if tag in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.unseen:
            if tag == self.unseen[-1] and tag not in VOID:
                self.unseen.append(tag)
            elif (self.loose or self.unseen[-1] in ("head", "title")) and (tag in CLOSES_P or tag == "body"):
                self.unseen.clear()
                self.loose = False
            else:
                return
            if self.unseen:
                return
        if tag in UNSEEN:
            self.unseen.append(tag)
            self.loose = tag not in self.CDATA_CONTENT_ELEMENTS and not self.has_end(tag)
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br" or tag == "img":
                self.held.append(" ")
            return
        if tag in ("html", "body"):
            for name, value in attrs:
                if name == "data-label":
                    self.nodes[0].label = int(value or 0)
            return
        if tag in CLOSES_P:
            self.shut({"p"}, frozenset({"table", "td", "th", "button", "blockquote", "li"}) | HOLDS)
        if tag in SIBLINGS:
            self.shut(SIBLINGS[tag], HOLDS)
        here = self.open[-1][1]
        inline = is_inline(tag)
        node = here
        if not inline or attrs and any(n in ("class", "id", "role", "hidden", "style", "aria-hidden", "data-label") for n, _ in attrs):
            made = Node(tag, here, attrs)
            if not inline or made.hidden or made.label is not None or made.kinds - {"main", "edge", "side"}:
                node = made
                self.flush()
                self.nodes.append(node)
            else:
                here.kids -= 1
        self.in_link += tag == "a"
        self.count[tag] += 1
        self.open.append((tag, node))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.unseen:
            if tag == self.unseen[-1]:
                self.unseen.pop()
            if not self.loose or not self.count[tag]:
                return
            self.unseen.clear()  # the end of what the element without an end is in
            self.loose = False
        if tag == "br":
            self.held.append(" ")
        if not self.count[tag]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                self.pop_to(at)
                return

    def handle_data(self, data: str) -> None:
        if self.unseen:
            return
        self.held.append(data)
        size = len(data) - data.count(" ")
        node = self.open[-1][1]
        node.direct += size
        node.chars += size
        node.stops += data.count(".") + data.count(",")
        if self.in_link:
            node.links += size


def is_inline(tag: str) -> bool:
    return tag not in BLOCK and tag not in CLOSES_P


#: Names of the features, in the order of feature().
FEATURES = [*(f"tag {t}" for t in TAGS), *(f"word {k}" for k in KINDS), *(f"under {k}" for k in (*KINDS, *sorted(AREAS))), "inline", "hidden", "links", "many links", "size", "own text", "stops", "short", "constant"]


def features(node: Node) -> list[float]:
    chars = max(node.chars, 1)
    links = node.links / chars
    size = min(len(str(node.chars)) - 1 + node.chars / 10 ** len(str(node.chars)), 5.0) / 5
    return [
        *(float(node.tag == t) for t in TAGS),
        *(float(k in node.kinds) for k in KINDS),
        *(float(k in node.under) for k in KINDS), *(float(k in node.under) for k in sorted(AREAS)),
        float(is_inline(node.tag)), float(node.hidden), links, float(links > 0.5), size, node.direct / chars, min(node.stops / chars * 20, 2.0), float(node.chars < 25), 1.0,
    ]
