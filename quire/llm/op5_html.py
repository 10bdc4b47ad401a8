"""Main text of HTML pages from a tree-structured graphical model.

Each block of a page is a node that is main text or not. A node's own evidence (element,
words of its class, links, length, punctuation) is a logistic potential; parent and child
are tied by a 2 x 2 potential, the odds of the child's label given the parent's. Sum-product
messages go once from the leaves up and once from the root down, which on a tree gives exact
marginals; blocks whose marginal is at least one half are the text. Both potentials are
trained from labelled pages (labelled_pages.py), on the driver, in some seconds.

Scripts, styles and comments are no text at all. Nodes of OBSERVED kinds, and hidden ones, have
a known label, not main text, as evidence of their own, and so have the blocks inside AREAS and hidden ones; the messages carry it on. A page
without blocks, plain text that is, is all main text. Null or empty html gives an empty text. Rows need nothing from each other; ids may
be null or repeated; other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.dom import Page, features
from quire.llm.labelled_pages import labelled_pages
from quire.llm.learn import logistic

#: Elements that the notion of main text itself leaves out.
OBSERVED = frozenset(("form", "button", "textarea", "dialog", "nav", "footer", "aside"))

#: Those of them whose blocks are left out with them; a form may hold a whole page.
AREAS = frozenset(("dialog", "nav", "footer", "aside"))


class Model:
    def __init__(self, weights: np.ndarray, edge: np.ndarray):
        self.weights, self.edge = weights, edge  # edge[parent label][child label]

    def marginals(self, page: Page) -> np.ndarray:
        """P(main text) of each node."""
        nodes = page.nodes
        n = len(nodes)
        z = np.array([features(x) for x in nodes]) @ self.weights
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -12, 12)))
        (e00, e01), (e10, e11) = self.edge.tolist()
        at = {id(x): i for i, x in enumerate(nodes)}
        parent = [-1 if x.parent is None else at[id(x.parent)] for x in nodes]
        outside = [False] * n  # in an area that is no main text as a whole
        for i, x in enumerate(nodes):
            outside[i] = x.tag in AREAS or x.hidden or (i > 0 and outside[parent[i]])
        own = [(1.0 - a, a) if not (out or x.tag in OBSERVED) else (1.0, 1e-9) for a, x, out in zip(p.tolist(), nodes, outside)]
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n  # what a node's subtree says to its parent
        below = list(own)
        for i in range(n - 1, 0, -1):  # children stand after their parents
            b0, b1 = below[i]
            m0, m1 = e00 * b0 + e01 * b1, e10 * b0 + e11 * b1
            total = m0 + m1
            up[i] = (m0 / total, m1 / total)
            k = parent[i]
            c0, c1 = below[k][0] * up[i][0], below[k][1] * up[i][1]
            total = c0 + c1
            below[k] = (c0 / total, c1 / total)
        out = np.empty(n)
        whole = list(below)  # evidence from everywhere
        out[0] = whole[0][1] / (whole[0][0] + whole[0][1])
        for i in range(1, n):
            k = parent[i]
            r0, r1 = whole[k][0] / max(up[i][0], 1e-300), whole[k][1] / max(up[i][1], 1e-300)
            d0, d1 = below[i][0] * (r0 * e00 + r1 * e10), below[i][1] * (r0 * e01 + r1 * e11)
            total = d0 + d1
            whole[i] = (d0 / total, d1 / total)
            out[i] = whole[i][1]
        return out

    def text(self, html: str | None) -> str:
        if not html:
            return ""
        page = Page(html)
        if len(page.nodes) == 1:
            return "\n".join(text for _, text in page.runs)
        kept = {id(x) for x, p in zip(page.nodes, self.marginals(page)) if p >= 0.5}
        return "\n".join(text for node, text in page.runs if id(node) in kept)


def train(pages: list[str] | None = None) -> Model:
    """From pages whose blocks have data-label, or a parent that has it."""
    x, y, pairs = [], [], np.ones((2, 2))
    for html in labelled_pages() if pages is None else pages:
        page = Page(html)
        for node in page.nodes:
            if node.label is None:
                node.label = node.parent.label if node.parent is not None else 0
            x.append(features(node))
            y.append(node.label)
            if node.parent is not None:
                pairs[node.parent.label, node.label] += 1
    given = pairs / pairs.sum(axis=1, keepdims=True)
    return Model(logistic(np.array(x)[:, :-1], np.array(y, float), ridge=0.5), given / (pairs.sum(axis=0) / pairs.sum()))


def extract(df: DataFrame, model: Model, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([model.text(h.as_py()) for h in part.column(part.num_columns - 1)], pa.string())], names=names)

    others = [c for c in dict.fromkeys(key.split(","))]
    names = [*others, "text"]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others) + ", text string"
    return df.select(*others, html).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), train(), "page_id,url")
    return rows.withColumn("n_chars", F.length("text").cast("long"))
