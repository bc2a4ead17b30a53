"""Main text of web pages by a tree-structured graphical model.

Each element and text block of a page is content or not. A node's potential is log-linear in its features; an edge's is a table
of parent's by child's state, one for each kind of child. Sum-product messages go up the tree and down again and give each
node's exact marginal; the text blocks of which content is likelier are the main text. Potentials are fitted to labelled pages by
gradient ascent on the likelihood, whose gradient is what the labels have less what the marginals expect.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakebranch.llm import shared
from lakebranch.llm.dom import Node, parse

KINDS = ("", "article", "main", "section", "div", "p", "h", "list", "li", "nav", "header", "footer", "aside", "form", "table", "quote", "figure", "body", "hidden", "noscript", "details", "other")
_KIND_OF = {
    **{f"h{i}": "h" for i in range(1, 7)}, **dict.fromkeys(("ul", "ol", "dl", "menu", "dir"), "list"), **dict.fromkeys(("li", "dt", "dd"), "li"),
    **dict.fromkeys(("button", "select", "fieldset", "option", "legend", "optgroup", "search", "dialog"), "form"),
    **dict.fromkeys(("tr", "td", "th", "tbody", "thead", "tfoot", "caption"), "table"), **dict.fromkeys(("blockquote", "pre"), "quote"),
    **dict.fromkeys(("figcaption",), "figure"), "address": "footer", "summary": "h",
}
#: Words of class, id and role attributes, by what they tell of an element.
HINTS = {
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager pages tabs toc toolbar topbar skip links submenu",
    "frame": "header masthead banner footer foot copyright contentinfo colophon logo branding site legal top bottom",
    "side": "sidebar side aside rail widget widgets related recommended trending popular complementary more archive archives tags teaser",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted dfp adsense banner-ad adslot",
    "notice": "cookie cookies consent notice notices alert banner gdpr popup modal overlay privacy newsletter subscribe subscription paywall message warning notification announcement",
    "reader": "comment comments reply replies respond discussion disqus feedback reviews",
    "social": "share sharing social follow facebook twitter rating like likes meta byline author-bio",
    "form": "form search login signin signup register contact input",
    "content": "content article post entry body text story main maincontent articlebody hentry news single prose markdown paragraph",
}
_HINT_OF = {word: name for name, words in HINTS.items() for word in words.split()}
_HINTS = tuple(HINTS)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
N_FEATURES = len(KINDS) + len(_HINTS) + 10


@cache
def hints(value: str) -> tuple[int, ...]:
    found = {_HINT_OF.get(w) for w in _WORD.findall(_CAMEL.sub(" ", value).lower())}
    return tuple(_HINTS.index(h) for h in found if h)


@dataclass
class Forest:
    """Nodes of several pages, parents first: page of each, parent (-1: none), depth, kind, features, and a block's text."""

    page: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    features: np.ndarray
    texts: list[str]


def forest(pages: list[list[Node]]) -> Forest:
    n = sum(map(len, pages))
    page, parent, depth, kind = (np.zeros(n, np.int64) for _ in range(4))
    features, texts, base = np.zeros((n, N_FEATURES), np.float32), [], 0
    rest = len(KINDS) + len(_HINTS)
    for number, nodes in enumerate(pages):
        total = [0] * len(nodes)
        linked = [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            node = nodes[i]
            total[i] += len(node.text)
            linked[i] += node.linked
            if i:
                total[node.parent] += total[i]
                linked[node.parent] += linked[i]
        whole = max(1, total[0])
        for i, node in enumerate(nodes):
            at = base + i
            page[at], parent[at] = number, node.parent + base if i else -1
            depth[at] = depth[parent[at]] + 1 if i else 0
            shown = node.attrs.get("hidden") is None and node.attrs.get("aria-hidden") != "true" and "display:none" not in node.attrs.get("style", "").replace(" ", "")
            name = "hidden" if not shown else _KIND_OF.get(node.tag, node.tag)
            k = KINDS.index(name) if name in KINDS else len(KINDS) - 1
            kind[at] = k
            row = features[at]
            row[k] = 1
            for key in ("class", "id", "role"):
                if node.attrs.get(key):
                    for h in hints(node.attrs[key]):
                        row[len(KINDS) + h] = 1
            texts.append(node.text)
            length, density = total[i], linked[i] / max(1, total[i])
            row[rest] = 1
            row[rest + 1] = density
            row[rest + 2] = length / whole
            row[rest + 3] = min(1.0, length / 200)
            row[rest + 4] = 1 if length < 25 else 0
            row[rest + 5] = 1 if density > 0.5 else 0
            row[rest + 6] = 1 if node.tag == "h1" else 0
            if not node.tag:
                row[rest + 7] = 1 if node.text[-1:] in ".!?:;\"'”…" else 0
                row[rest + 8] = min(1.0, node.text.count(",") / 5)
                row[rest + 9] = 1 if "©" in node.text or "copyright" in node.text[:40].lower() else 0
        base += len(nodes)
    return Forest(page, parent, depth, kind, features, texts)


@dataclass
class Model:
    """weights: a node's log-odds of content by feature; edges: log potentials [child's kind, parent's state, child's state]."""

    weights: np.ndarray
    edges: np.ndarray

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """(P(content) of each node, P(parent's state, child's state) of each node but roots), by one pass up and one down."""
        n = len(f.parent)
        own = np.zeros((n, 2))
        own[:, 1] = f.features @ self.weights
        up = own.copy()  # a node's potential times the messages of its children
        sent = np.zeros((n, 2))
        levels = [np.flatnonzero(f.depth == d) for d in range(int(f.depth.max()) + 1)] if n < 50_000 or f.depth.max() < 200 else by_level(f.depth)
        for level in reversed(levels[1:]):
            sent[level] = np.logaddexp.reduce(self.edges[f.kind[level]] + up[level][:, None, :], axis=2)
            for s in range(2):
                np.add.at(up[:, s], f.parent[level], sent[level, s])
        down = np.zeros((n, 2))  # what a node's parent says of it, its own message taken out
        pairs = np.zeros((n, 2, 2))
        for level in levels[1:]:
            up_to = f.parent[level]
            above = up[up_to] + down[up_to] - sent[level]
            both = above[:, :, None] + self.edges[f.kind[level]] + up[level][:, None, :]
            both -= both.max(axis=(1, 2), keepdims=True)
            p = np.exp(both)
            pairs[level] = p / p.sum(axis=(1, 2), keepdims=True)
            down[level] = np.logaddexp.reduce(above[:, :, None] + self.edges[f.kind[level]], axis=1)
        belief = up + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), pairs


def by_level(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


def fit(f: Forest, labels: np.ndarray, steps: int = 250, rate: float = 0.15, decay: float = 1e-3) -> Model:
    """A model of labelled nodes (1: content), by Adam on the mean log-likelihood of the pages' labellings."""
    model = Model(np.zeros(N_FEATURES), np.zeros((len(KINDS), 2, 2)))
    y, child = labels.astype(int), np.flatnonzero(f.parent >= 0)
    seen = np.zeros_like(model.edges)
    np.add.at(seen, (f.kind[child], y[f.parent[child]], y[child]), 1)
    values = [model.weights, model.edges]
    first, second = ([np.zeros_like(v) for v in values] for _ in range(2))
    n = int(f.page.max()) + 1
    for step in range(1, steps + 1):
        p, pairs = model.marginals(f)
        expected = np.zeros_like(model.edges)
        np.add.at(expected, f.kind[child], pairs[child])
        for v, a, b, g in zip(values, first, second, [f.features.T @ (y - p), seen - expected], strict=True):
            g = g / n - decay * v
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            v += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


@cache
def trained() -> Model:
    """The model of the labelled pages of page_labels, the same in every process."""
    from lakebranch.llm.page_labels import labelled_pages

    pages, labels = [], []
    for page, content in labelled_pages():
        nodes, kept = parse(page), set(content)
        mark = [bool(node.text) and node.text in kept for node in nodes]
        for i in range(len(nodes) - 1, 0, -1):  # an element is content if more of its text is than not
            if nodes[i].tag:
                mine = [j for j in range(i + 1, len(nodes)) if nodes[j].parent == i]
                good = sum(size(nodes, j) for j in mine if mark[j])
                mark[i] = 2 * good > size(nodes, i) > 0
        pages.append(nodes)
        labels += mark
    return fit(forest(pages), np.array(labels))


def size(nodes: list[Node], i: int) -> int:
    """Characters of the text blocks at or below a node."""
    inside, total = {i}, len(nodes[i].text)
    for j in range(i + 1, len(nodes)):
        if nodes[j].parent in inside:
            inside.add(j)
            total += len(nodes[j].text)
    return total


def main_texts(pages: list[str], model: Model) -> list[str]:
    """The main text of each page: its content blocks in page order, one a line."""
    out: list[list[str]] = [[] for _ in pages]
    f = forest([parse(x) for x in pages])
    p, _ = model.marginals(f)
    for i in np.flatnonzero(p > 0.5):
        if f.texts[i]:
            out[f.page[i]].append(f.texts[i])
    return ["\n".join(x) for x in out]


def extract(df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", model: Model | None = None) -> DataFrame:
    """(id, url, text, n_chars) of each row's whole page, without a shuffle; without a model, that of trained() is used.

    A null page is empty; a page without content has an empty text; repeated rows each give a row; an empty table gives none;
    other columns are left out.
    """
    spark = df.sparkSession
    shared.limit_batches(spark)
    sent = spark.sparkContext.broadcast(model or trained())
    rows = df.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.coalesce(F.col(html_column), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in shared.sliced(whole, "html", 1 << 20):
                texts = main_texts(batch.column("html").to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    kind, url_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "url"))
    out = rows.mapInArrow(run, f"id {kind}, url {url_kind}, text string")
    return out.select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text", F.length("text").cast("long").alias("n_chars"))
