"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every block element of a page is a node with features: density and links of its subtree, tokens of
its attributes, depth, its place among siblings, its tag and its ancestors' tags. Boosted trees
give each node a probability of belonging to the article. A page is then decoded as a whole: among
all labellings in which everything under a dropped node is dropped, the most probable is taken, so
no kept block stands inside dropped navigation. The texts of kept nodes come out in page order.

Training needs no hand labels. A bounded sample of pages (about ``max_pages``, by hash of key and
page) is used twice over. Pages that mark their article are used as they are: what the mark holds is
the article, but for navigation, forms and the like told by their tag; blocks inside it whose
attributes sound like something else teach nothing. And the texts of every sampled page are set anew
in layouts drawn at random, whose parts are told by tags or only by class names, so that all the
features are learnt; without a mark, a page's longer texts stand for an article.

Defined cases: a null, blank or textless page gives an empty text; broken markup is read to its end;
repeated rows and extra columns pass through; an output's name is replaced; if no sampled page has
text there is nothing to learn from, and no block is dropped.
"""

from __future__ import annotations

import html as entities
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from phenospark.llm.bpe import replace_column, with_field
from phenospark.llm.common import prepare
from phenospark.llm.dom import Dom, node_features
from phenospark.runtime import materialize

BOILER_TAGS = ("nav", "header", "footer", "aside", "form")
LAYOUTS = 2
BLOCKS_IN_LAYOUT = 40


@dataclass(frozen=True)
class Trees:
    """Boosted trees as flat arrays: feature, threshold, children, leaf value, each tree's root; fixed size."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-2 * self.value[at].sum(axis=1)))


def _flatten(model) -> Trees:
    """Read the fitted trees; a leaf is its own child."""
    rows, roots = [], []

    def add(node, weight: float) -> int:
        at = len(rows)
        rows.append([0, np.inf, at, at, node.prediction() * weight])
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            rows[at][:2] = split.featureIndex(), split.threshold()
            rows[at][2] = add(node.leftChild(), weight)
            rows[at][3] = add(node.rightChild(), weight)
        return at

    for tree, weight in zip(model.trees, model.treeWeights):
        roots.append(add(tree._call_java("rootNode"), weight))
    f, t, l, r, v = zip(*rows)
    return Trees(np.array(f), np.array(t), np.array(l), np.array(r), np.array(v), np.array(roots), max(t.depth for t in model.trees))


def parts_of(dom: Dom) -> list[bool | None] | None:
    """Which runs lie in the marked article (None where attributes make it doubtful); None without a mark."""
    n = len(dom.tag)
    inside, boiler, doubtful = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        p = dom.parent[i]
        inside[i] = inside[p] or dom.tag[i] in ("article", "main")
        boiler[i] = boiler[p] or dom.tag[i] in BOILER_TAGS
        doubtful[i] = doubtful[p] or dom.boiler[i] > 0
    if not any(inside):
        return None
    return [None if inside[v] and not boiler[v] and doubtful[v] else inside[v] and not boiler[v] for v, _ in dom.runs]


def labelled(dom: Dom, keep: list[bool | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of nodes with text: 1 if some kept run lies in the subtree, 0 if all are
    known to be dropped; others are left out."""
    n = len(dom.tag)
    good, known, text = [0] * n, [0] * n, [0] * n
    for (v, _), k in zip(dom.runs, keep):
        text[v] += 1
        good[v] += k is True
        known[v] += k is not None
    for i in range(n - 1, 0, -1):
        p = dom.parent[i]
        good[p] += good[i]
        known[p] += known[i]
        text[p] += text[i]
    at = [i for i in range(n) if text[i] and (good[i] or known[i] == text[i])]
    return node_features(dom)[at], np.array([float(good[i] > 0) for i in at])


def some_words(text: str, most: int, rnd: random.Random) -> str:
    """Consecutive words from anywhere in a text."""
    words = text.split()
    n = min(len(words), rnd.randrange(1, most + 1))
    at = rnd.randrange(len(words) - n + 1) if words else 0
    return " ".join(words[at : at + n])


def relaid(blocks: list[str], boiler: list[str], rnd: random.Random) -> tuple[Dom, list[bool]]:
    """A page with the same texts in a random layout, and which of its runs are the article's."""
    esc, keep, out = entities.escape, [], []
    phrase = lambda: rnd.choice(boiler) if boiler else "more"
    names = {
        "nav": ["menu", "navbar", "main-nav", "breadcrumbs", "navigation"], "header": ["site-header", "masthead", "header", "topbar"],
        "footer": ["site-footer", "footer", "copyright", "bottom"], "aside": ["sidebar", "widget", "related-posts", "rail"],
        "form": ["newsletter", "subscribe", "search-form", "login"], "notice": ["cookie-notice", "notice", "alert", "consent"],
        "ad": ["ad", "ads", "advert", "sponsored", "promo", "banner"], "comments": ["comments", "comment-list", "replies", "discussion"],
    }

    def boilerplate(kind: str) -> None:
        tag = kind if kind in BOILER_TAGS and rnd.random() < 0.6 else rnd.choice(["div", "section"])
        mark = f' {rnd.choice(["class", "id"])}="{rnd.choice(names[kind])}"' if tag in ("div", "section") or rnd.random() < 0.5 else ""
        items = [phrase() if kind == "comments" and rnd.random() < 0.5 or not blocks else some_words(rnd.choice(blocks), 45, rnd) for _ in range(rnd.randrange(1, 6))]
        out.append(f"<{tag}{mark}>")
        style = rnd.randrange(3) if kind not in ("nav", "form") else kind == "form" and 3
        if style == 0:
            out.append("<ul>" + "".join(f'<li><a href="#">{esc(some_words(phrase(), 6, rnd))}</a></li>' for _ in items) + "</ul>")
            keep.extend([False] * len(items))
        elif style == 3:
            out.append(f"<label>{esc(some_words(phrase(), 6, rnd))}</label> <input name=q><button>ok</button>")
            keep.append(False)
        else:
            shown = items if style == 1 else [phrase()]
            wrap = rnd.choice(["p", "div"])
            out.append("".join(f"<{wrap}>{esc(x)}</{wrap}>" for x in shown))
            keep.extend([False] * len(shown))
        out.append(f"</{tag}>")

    before = [k for k in ("header", "nav", "notice", "ad", "aside") if rnd.random() < 0.5]
    after = [k for k in ("aside", "ad", "comments", "form", "footer") if rnd.random() < 0.5]
    inside = [k for k in ("ad", "comments", "aside", "form", "notice") if rnd.random() < 0.2]
    out.append("<html><body>")
    deep = rnd.randrange(3)
    out.append("<div>" * deep)
    for k in before:
        boilerplate(k)
    tag = rnd.choice(["article", "main", "div", "div", "section"])
    mark = f' class="{rnd.choice(["content", "post", "entry-content", "article-body", "story", "main", ""])}"' if tag != "article" else ""
    out.append(f"<{tag}{mark}>")
    places = {rnd.randrange(len(blocks) + 1): k for k in inside}
    for i, b in enumerate(blocks + [None]):
        if i in places:
            boilerplate(places[i])
        if b is not None:
            wrap = "h1" if i == 0 and rnd.random() < 0.5 else rnd.choice(["p", "p", "p", "li", "blockquote", "div", "h2"])
            out.append(f"<ul><li>{esc(b)}</li></ul>" if wrap == "li" else f"<{wrap}>{esc(b)}</{wrap}>")
            keep.append(True)
    out.append(f"</{tag}>")
    for k in after:
        boilerplate(k)
    out.append("</div>" * deep + "</body></html>")
    return Dom("".join(out)), keep


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xs, ys = [], []
        for html in batch.column("html").to_pylist():
            dom = Dom(html or "")
            if not dom.runs:
                continue
            keep = parts_of(dom)
            made = [] if keep is None else [(dom, keep)]
            rnd = random.Random(len(html))
            if keep is None or not any(keep):
                middle = sorted(len(t) for _, t in dom.runs)[len(dom.runs) // 2]
                keep = [len(t) >= middle for _, t in dom.runs]
            blocks = [t for (_, t), k in zip(dom.runs, keep) if k]
            boiler = [t for (_, t), k in zip(dom.runs, keep) if k is False]
            # a layout takes some of a very long page's blocks, from anywhere
            some = lambda: [blocks[i] for i in sorted(rnd.sample(range(len(blocks)), min(len(blocks), BLOCKS_IN_LAYOUT)))]
            made += [relaid(some(), boiler, rnd) for _ in range(LAYOUTS)]
            for d, k in made:
                if len(k) == len(d.runs):
                    x, y = labelled(d, k)
                    xs.append(x)
                    ys.append(y)
        x, y = (np.concatenate(xs), np.concatenate(ys)) if xs else (np.empty((0, 1)), np.empty(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array(y)], ["x", "label"])


def fit(pages: DataFrame, max_pages: int = 400, rounds: int = 30, depth: int = 5, html: str = "html", key: str = "page_id") -> Trees | None:
    """Fit the trees on about ``max_pages`` pages; None if none of them has text."""
    prepare(pages.sparkSession)
    sample = pages.where(F.col(html).isNotNull()).select(F.col(html).alias("html"), F.xxhash64(F.col(key), F.col(html)).alias("h"))
    n = sample.count()
    place = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    # dealt out again, as few of many tasks hold a chosen page; equal pages teach once
    sample = sample.where(place < min(1.0, max_pages / max(n, 1))).dropDuplicates(["h"]).select("html")
    nodes = materialize(sample.mapInArrow(_examples, "x array<double>, label double"), "nodes")
    if nodes.select("label").distinct().count() < 2:
        return None
    vectors = nodes.select(array_to_vector("x").alias("features"), "label")
    return _flatten(GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=1, maxBins=32).fit(vectors))


def decode(dom: Dom, p: np.ndarray) -> list[bool]:
    """The most probable labelling in which a dropped node drops all below it."""
    n = len(dom.tag)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    has = [0] * n
    for v, _ in dom.runs:
        has[v] += 1
    yes, no = np.log(p), np.log(1 - p)
    keep, drop = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if has[i]:
            keep[i] += yes[i]
            drop[i] += no[i]
        q = dom.parent[i]
        if q >= 0 and has[i]:
            has[q] += 1
            keep[q] += max(keep[i], drop[i])
            drop[q] += drop[i]
    kept = [False] * n
    for i in range(n):
        q = dom.parent[i]
        kept[i] = (q < 0 or kept[q]) and keep[i] >= drop[i]
    return kept


def extract(pages: DataFrame, trees: Trees | None, html: str = "html", out: str = "text") -> DataFrame:
    """Add the main text: kept blocks in page order, joined by a blank line."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            doms = [Dom(h or "") for h in batch.column(html).to_pylist()]
            if model is not None and doms:
                found = [node_features(d) for d in doms]
                p = model.probability(np.concatenate(found))
                kept = [decode(d, q) for d, q in zip(doms, np.split(p, np.cumsum([len(x) for x in found])[:-1]))]
            else:
                kept = [[True] * len(d.tag) for d in doms]
            texts = ["\n\n".join(t for v, t in d.runs if k[v]) for d, k in zip(doms, kept)]
            yield replace_column(batch, out, pa.array(texts, pa.string()))

    return pages.mapInArrow(run, with_field(pages.schema, out, StringType()))
