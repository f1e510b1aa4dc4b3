"""Operator 13: the main text of web pages by a tree-structured graphical model.

Each element of a page's tree has one of three states: no main text inside, some,
nothing else; a text block has the first or the last.  Potentials of a node are
log-linear in what it is (tag, names in class, id and role, amount of text, share of
links, place), those between parent and child are a table for each kind of child, in
which the states keep their meaning: below "none" and "nothing else" nothing differs.
Messages go up from the blocks to the page and down again (sum-product); a block
belongs to the main text if its marginal says so.

The weights are fitted on labelled pages: up to ``MARKED`` pages of the table whose
author marks the main text, and ``LAYOUTS`` pages that set blocks of the table's
pages in other layouts (``html_layouts``).  Only this fit is on a bounded sample.
Extraction is one pass over all pages, whole, without a shuffle.

A block is a stretch of text between borders of block elements; ``<br>`` counts as
white space (see ``html_tree``).  Null or empty html gives an empty text, as does a
page without main text.  Pages are independent, so hot keys, ties and repeated rows
change nothing; other columns are ignored, whatever their names; an empty table
gives no rows.  Messages of very deep pages are exact too: depth is bounded by the
tree's reader.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, pieces
from .html_layouts import (ADVERT, COMMENTS, FOOTER, FORM, HEADER, MAIN, MARK, MENU, NOTICE, RELATED, SIDEBAR, TEXTS,
                           WRAPPERS, layout)
from .html_tree import HEADINGS, Page

#: Labelled pages of the table, the longest of them in characters, and pages set in layouts.
MARKED = 200
MARKED_CHARS = 200_000
LAYOUTS = 1000
#: Words of a block that go into layouts.
POOL_WORDS = 200
ROUNDS = 120
RATE = 0.2
DECAY = 2e-5
FORBIDDEN = 30.0
#: Bytes of pages whose messages are passed at once.
SLICE = 4 << 20

NONE, SOME, ALL = range(3)
_NAMES = sorted({part for group in (MAIN, WRAPPERS, HEADER, MENU, SIDEBAR, ADVERT, NOTICE, RELATED, COMMENTS, FOOTER, FORM)
                 for name in group for part in re.findall(r"[a-z]+", name.lower())} | {"hidden", "contentinfo", "article"})
#: Short names count as whole words only, longer ones inside of words, too.
_NAME = re.compile("|".join([f"(?<![a-z]){n}(?![a-z])" if len(n) < 4 else n
                             for n in sorted(_NAMES, key=lambda n: (-len(n), n))]))
_SPACED = re.compile(r"(?<=[a-z])(?=[A-Z])")
KINDS = ("block", "paragraph", "heading", "list", "table", "section", "other")
_KIND = {**dict.fromkeys(("p", "pre", "blockquote", "figure", "figcaption", "dl", "dd", "dt"), 1),
         **dict.fromkeys(HEADINGS, 2), **dict.fromkeys(("ul", "ol", "li", "menu"), 3),
         **dict.fromkeys(("table", "tbody", "thead", "tr", "td", "th"), 4),
         **dict.fromkeys(("article", "main", "section", "nav", "aside", "header", "footer", "form", "dialog"), 5)}


# --------------------------------------------------------------------------- nodes and features

def _level(n: int) -> int:
    return min(n.bit_length(), 10)


def _share(part: float, whole: float) -> int:
    x = part / whole if whole else 0
    return 0 if x == 0 else 1 if x < .2 else 2 if x < .5 else 3 if x < .9 else 4


class Nodes:
    """A page's nodes with text inside: elements, then blocks; parents come before
    their children.  ``features`` are names, turned to numbers by the model."""

    def __init__(self, page: Page):
        n, m = len(page.tag), len(page.owner)
        words, chars, linked, blocks = [0] * n, [0] * n, [0] * n, [0] * n
        size = [len(t.split()) for t in page.text]
        for k, owner in enumerate(page.owner):
            words[owner] += size[k]
            chars[owner] += len(page.text[k])
            linked[owner] += page.linked[k]
            blocks[owner] += 1
        for i in range(n - 1, 0, -1):
            up = page.parent[i]
            words[up] += words[i]
            chars[up] += chars[i]
            linked[up] += linked[i]
            blocks[up] += blocks[i]
        alike: dict = {}  # children of an element with the same tag
        for i in range(1, n):
            if blocks[i]:
                key = page.parent[i], page.tag[i]
                alike[key] = alike.get(key, 0) + 1
        place, self.parent, self.depth, self.kind, self.features = {}, [], [], [], []
        for i in range(n):
            if not blocks[i] and i:
                continue
            up = place.get(page.parent[i], -1)
            place[i] = len(self.parent)
            self.parent.append(up)
            self.depth.append(self.depth[up] + 1 if up >= 0 else 0)
            self.kind.append(_KIND.get(page.tag[i], 6))
            found = [f"tag {page.tag[i]}", f"words {_level(words[i])}", f"links {_share(linked[i], chars[i])}",
                     f"part {_share(words[i], words[0])}", f"mean {_level(words[i] // max(1, blocks[i]))}"]
            if i:
                found += [f"tag {page.tag[i]} in {page.tag[page.parent[i]]}",
                          f"alike {min(3, alike[page.parent[i], page.tag[i]])} {_KIND.get(page.tag[i], 6)}"]
            if page.names[i]:
                found += {f"name {x}" for x in _NAME.findall(_SPACED.sub(" ", page.names[i]).lower())}
            self.features.append(found)
        before = 0
        for k, owner in enumerate(page.owner):
            text = page.text[k]
            self.parent.append(place[owner])
            self.depth.append(self.depth[place[owner]] + 1)
            self.kind.append(0)
            found = [f"block words {_level(size[k])}", f"block links {_share(page.linked[k], len(text))}",
                     f"block place {5 * before // max(1, words[0])}", f"block in {page.tag[owner]}",
                     f"block ends {text[-1] in '.!?…。！？:\"”»'}"]
            if "©" in text:
                found.append("block sign")
            self.features.append(found)
            before += size[k]
        self.elements, self.blocks = len(place), m

    def states(self, main: list[bool]) -> list[int]:
        """States of all nodes, given which blocks are main text."""
        yes, no = [0] * len(self.parent), [0] * len(self.parent)
        for k, inside in enumerate(main):
            at = self.elements + k
            yes[at], no[at] = int(inside), int(not inside)
        for at in range(len(self.parent) - 1, 0, -1):
            yes[self.parent[at]] += yes[at]
            no[self.parent[at]] += no[at]
        return [NONE if not y else ALL if not x else SOME for y, x in zip(yes, no)]


class Forest:
    """Nodes of many pages as arrays, in order of depth."""

    def __init__(self, pages: list[Nodes], number: dict[str, int]):
        sizes = [len(p.parent) for p in pages]
        base = np.cumsum([0] + sizes)
        depth = np.fromiter((d for p in pages for d in p.depth), np.int64, base[-1])
        order = np.argsort(depth, kind="stable")
        self.place = np.empty_like(order)  # where a node has gone
        self.place[order] = np.arange(len(order))
        self.base = base
        parent = np.fromiter((x for p in pages for x in p.parent), np.int64, base[-1])
        above = np.where(parent < 0, -1, self.place[parent + np.repeat(base[:-1], sizes)])
        self.parent = above[order]
        self.kind = np.fromiter((k for p in pages for k in p.kind), np.int64, base[-1])[order]
        cut = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
        self.levels = [slice(x, y) for x, y in zip(cut, cut[1:])]
        self.inner = slice(cut[1], len(order))
        self.block = self.kind == 0
        found = [number.get(x, -1) for p in pages for features in p.features for x in features]
        many = np.fromiter((len(features) for p in pages for features in p.features), np.int64, base[-1])
        feature, at = np.array(found, np.int64), self.place[np.repeat(np.arange(base[-1]), many)]
        self.at, self.feature = at[feature >= 0], feature[feature >= 0]

    def beliefs(self, unary: np.ndarray, pair: np.ndarray):
        """Marginals of nodes, and of (parent, child) pairs below the roots: up, then down."""
        n, factor = len(self.parent), np.exp(pair)[self.kind]
        score = np.stack([np.bincount(self.at, unary[self.feature, s], n) for s in range(3)], 1)
        score[self.block, SOME] = -np.inf
        up, own, above = np.zeros((n, 3)), np.zeros((n, 3)), np.zeros((n, 3))
        for level in self.levels[:0:-1]:
            top = score[level].max(1, keepdims=True)
            own[level] = np.exp(score[level] - top)
            up[level] = np.log((factor[level] * own[level][:, None, :]).sum(2)) + top
            np.add.at(score, self.parent[level], up[level])
        full = score
        for level in self.levels[1:]:
            down = full[self.parent[level]] - up[level]
            top = down.max(1, keepdims=True)
            above[level] = np.exp(down - top)
            full[level] += np.log((factor[level] * above[level][:, :, None]).sum(1)) + top
        marginal = np.exp(full - full.max(1, keepdims=True))
        marginal /= marginal.sum(1, keepdims=True)
        joint = above[self.inner][:, :, None] * factor[self.inner] * own[self.inner][:, None, :]
        return marginal, joint / joint.sum((1, 2), keepdims=True)


# --------------------------------------------------------------------------- the model

class Model:
    def __init__(self, number: dict[str, int], unary: np.ndarray, pair: np.ndarray):
        self.number, self.unary, self.pair = number, unary, pair

    def marginals(self, pages: list[Nodes]) -> list[np.ndarray]:
        """For each page, the probability of each block to be main text."""
        if not pages:
            return []
        forest = Forest(pages, self.number)
        marginal = forest.beliefs(self.unary, self.pair)[0][:, ALL]
        return [marginal[forest.place[b + p.elements:b + p.elements + p.blocks]] for b, p in zip(forest.base, pages)]


def fit(labelled: list[tuple[Nodes, list[bool]]], rounds: int = ROUNDS) -> Model:
    """Penalised likelihood of the labels by gradient ascent: observed minus expected
    counts of features and of pairs of states."""
    labelled = [(nodes, main) for nodes, main in labelled if nodes.blocks]
    pages = [nodes for nodes, _ in labelled]
    number = {x: i for i, x in enumerate(sorted({x for p in pages for found in p.features for x in found}))}
    forest = Forest(pages, number)
    n, inner = len(forest.parent), forest.inner
    state = np.empty(n, np.int64)
    state[forest.place] = np.concatenate([np.array(p.states(main)) for p, main in labelled])
    one = np.eye(3)[state]
    kinds = np.eye(len(KINDS))[forest.kind[inner]]
    observed = np.zeros((len(KINDS), 3, 3))
    np.add.at(observed, (forest.kind[inner], state[forest.parent[inner]], state[inner]), 1)
    unary, pair = np.zeros((len(number), 3)), np.zeros((len(KINDS), 3, 3))
    # no main text inside: none in a child; nothing else: nothing else in a child
    free = np.zeros((3, 3))
    free[SOME] = free[NONE, NONE] = free[ALL, ALL] = 1
    pair -= FORBIDDEN * (1 - free)
    moments = [np.zeros_like(x) for x in (unary, unary, pair, pair)]
    for step in range(1, rounds + 1):
        marginal, joint = forest.beliefs(unary, pair)
        gap = one - marginal
        slope = np.stack([np.bincount(forest.feature, gap[forest.at, s], len(number)) for s in range(3)], 1)
        expected = (kinds.T @ joint.reshape(-1, 9)).reshape(observed.shape)
        for k, (w, g) in enumerate(((unary, slope), (pair, (observed - expected) * free))):
            g = g / n - DECAY * (w if k == 0 else w * free)
            m, v = moments[2 * k], moments[2 * k + 1]
            m += .1 * (g - m)
            v += .01 * (g * g - v)
            w += RATE * (m / (1 - .9 ** step)) / (np.sqrt(v / (1 - .99 ** step)) + 1e-8)
    return Model(number, unary, pair)


def _marked(html: str):
    """A page whose author marks the main text: its nodes and which blocks are marked."""
    page = Page(html)
    inside, holders = [False] * len(page.tag), []
    for kind in ("article", "main"):
        holders = holders or [i for i, tag in enumerate(page.tag) if tag == kind]
    if len(holders) != 1:
        return None
    out = {"nav", "aside", "footer", "form"}
    for i in range(1, len(page.tag)):
        inside[i] = (i == holders[0] or inside[page.parent[i]]) and page.tag[i] not in out
    main = [inside[o] for o in page.owner]
    return (Nodes(page), main) if any(main) else None


def layout_page(number: int, texts: list[str]) -> tuple[Nodes, list[bool]]:
    page = Page(layout(number, texts))
    main = [t.startswith(MARK) for t in page.text]
    page.text = [t.replace(MARK, "") or "-" for t in page.text]
    return Nodes(page), main


def train(pages: DataFrame, column: str = "html", marked: int = MARKED, layouts: int = LAYOUTS) -> Model:
    """The model for a table of pages, from a bounded sample of them."""
    key = F.xxhash64("html").alias("key")
    short = pages.select(F.col(column).alias("html")).where(F.length("html").between(1, MARKED_CHARS))
    n = short.count()
    share = min(1.0, 2 * marked / n) if n else 1.0
    sample = short.select(key, "html").where(F.pmod("key", F.lit(1 << 40)) < int(share * (1 << 40)) + 1) \
        .groupBy("key").agg(F.first("html").alias("html")).orderBy("key").limit(marked).collect()
    texts = [" ".join(t.split()[:POOL_WORDS]) for r in sample for t in Page(r["html"]).text]
    texts = sorted(set(texts)) or list(TEXTS)
    labelled = [x for r in sample if (x := _marked(r["html"]))]
    labelled += [layout_page(k, texts) for k in range(layouts)]
    return fit(labelled)


# --------------------------------------------------------------------------- extraction

def main_texts(html: list[str | None], model: Model) -> list[str]:
    pages = [Page(h or "") for h in html]
    nodes = [Nodes(p) for p in pages]
    return ["\n".join(t for t, x in zip(p.text, share) if x > .5)
            for p, share in zip(pages, model.marginals(nodes))]


def extract(pages: DataFrame, model: Model | None = None, column: str = "html",
            keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep`` and ``text``, the main text of each page."""
    model = model or train(pages, column)
    chosen = pages.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col(column).alias("html"))
    names = [f"c{i}" for i in range(len(keep))] + ["text"]
    given = model.number, model.unary, model.pair

    def rows(batches):
        mine = Model(*given)
        for batch in batches:
            for part in pieces(batch, "html", SLICE):
                text = pa.array(main_texts(part.column("html").to_pylist(), mine), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:-1]), text], names)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    out = chosen.mapInArrow(rows, ", ".join([*kinds, "text string"]))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "text")


def op13_html_extract(spark, sf_dir):
    return extract(documents(spark, sf_dir, "pages")) \
        .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
