"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every element has features of its own and of its subtree: depth, text and link density, attribute tokens,
siblings. Trees give each element the log-odds of leading to main text. Decoding keeps an element only
below a kept parent and maximises the summed log-odds over the whole tree, so an ancestor and its
descendants never contradict each other. The text of kept elements makes the blocks.

Training labels come from pages that mark their article: its elements and their ancestors are main, all
others are not. The features must not see the mark, or the trees would look for it alone: each training page
is also learned from with its marking elements named as other containers, drawn by the page's id, and a mark
counts as the tag div wherever it stands. Only elements that never hold prose (scripts, styles, form
controls, the head) are dropped by name; formulas, captions and fallback texts are left to the trees.

Rows with equal page_id are pages of their own; other columns are ignored. A null page is empty.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encaje.llm.common import bounded_sample, by_batch, fields, strings
from encaje.session import written

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style template iframe select option textarea button head title".split())
NAMES = ("div", "section", "td", "div", "main", "span")  # what a marking element may be called instead
CLOSES = {  # a start tag ends an open element of these kinds, up to the nearest of the stops
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
TAGS = ("html body div article main section nav header footer aside form ul ol li p h1 h2 h3 h4 h5 h6 "
        "a span b strong i em table tr td th blockquote pre figure figcaption img br script style "
        "head title button input label select").split()
TAG_NUMBER = {t: i + 1 for i, t in enumerate(TAGS)}
MARKERS = frozenset({"article", "main"})
TOKENS = 32  # buckets of attribute tokens
SCORED = 10_000  # elements
SPACE = re.compile(r"\s+")
TOKEN = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Settings:
    """``fit_pages`` bounds the pages that train the trees."""

    fit_pages: int = 600
    trees: int = 30
    depth: int = 4
    rate: float = 0.3
    bins: int = 32
    seed: int = 4


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: list[int] = field(default_factory=list)
    marked: bool = False


class Tree(HTMLParser):
    """Elements in page order, and their texts as (element, text, starts a block)."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root", -1, 0)]
        self.open = [0]
        self.texts: list[tuple[int, str, bool]] = []
        self.fresh = True
        self.feed(html)
        self.close()

    def _end(self, at: int) -> None:
        for i in self.open[at:]:
            self.fresh |= self.nodes[i].tag in BLOCK
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        nodes = self.nodes
        if tag in ("html", "body") and any(nodes[i].tag == tag for i in self.open):
            return
        if tag in BLOCK:
            for k in range(len(self.open) - 1, 0, -1):
                if nodes[self.open[k]].tag == "p":
                    self._end(k)
                    break
                if nodes[self.open[k]].tag in BLOCK:
                    break
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            for k in range(len(self.open) - 1, 0, -1):
                if nodes[self.open[k]].tag in stops:
                    break
                if nodes[self.open[k]].tag in ends:
                    self._end(k)
                    if tag not in ("tr",):
                        break
        tokens = []
        marked = tag in MARKERS
        for key, value in attrs:
            if key in ("class", "id", "role", "itemprop", "aria-label") and value:
                tokens += [zlib.crc32(t.encode()) % TOKENS
                           for t in TOKEN.findall(value.lower())]
                marked |= key == "itemprop" and value == "articleBody"
                marked |= key == "role" and value == "main"
        self.fresh |= tag in BLOCK
        if tag == "br":
            self.handle_data(" ")
        nodes.append(Node(tag, self.open[-1], len(self.open), tokens, marked))
        if tag not in VOID:
            self.open.append(len(nodes) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.nodes[self.open[-1]].tag == tag and tag in ("svg", "path"):
            self._end(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[k]].tag == tag:
                self._end(k)
                return

    def handle_data(self, data: str) -> None:
        self.texts.append((self.open[-1], data, self.fresh))
        self.fresh = False


FEATURES = 12 + 2 * TOKENS


def _tag_number(tag: str) -> int:
    """Marks count as div, and what has no number (formulas, fallbacks) as an inline element."""
    if tag == "#root" or tag in VOID:
        return TAG_NUMBER.get(tag, 0)
    return TAG_NUMBER["div" if tag in MARKERS else tag if tag in TAG_NUMBER else "span"]


def features(tree: Tree) -> np.ndarray:
    """A row per element, the root included."""
    n = len(tree.nodes)
    parent = np.array([x.parent for x in tree.nodes])
    depth = np.array([x.depth for x in tree.nodes], dtype=float)
    tag = np.array([_tag_number(x.tag) for x in tree.nodes])
    own, links = np.zeros(n), np.zeros(n)
    in_link = np.zeros(n, dtype=bool)
    tokens, above = np.zeros((n, TOKENS)), np.zeros((n, TOKENS))
    for i, x in enumerate(tree.nodes):
        in_link[i] = x.tag == "a" or (x.parent >= 0 and in_link[x.parent])
        for t in x.tokens:
            tokens[i, t] = 1
        if x.parent >= 0:
            np.maximum(above[x.parent], tokens[x.parent], out=above[i])
    points = np.zeros(n)
    for i, text, _ in tree.texts:
        size = len(text.strip())
        own[i] += size
        points[i] += sum(map(text.count, ".,;:!?"))
        links[i] += size if in_link[i] else 0
    total, elements, below, marks = own.copy(), np.ones(n), links.copy(), points.copy()
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = parent[i]
        total[p] += total[i]
        elements[p] += elements[i]
        below[p] += below[i]
        marks[p] += marks[i]
    up = np.maximum(parent, 0)
    siblings = np.bincount(up[1:], minlength=n)[up] if n > 1 else np.zeros(n)
    order = np.zeros(n)
    seen: dict[int, int] = {}
    for i in range(1, n):
        seen[parent[i]] = seen.get(parent[i], -1) + 1
        order[i] = seen[parent[i]]
    whole = max(total[0], 1.0)
    return np.column_stack([
        tag, depth, np.log1p(own), np.log1p(total), total / elements, below / np.maximum(total, 1),
        siblings, order / np.maximum(siblings, 1), tag[up], total / whole,
        np.log1p(total[up]), marks / np.maximum(total, 1), tokens, above])


def labels(tree: Tree) -> np.ndarray | None:
    """1 for elements in or above marked articles, 0 elsewhere; None if nothing is marked."""
    n = len(tree.nodes)
    inside, leads = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    for i, x in enumerate(tree.nodes):
        inside[i] = (x.marked or (x.parent >= 0 and inside[x.parent])) and not _boiler(x.tag)
    for i in range(n - 1, 0, -1):
        if inside[i] or leads[i]:
            leads[tree.nodes[i].parent] = True
    return (inside | leads).astype(float) if inside.any() else None


def _boiler(tag: str) -> bool:
    return tag in RAW or tag in ("nav", "aside", "form", "footer")


class Boosted:
    """Gradient-boosted trees for log-odds, on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, settings: Settings) -> None:
        self.depth, self.rate = settings.depth, settings.rate
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return
        edges = [np.unique(np.quantile(x[:, j], np.arange(1, settings.bins) / settings.bins))
                 for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, j], side="right")
                                  for j, e in enumerate(edges)])
        score = np.full(len(y), self.base)
        for _ in range(settings.trees):
            p = 1 / (1 + np.exp(-score))
            score += self._tree(binned, edges, y - p, p * (1 - p), settings)

    def _tree(self, binned: np.ndarray, edges: list, grad: np.ndarray, hess: np.ndarray,
              settings: Settings) -> np.ndarray:
        nodes = 2 ** (self.depth + 1)
        feature, cut = np.full(nodes, -1), np.zeros(nodes)
        value, at = np.zeros(nodes), np.ones(len(grad), dtype=np.int64)
        for node in range(1, nodes):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            g, h = grad[rows].sum(), hess[rows].sum()
            value[node] = self.rate * np.clip(g / (h + 1.0), -4, 4)
            if node >= nodes // 2 or len(rows) < 8:
                continue
            best, pick = 1e-6, None
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, grad[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, hess[rows], len(e) + 1))[:-1]
                gain = gl ** 2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g ** 2 / (h + 1)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, pick = float(gain[k]), (j, k)
            if pick:
                feature[node], cut[node] = pick[0], edges[pick[0]][pick[1]]
                at[rows] = 2 * node + (binned[rows, pick[0]] > pick[1])
        self.trees.append((feature, cut, value))
        return value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        out, row = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.ones(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + (x[row, np.maximum(f, 0)] >= cut[node]))
            out += value[node]
        return out


def decode(tree: Tree, score: np.ndarray) -> np.ndarray:
    """Which elements are kept: the best sum of log-odds where nothing is kept under a dropped
    parent. Elements that never hold prose are dropped; a phrase inside a block that has no attributes
    of its own (emphasis, a formula, a fallback) has no case against it and follows its parent."""
    n = len(tree.nodes)
    score = score.copy()
    for i, x in enumerate(tree.nodes):
        if x.tag in RAW:
            score[i] = -1e6
        elif i and x.tag not in BLOCK and x.tag not in VOID and x.tag not in ("a", "html") and not x.tokens:
            score[i] = max(score[i], 1e-6)
    keep, drop = score.copy(), -score
    for i in range(n - 1, 0, -1):
        p = tree.nodes[i].parent
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    kept = np.zeros(n, dtype=bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[tree.nodes[i].parent] and keep[i] > drop[i]
    return kept


def blocks(tree: Tree, kept: np.ndarray) -> str:
    """Kept texts in page order; a block ends where a block element starts or ends."""
    out: list[list[str]] = []
    fresh = True
    for i, text, starts in tree.texts:
        fresh |= starts
        if kept[i]:
            if fresh or not out:
                out.append([])
                fresh = False
            out[-1].append(text)
    joined = (SPACE.sub(" ", "".join(b)).strip() for b in out)
    return "\n\n".join(b for b in joined if b)


def extract(pages: list[str], model: Boosted) -> list[str]:
    """Main text of each page; empty if there is none. The elements of several pages are scored at
    once, up to ``SCORED`` and those of one page more."""
    out = [""] * len(pages)
    group: list[tuple[int, Tree]] = []
    size = 0
    for i, html in enumerate(pages):
        if html.strip():
            group.append((i, Tree(html)))
            size += len(group[-1][1].nodes)
        if group and (size >= SCORED or i == len(pages) - 1):
            scores = model.score(np.concatenate([features(tree) for _, tree in group]))
            at = 0
            for k, tree in group:
                n = len(tree.nodes)
                out[k] = blocks(tree, decode(tree, scores[at:at + n]))
                at += n
            group, size = [], 0
    return out


def renamed(tree: Tree, name: str) -> Tree:
    """The same page with another tag on its marking elements."""
    for node in tree.nodes:
        if node.tag in MARKERS:
            node.tag = name
    return tree


def fit(pages: DataFrame, settings: Settings = Settings()) -> Boosted:
    """Train on a bounded sample of the pages that mark an article; without such pages every element
    is kept but those that never hold prose.

    The sample is drawn over the ids alone; only its pages are read whole.
    """
    named = pages.where("html IS NOT NULL")
    ids = written(bounded_sample(named.select("page_id"), F.col("page_id"), settings.fit_pages).distinct(),
                  "fit-pages")  # at most fit_pages ids
    sample = named.select("page_id", "html").join(
        F.broadcast(ids), "page_id", "left_semi").withColumn("n", F.row_number().over(
            Window.partitionBy("page_id").orderBy(F.xxhash64("html")))).where("n = 1")

    def rows(page_id: pa.Array, html: pa.Array) -> list[list]:
        out: list[list] = [[], []]
        for i, text in zip(page_id.to_pylist(), strings(html)):
            tree, x, y = Tree(text), [], []
            found = labels(tree)
            if found is not None:
                draw = zlib.crc32(str(i).encode())
                for name in (NAMES[draw % len(NAMES)], NAMES[draw // 8 % len(NAMES)]):
                    x += features(renamed(Tree(text), name)).ravel().tolist()
                    y += found.tolist()
            out[0].append(x)
            out[1].append(y)
        return out

    got = by_batch(sample, ["page_id", "html"], fields("x array<double>, y array<double>"),
                   rows, keep=["page_id"]).collect()
    got = sorted((r for r in got if r["y"]), key=lambda r: str(r["page_id"]))
    x = np.array([v for r in got for v in r["x"]]).reshape(-1, FEATURES)
    y = np.array([v for r in got for v in r["y"]])
    if not len(y):
        y = np.ones(1)
        x = np.zeros((1, FEATURES))
    return Boosted(x, y, settings)


def main_text(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """page_id, url, text, n_chars of every page; a null or blank page has an empty text."""
    model = fit(pages, settings)

    def run(html: pa.Array) -> list[list]:
        out = extract(strings(html), model)
        return [out, [len(t) for t in out]]

    return by_batch(pages, ["html"], fields("text string, n_chars long"), run,
                    keep=["page_id", "url"])
