"""Main body of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page is parsed into its elements and, as leaves, its text blocks (stretches of text between tags other than
inline ones). Every node gets features: what its subtree holds (text, links, punctuation, headings, list items,
text that recurs on the site, wording), its attribute tokens and those above it (each token by its log-odds for main
body, learnt from the sample), depth, place in the page and among
its siblings, and the subtree figures of its parent and grandparent. Boosted trees give each node a log-odds of being
main body. Decoding then chooses for each subtree between keeping all of it, dropping all of it and deciding its
children one by one, whichever agrees best with all scores, so that no kept block lies in a dropped ancestor. Two
things are known beforehand and enter the decoding as scores that no other outweighs: the page heading (h1) is main
body wherever it stands, and a page has some text beside its headings, if only a message in the article's place: where
decoding would keep headings alone, the likeliest text is given and the page decoded again.

Fit: on a bounded sample (`SAMPLE_PAGES` pages, at most `PAGES_PER_SITE` of a site and `SAMPLE_CHARS` long, chosen by
hash; the trees see `TREE_PAGES` of them). Its labels come
from pages whose markup says where the article is: blocks in the article's own element are main body unless they
recur on the site or stand in a part marked as something else. Every sampled page is seen again without its telling
tags and tokens and with shuffled ones, so that the trees learn from structure, place and wording too; they are then
applied to all pages alike.

Text that recurs on a site is counted over all pages (5 pages and a tenth of the site's pages at least), and so are the
sites of short lines, the site's own name left out (5 sites at least).

Defined results: null and empty pages, and pages without text, give no block; a page of one site only, or with a null
URL, counts no recurrences; repeated rows count once (by id); equal blocks of a page are one result row per key.
"""

from __future__ import annotations

import copy
import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..html.tokens import MAX_DEPTH, TOKEN, VOID, ended_by
from ..runtime import materialize
from .site_lines import hot_join, host_of

SAMPLE_PAGES, TREE_PAGES, PAGES_PER_SITE, SAMPLE_CHARS = 2000, 700, 20, 100_000
MIN_DOCS, MIN_SHARE = 5, 0.1
#: A short line on so many sites is common; beside other text it is not of their articles (label rule).
MIN_SITES, MAX_LINE = 5, 160
MAX_BROADCAST_KEYS = 4_000_000
N_TREES, TREE_DEPTH, RATE, BINS, ROW_SHARE, FEATURE_SHARE = 60, 5, 0.2, 32, 0.35, 0.6
MAX_WORDS, MAX_TOKENS = 20_000, 5_000
#: Weight of an inner node's log-odds against the sum over its leaves.
NODE_WEIGHT = 0.5
#: Log-odds of what is known to be main body, above any sum of others.
KNOWN = 1e6
#: A page's only text is main body from these log-odds on.
LEAST_LOG_ODDS = -4.0

INLINE = frozenset("a abbr b br code em i small span strong u".split())
_TAGS = "text div p li ul ol h1 h2 h3 h4 h5 h6 td th tr table blockquote pre section article main aside nav header footer form figure figcaption dl dd dt title body html head noscript button label".split()
_TAG = {t: k for k, t in enumerate(_TAGS)}
_DIV = _TAG["div"]
_TELLING = np.array([_TAG[t] for t in ("section", "article", "main", "aside", "nav", "header", "footer")])
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names that bar an element from the article (label rule of the fit).
_BAD = frozenset("nav navigation menu sidebar widget footer foot header masthead colophon cookie cookies consent banner share sharing sharedaddy social comment comments commentlist related teaser teasers promo ad ads sponsor breadcrumb breadcrumbs subscribe newsletter signup login search tags meta byline author popup modal legal copyright pagination pager".split())
_TOKENS = re.compile(r"[a-z]+")
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d")
#: Names that mark an element as holding the article (label rule of the fit).
_ARTICLE_TOKENS = ("entry-content", "post-content", "article-body", "articlebody", "article-content", "post-body", "story-body")


class Nodes:
    """Flat trees of a batch of pages; parents come before children."""

    def __init__(self):
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.tag: list[int] = []
        self.names: list[tuple[str, ...]] = []
        self.bad: list[bool] = []
        self.trusted: list[bool] = []
        self.leaf: list[int] = []  # nodes that are text blocks
        self.text: list[str] = []
        self.linked: list[int] = []
        self.root: list[int] = []

    def add(self, parent: int, depth: int, tag: int, names: tuple[str, ...] = (), bad: bool = False, trusted: bool = False) -> int:
        self.parent.append(parent)
        self.depth.append(depth)
        self.tag.append(tag)
        self.names.append(names)
        self.bad.append(bad)
        self.trusted.append(trusted)
        return len(self.parent) - 1

    def page(self, source: str) -> None:
        root = self.add(-1, 0, _DIV)
        self.root.append(root)
        names, nodes = [""], [root]
        parts: list[str] = []
        linked = in_link = at = 0
        unescape = entities.unescape

        def flush():
            nonlocal linked
            if parts:
                raw = "".join(parts)
                text = " ".join((unescape(raw) if "&" in raw else raw).split())
                if text:
                    k = self.add(nodes[-1], len(nodes), 0)
                    self.leaf.append(k)
                    self.text.append(text)
                    self.linked.append(min(linked, len(text)))
                parts.clear()
            linked = 0

        for m in TOKEN.finditer(source):
            start = m.start()
            if start > at:
                parts.append(source[at:start])
                if in_link:
                    linked += start - at
            at = m.end()
            name = m[3]
            if name is None:
                if m[1]:
                    flush()
                continue
            name = name.lower()
            if name in INLINE:
                if name == "br":
                    parts.append(" ")
                elif name == "a":
                    in_link = not m[2]
                continue
            flush()
            if m[2]:
                for k in range(len(names) - 1, 0, -1):
                    if names[k] == name:
                        del names[k:], nodes[k:]
                        break
                continue
            keep = ended_by(name, names)
            if keep < len(names):
                del names[max(keep, 1) :], nodes[max(keep, 1) :]
            if name in VOID:
                continue
            named: list[str] = []
            trusted = name == "article"
            attributes = m[4]
            if "=" in attributes:
                for g in _NAMED.finditer(attributes):
                    value = (g[1] or g[2] or g[3] or "").lower()
                    named += _TOKENS.findall(value)
                    trusted = trusted or any(t in value for t in _ARTICLE_TOKENS)
            bad = bool(named) and not _BAD.isdisjoint(named)
            node = self.add(nodes[-1], len(nodes), _TAG.get(name, _DIV), tuple(named), bad, trusted and not bad)
            if not m[0].endswith("/>") and len(names) < MAX_DEPTH:
                names.append(name)
                nodes.append(node)
        if at < len(source):
            parts.append(source[at:])
            if in_link:
                linked += len(source) - at
        flush()


def block_texts(source: str) -> list[str]:
    """The text blocks alone, without a tree."""
    nodes = Nodes()
    nodes.page(source)
    return nodes.text


def block_key(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:12]


def recurrence_key(site: int, text: str) -> int:
    """Hash of a block with digits, letter case and white space masked, salted by its site."""
    return xxhash.xxh3_64_intdigest(_DIGITS.sub("", text).casefold(), site & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def common_key(host: str | None, text: str) -> int | None:
    """Hash of a short line's words without the site's name; None for longer texts and single words."""
    if len(text) > MAX_LINE:
        return None
    names = _TOKENS.findall((host or "").split(".")[0])
    words = [w for w in _WORD.findall(text.lower()) if w not in names]
    return xxhash.xxh3_64_intdigest(" ".join(words), 1) - (1 << 63) if len(words) > 1 else None


def site_hash(host: str | None) -> int:
    return xxhash.xxh3_64_intdigest(host or "") - (1 << 63)


# ---- features


def _add(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """out[at] += values with repeated places; narrow levels of deep trees cost only their own size."""
    if len(at) * 20 < len(out):
        np.add.at(out, at, values)
    else:
        out += np.bincount(at, values, len(out))


class Table:
    """Arrays of a batch of pages, and the features of its nodes."""

    def __init__(self, nodes: Nodes, recurring: np.ndarray, common: np.ndarray, wording: np.ndarray, naming: dict[str, float] | None = None):
        self.parent, self.depth, self.tag = (np.array(x, np.int32) for x in (nodes.parent, nodes.depth, nodes.tag))
        self.names, self.bad = names_of(nodes.names, naming or {}), np.array(nodes.bad, bool)
        self.trusted = np.array(nodes.trusted, bool)
        self.leaf = np.array(nodes.leaf, np.int64)
        self.root = np.array(nodes.root, np.int64)
        n = len(self.parent)
        self.page = np.cumsum(np.isin(np.arange(n), self.root)) - 1
        self.levels = [np.flatnonzero(self.depth == d) for d in range(int(self.depth.max()) + 1)] if n else []
        texts = nodes.text
        self.chars = np.array([len(t) for t in texts], np.float32)
        self.words = np.array([t.count(" ") + 1 for t in texts], np.float32)
        self.ended = np.array([t[-1] in ".!?…" for t in texts], np.float32)
        self.linked = np.array(nodes.linked, np.float32)
        self.recurring, self.common = recurring.astype(np.float32), common.astype(np.float32)
        self.wording = wording.astype(np.float32)
        self.upper = np.array([t.isupper() for t in texts], np.float32)
        self.marks = np.array([("©" in t) + sum(t.count(c) for c in "·|/»") for t in texts], np.float32)
        self.digits = np.array([sum(map(t.count, "0123456789")) for t in texts], np.float32)

    def flattened(self) -> Table:
        """The same pages with the article's blocks beside what follows the article, as where it has no element of its own."""
        flat = copy.copy(self)
        above = np.maximum(self.parent, 0)
        lifted = self.trusted[above] & (self.parent >= 0)
        flat.parent = np.where(lifted, self.parent[above], self.parent)
        flat.depth = self.depth.copy()
        for level in self.levels[1:]:
            flat.depth[level] = flat.depth[flat.parent[level]] + 1
        flat.levels = [np.flatnonzero(flat.depth == d) for d in range(int(flat.depth.max()) + 1)]
        return flat

    def up(self, leaf_values: np.ndarray) -> np.ndarray:
        """Sums over subtrees of values given for leaves."""
        out = np.zeros(len(self.parent), np.float64)
        out[self.leaf] = leaf_values
        for level in reversed(self.levels[1:]):
            _add(out, self.parent[level], out[level])
        return out

    def features(self, tag: np.ndarray | None = None, names: np.ndarray | None = None) -> np.ndarray:
        tag = self.tag if tag is None else tag
        names = self.names if names is None else names
        n = len(self.parent)
        parent = np.maximum(self.parent, 0)
        has_parent = self.parent >= 0
        leaf_tag = tag[parent[self.leaf]]
        ones = np.ones(len(self.leaf), np.float32)
        chars, count = self.up(self.chars), self.up(ones)
        safe_chars, safe_count = np.maximum(chars, 1), np.maximum(count, 1)
        headings = (leaf_tag >= _TAG["h1"]) & (leaf_tag <= _TAG["h6"])
        link = self.up(self.linked) / safe_chars
        ended = self.up(self.ended) / safe_count
        recurring = self.up(self.recurring * self.chars) / safe_chars
        common = self.up(self.common * self.chars) / safe_chars
        wording = self.up(self.wording * self.words) / np.maximum(self.up(self.words), 1)
        heads = self.up(headings) / safe_count
        items = self.up(leaf_tag == _TAG["li"]) / safe_count
        paragraphs = self.up(leaf_tag == _TAG["p"]) / safe_count
        h1 = self.up(leaf_tag == _TAG["h1"])
        # place in the page: leaves before, leaves of the page, first h1
        order = np.zeros(n)
        order[self.leaf] = 1
        before = np.cumsum(order) - order
        first = before[self.root][self.page]
        total = count[self.root][self.page]
        place = (before - first) / np.maximum(total, 1)
        h1_at = np.full(len(self.root), -1.0)
        h1_leaves = self.leaf[leaf_tag == _TAG["h1"]][::-1]
        h1_at[self.page[h1_leaves]] = before[h1_leaves] - first[h1_leaves]
        from_h1 = np.clip(np.where(h1_at[self.page] < 0, -30, before - first - h1_at[self.page]), -30, 60)
        page_chars = chars[self.root][self.page]
        # siblings
        siblings = np.bincount(parent[has_parent], minlength=n)[parent]
        same = np.zeros(n)
        key = self.parent.astype(np.int64) * 64 + tag
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        same = counts[inverse]
        arranged = np.argsort(parent, kind="stable")
        starts = np.r_[True, parent[arranged][1:] != parent[arranged][:-1]]
        rank = np.empty(n)
        position = np.arange(n)
        rank[arranged] = position - np.maximum.accumulate(np.where(starts, position, 0))
        around = chars[parent] - chars
        # attribute tokens and telling tags on the way down
        path_names, worst = names.astype(np.float64), np.minimum(names, 0).astype(np.float64)
        tell = np.zeros((n, 2))
        tell[:, 0] = np.isin(tag, [_TAG["article"], _TAG["main"]])
        tell[:, 1] = np.isin(tag, [_TAG["aside"], _TAG["nav"], _TAG["header"], _TAG["footer"], _TAG["form"], _TAG["head"]])
        for level in self.levels[1:]:
            p = self.parent[level]
            path_names[level] += path_names[p]
            worst[level] = np.minimum(worst[level], worst[p])
            tell[level] += tell[p]
        is_leaf = np.zeros(n)
        is_leaf[self.leaf] = 1
        text_only = np.zeros((n, 3))
        text_only[self.leaf, 0], text_only[self.leaf, 1], text_only[self.leaf, 2] = self.upper, self.marks, self.digits / np.maximum(self.chars, 1)
        own = [np.log1p(chars), count, link, ended, recurring, wording, common, heads, items, paragraphs, h1, chars / safe_count]
        # the block's nearest neighbours in reading order
        neighbours = []
        for values in (np.log1p(self.chars), self.recurring, self.common, self.wording, self.linked / np.maximum(self.chars, 1)):
            padded = np.r_[0, values, 0]
            for shift in (0, 2):
                column = np.zeros(n)
                column[self.leaf] = padded[shift : shift + len(values)]
                neighbours.append(column)
        grand = parent[parent]
        columns = [
            is_leaf, tag, tag[parent], tag[grand], self.depth, from_h1, siblings, same, rank, around,
            names, names[parent], path_names, worst, tell[:, 0], tell[:, 1], text_only[:, 0], text_only[:, 1], text_only[:, 2],
            *own, *(x[parent] for x in own), *(x[grand] for x in own[:8]), *neighbours,
        ]
        return np.stack(columns, 1).astype(np.float32)


# ---- boosted trees


class Boosted:
    """Complete binary trees on binned features; a leaf value per bottom cell."""

    def __init__(self, edges: list[np.ndarray], features: np.ndarray, cuts: np.ndarray, values: np.ndarray, bias: float):
        self.edges, self.features, self.cuts, self.values, self.bias = edges, features, cuts, values, bias

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned = bin_features(x, self.edges)
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.features, self.cuts, self.values):
            node = np.zeros(len(x), np.int64)
            for _ in range(TREE_DEPTH):
                node = 2 * node + 1 + (binned[feature[node], rows] > cut[node])
            out += value[node - (2**TREE_DEPTH - 1)]
        return out


def feature_edges(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]


def bin_features(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins as bytes, one row per feature."""
    out = np.empty((len(edges), len(x)), np.uint8)
    for k, e in enumerate(edges):
        out[k] = np.searchsorted(e, x[:, k], side="right")
    return out


def fit_boosted(edges: list[np.ndarray], binned: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Boosted:
    """Newton boosting of the logistic loss with histograms; rows and features are subsampled per tree."""
    rng = np.random.default_rng(seed)
    n = len(y)
    model = Boosted(edges, None, None, None, float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1))))
    score = np.full(n, model.bias)
    inner, bottom = 2**TREE_DEPTH - 1, 2**TREE_DEPTH
    trees = []
    for _ in range(N_TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        rows = np.flatnonzero(rng.random(n) < ROW_SHARE)
        use = np.flatnonzero(rng.random(len(edges)) < FEATURE_SHARE)
        b, gr, hr = binned[:, rows], g[rows], h[rows]
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 255, np.int64)
        node = np.zeros(len(rows), np.int64)
        for level in range(TREE_DEPTH):
            width = 2**level
            best = np.full(width, 1e-6)
            base = 2**level - 1
            for k in use:
                cell = node * (BINS + 1) + b[k]
                gs = np.bincount(cell, gr, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                hs = np.bincount(cell, hr, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                g_all, h_all = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (g_all - gs) ** 2 / (h_all - hs + 1) - g_all**2 / (h_all + 1)
                gain[(hs < 2) | (h_all - hs < 2)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                feature[base : base + width][better], cut[base : base + width][better] = k, at[better]
            node = 2 * node + (b[feature[base + node], np.arange(len(rows))] > cut[base + node])
        value = RATE * np.bincount(node, gr, bottom) / (np.bincount(node, hr, bottom) + 1)
        trees.append((feature, cut, value))
        at = np.zeros(n, np.int64)
        every = np.arange(n)
        for _ in range(TREE_DEPTH):
            at = 2 * at + 1 + (binned[feature[at], every] > cut[at])
        score += value[at - inner]
    model.features, model.cuts, model.values = (np.stack(t) for t in zip(*trees))
    return model


# ---- wording


def fit_wording(texts: list[str], main: np.ndarray) -> dict[str, float]:
    """Log-odds of words for main body, from the documents (distinct texts) that hold them."""
    counts = (Counter(), Counter())
    for text, y in {(t, bool(y)) for t, y in zip(texts, main)}:
        counts[y].update(set(_WORD.findall(text.lower())))
    totals = [sum(c.values()) + 1 for c in counts]
    common = [w for w, _ in (counts[0] + counts[1]).most_common(MAX_WORDS)]
    return {w: float(np.log((counts[1][w] + 1) / totals[1]) - np.log((counts[0][w] + 1) / totals[0])) for w in common}


def wording_of(texts: list[str], odds: dict[str, float]) -> np.ndarray:
    get, out = odds.get, np.zeros(len(texts), np.float32)
    for k, t in enumerate(texts):
        words = _WORD.findall(t.lower())
        if words:
            out[k] = sum([get(w, 0.0) for w in words]) / len(words)
    return out


def fit_naming(names: list[tuple[str, ...]], main: np.ndarray) -> dict[str, float]:
    """Log-odds of attribute tokens for main body, from the elements that carry them."""
    counts = (Counter(), Counter())
    for own, y in zip(names, main):
        counts[bool(y)].update(set(own))
    totals = [len(main) - int(main.sum()) + 1, int(main.sum()) + 1]
    common = [t for t, _ in (counts[0] + counts[1]).most_common(MAX_TOKENS)]
    return {t: float(np.log((counts[1][t] + 1) / totals[1]) - np.log((counts[0][t] + 1) / totals[0])) for t in common}


def names_of(names: list[tuple[str, ...]], odds: dict[str, float]) -> np.ndarray:
    """Per node the mean log-odds of its attribute tokens, 0 without any."""
    known: dict[tuple[str, ...], float] = {(): 0.0}
    out = np.zeros(len(names), np.float32)
    for k, own in enumerate(names):
        if own:
            if (value := known.get(own)) is None:
                value = known[own] = sum([odds.get(t, 0.0) for t in own]) / len(own)
            out[k] = value
    return out


# ---- labels, fit and decoding


def stray_lines(table: Table) -> np.ndarray:
    """Leaves with a common line beside other text. (A message that fills its page is the page's main body wherever
    else it occurs.)"""
    running = _running(table)
    page = table.page[table.leaf]
    text = np.bincount(page, table.chars * running * _inside(table)[table.leaf], len(table.root))
    return (table.common > 0) & running & (text[page] > 2 * table.chars + 40)


def in_its_place(table: Table, score: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Leaves that are given to pages that would keep headings alone: the likeliest other text of each, if it is likely at all."""
    text = _running(table) & (table.recurring == 0)
    page = table.page[table.leaf]
    bare = np.bincount(page, kept & ~_headings(table), len(table.root)) == 0
    rows = np.flatnonzero(text & bare[page] & (score[table.leaf] > LEAST_LOG_ODDS))
    best = rows[np.lexsort((score[table.leaf][rows], page[rows]))]
    last = np.r_[page[best][1:] != page[best][:-1], True] if len(best) else np.zeros(0, bool)
    return best[last]


def _headings(table: Table) -> np.ndarray:
    holder = table.tag[np.maximum(table.parent[table.leaf], 0)]
    return (holder >= _TAG["h1"]) & (holder <= _TAG["h6"])


def _running(table: Table) -> np.ndarray:
    """Leaves that are neither headings nor cells, items or code."""
    holder = table.tag[np.maximum(table.parent[table.leaf], 0)]
    return ~np.isin(holder, [_TAG[t] for t in ("h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "li", "pre", "title")])


def _inside(table: Table) -> np.ndarray:
    inside = table.trusted.copy()
    for level in table.levels[1:]:
        inside[level] |= inside[table.parent[level]]
    return inside


def weak_labels(table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Per leaf main or not, and per page whether its markup can be trusted to tell."""
    inside = _inside(table)
    barred = table.bad | np.isin(table.tag, [_TAG["aside"], _TAG["nav"], _TAG["footer"], _TAG["form"], _TAG["head"], _TAG["noscript"]])
    barred[table.trusted] = False
    for level in table.levels[1:]:
        p = table.parent[level]
        barred[level] |= barred[p] & ~table.trusted[level]
    holder = table.tag[np.maximum(table.parent[table.leaf], 0)]
    repeated = (table.recurring > 0) | stray_lines(table)
    main = inside[table.leaf] & ~barred[table.leaf] & ~(repeated & _running(table))
    main |= holder == _TAG["h1"]
    trusted_chars = np.bincount(table.page[table.leaf], table.chars * inside[table.leaf], len(table.root))
    return main, trusted_chars > 0


class Extractor:
    def __init__(self, wording: dict[str, float], naming: dict[str, float], trees: Boosted):
        self.wording, self.naming, self.trees = wording, naming, trees

    def keep(self, nodes: Nodes, recurring: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Which of the batch's leaves are main body."""
        if not nodes.leaf:
            return np.zeros(0, bool)
        table = Table(nodes, recurring, common, wording_of(nodes.text, self.wording), self.naming)
        return kept_leaves(table, self.trees.log_odds(table.features()))


def kept_leaves(table: Table, score: np.ndarray) -> np.ndarray:
    """The decoding with what is known beforehand."""
    holder = table.tag[np.maximum(table.parent[table.leaf], 0)]
    score = score.copy()
    score[table.leaf[holder == _TAG["h1"]]] = KNOWN
    kept = decode(table, score)
    given = in_its_place(table, score, kept)
    if len(given):
        score[table.leaf[given]] = KNOWN
        kept = decode(table, score)
    return kept


def decode(table: Table, score: np.ndarray, weight: float = NODE_WEIGHT) -> np.ndarray:
    """Best labelling of the tree. A subtree is kept whole, dropped whole, or its root stays open and its children are
    decided one by one; a labelling is worth the log-odds of the nodes it keeps less those of the nodes it drops."""
    is_leaf = np.zeros(len(score), bool)
    is_leaf[table.leaf] = True
    holds_text = table.up(np.ones(len(table.leaf))) > 0
    whole = np.where(is_leaf, score, weight * score * holds_text)
    split = np.zeros(len(score))
    for level in reversed(table.levels):
        best = np.maximum(np.abs(whole[level]), np.where(is_leaf[level], 0, split[level]))
        p = table.parent[level]
        some = p >= 0
        _add(whole, p[some], whole[level[some]])
        _add(split, p[some], best[some])
    state = np.zeros(len(score), np.int8)  # 1 keep, -1 drop, 0 open
    for level in table.levels:
        p = table.parent[level]
        above = np.where(p >= 0, state[np.maximum(p, 0)], 0)
        closed = is_leaf[level] | (np.abs(whole[level]) >= split[level])
        state[level] = np.where(above != 0, above, np.where(closed, np.where(whole[level] > 0, 1, -1), 0))
    return state[table.leaf] > 0


def fit(pages: list[tuple[str | None, str]], known: Keys) -> Extractor:
    """pages: (host, source). known: keys of recurring blocks and common lines. Trees and wording from the pages whose markup can be trusted."""
    pages = sorted((h or "", s) for h, s in pages)
    halves = [pages[0::2], pages[1::2]]
    parsed = []
    for half in halves:
        nodes, flags = Nodes(), [[], []]
        for host, source in half:
            n = len(nodes.text)
            nodes.page(source)
            for kind, new in zip(flags, flagged(host, nodes.text[n:], known)):
                kind += new
        parsed.append((nodes, [np.array(f, bool) for f in flags]))
    labels, odds, tokens = [], [], []
    for nodes, flags in parsed:
        if not nodes.leaf:
            labels.append((np.zeros(0, bool), np.zeros(0, bool)))
            odds.append({})
            tokens.append(([], np.zeros(0, bool)))
            continue
        table = Table(nodes, *flags, np.zeros(len(nodes.text)))
        main, trusted = weak_labels(table)
        labels.append((main, trusted))
        sure = trusted[table.page[table.leaf]]
        odds.append(fit_wording([t for t, s in zip(nodes.text, sure) if s], main[sure]))
        use = np.flatnonzero(trusted[table.page] & (table.up(np.ones(len(table.leaf))) > 0))
        tokens.append(([nodes.names[k] for k in use], (table.up(table.chars * main) / np.maximum(table.up(table.chars), 1))[use] > 0.5))
    naming = [fit_naming(*t) for t in tokens]
    xs, ys, ws, edges = [], [], [], None
    rng = np.random.default_rng(11)
    n_trusted = max(1, sum(int(t.sum()) for _, t in labels))
    for k, ((nodes, flags), (main, trusted)) in enumerate(zip(parsed, labels)):
        if not trusted.any():
            continue
        table = Table(nodes, *flags, wording_of(nodes.text, odds[1 - k]), naming[1 - k])  # wording and names learnt from the other half
        chars = np.maximum(table.up(table.chars), 1)
        share = table.up(table.chars * main) / chars
        use = trusted & (rng.random(len(trusted)) < TREE_PAGES / n_trusted)
        use = use[table.page] & (table.up(np.ones(len(table.leaf))) > 0)
        weight = np.where(np.isin(np.arange(len(share)), table.leaf), 1.0, 0.5)
        plain = np.where(np.isin(table.tag, _TELLING), _DIV, table.tag)
        zero = np.zeros(len(share), np.float32)
        shuffled = rng.permutation(len(share))
        flat = table.flattened()
        cells = np.where((rng.random(len(plain)) < 0.5) & (plain == _DIV), _TAG["td"], plain)
        views = [  # tree, tags and names, weight
            (table, (table.tag, table.names), 1.0),  # as it is
            (table, (plain, zero), 1.0),  # without telling tags and names
            (table, (plain, table.names[shuffled]), 0.5),  # with names from elsewhere
            (table, (plain, np.where(table.trusted, table.names.min(), table.names)), 1.0),  # with a misleading name on the article
            (table, (cells, zero), 0.5),  # as a layout table
            (flat, (cells, zero), 0.5),  # without an element around the article
            (flat, (plain, table.names[shuffled]), 0.5),
        ]
        for tree, (tag, names), worth in views:
            x = tree.features(tag, names)[use]
            if edges is None:
                edges = feature_edges(x)
            xs.append(bin_features(x, edges))
            ys.append((share[use] > 0.5).astype(float))
            ws.append(weight[use] * worth)
    if not xs:
        raise ValueError("no page of the sample says where its article is")
    trees = fit_boosted(edges, np.concatenate(xs, 1), np.concatenate(ys), np.concatenate(ws))
    both = [t for (nodes, _), (_, trusted) in zip(parsed, labels) for t in nodes.text]
    main = np.concatenate([m for m, _ in labels])
    sure = np.concatenate([np.repeat(trusted, np.bincount(_page_of_leaves(nodes), minlength=len(trusted))) if len(trusted) else np.zeros(0, bool) for (nodes, _), (_, trusted) in zip(parsed, labels)])
    every = fit_naming([n for names, _ in tokens for n in names], np.concatenate([y for _, y in tokens]))
    return Extractor(fit_wording([t for t, s in zip(both, sure) if s], main[sure]), every, trees)


def _page_of_leaves(nodes: Nodes) -> np.ndarray:
    return np.searchsorted(np.array(nodes.root), np.array(nodes.leaf), side="right") - 1


class Keys:
    """Known keys as a sorted array of eight bytes each."""

    def __init__(self, keys):
        self.sorted = np.unique(np.asarray(keys, np.int64))

    def hold(self, keys: list[int | None]) -> np.ndarray:
        if not len(self.sorted):
            return np.zeros(len(keys), bool)
        some = np.array([k is not None for k in keys], bool)
        wanted = np.array([k or 0 for k in keys], np.int64)
        at = np.searchsorted(self.sorted, wanted)
        at[at == len(self.sorted)] = 0
        return some & (self.sorted[at] == wanted)


def flagged(host: str | None, texts: list[str], known: Keys) -> tuple[list[bool], list[bool]]:
    """Per block of one page: does it recur on its site, is it a common line?"""
    site = site_hash(host)
    recurs = known.hold([recurrence_key(site, t) for t in texts]).tolist() if host else [False] * len(texts)
    return recurs, known.hold([common_key(host, t) for t in texts]).tolist()


# ---- Spark


def known_keys(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key: recurring blocks, on MIN_DOCS pages and MIN_SHARE of their site's pages at least, and common lines, on
    MIN_SITES sites at least; id, key of all blocks) of pages(id, host, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, sites, keys, kinds = [], [], [], []
            for i, host, source in zip(batch["id"], batch["host"], batch["html"]):
                site, texts = site_hash(host), block_texts(source)
                own = {recurrence_key(site, t) for t in texts} if host else set()
                lines = {common_key(host, t) for t in texts} - {None}
                n = len(own) + len(lines) + 1
                ids += [i] * n
                sites += [site] * n
                keys += [0, *own, *lines]
                kinds += [0] + [1] * len(own) + [2] * len(lines)
            yield pd.DataFrame({"id": pd.Series(ids, dtype=object), "site": sites, "key": keys, "kind": kinds})

    kind = pages.schema["id"].dataType.simpleString()
    rows = materialize(pages.mapInPandas(run, f"id {kind}, site long, key long, kind int"), "blocks")
    totals = rows.filter("kind = 0").select("id", "site").distinct().groupBy("site").agg(F.count("*").alias("n_pages"))
    blocks = rows.filter("kind = 1")
    # rows of repeated pages first count double; what passes is counted again by distinct ids
    often = hot_join(blocks.groupBy("key", "site").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_DOCS), totals, "site", "key").filter((F.col("n") >= MIN_DOCS) & (F.col("n") >= MIN_SHARE * F.col("n_pages")))
    exact = blocks.join(often.select("key", "n_pages"), "key").select("key", "n_pages", "id").distinct().groupBy("key", "n_pages").agg(F.count("*").alias("n"))
    recurring = exact.filter((F.col("n") >= MIN_DOCS) & (F.col("n") >= MIN_SHARE * F.col("n_pages"))).select("key")
    common = rows.filter((F.col("kind") == 2) & (F.col("site") != site_hash(None))).select("key", "site").distinct().groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_SITES).select("key")
    return recurring.unionByName(common), rows.filter("kind > 0").select("id", "key")


def sample_ids(pages: DataFrame, most: int = SAMPLE_PAGES) -> DataFrame:
    """id of the pages(id, host) to fit on: of every site its first page by hash, then of every site its second, and
    so on up to PAGES_PER_SITE. Only a site's few candidates meet in the second window."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(64))
    heads = pages.select("id", "host").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("host", bucket).orderBy(F.xxhash64("id", F.lit(1)))))
    few = heads.filter("rank = 1").withColumn("bucket", bucket).filter(F.col("bucket") < PAGES_PER_SITE)
    turns = few.withColumn("turn", F.row_number().over(Window.partitionBy("host").orderBy(F.xxhash64("id"))))
    return turns.orderBy("turn", F.xxhash64("host"), F.xxhash64("id")).limit(most).select("id")


def main_blocks(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, block_no (place among the page's blocks), block_key, block: the blocks of each page's main body."""
    spark = df.sparkSession
    pages = df.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).filter("html is not null")
    keys, of_pages = known_keys(pages)
    keys = materialize(keys, "known-keys")
    n_keys = keys.count()
    chosen = sample_ids(pages).collect()
    sample = pages.filter(F.col("id").isin([r["id"] for r in chosen]) & (F.length("html") <= SAMPLE_CHARS)).dropDuplicates(["id"]).orderBy("id").collect()
    own = [(r["host"], r["html"]) for r in sample]
    del sample
    if n_keys <= MAX_BROADCAST_KEYS:
        known = Keys(keys.toPandas()["key"].to_numpy())
        model = spark.sparkContext.broadcast((fit(own, known), known))
        located = pages.withColumn("keys", F.lit(None).cast("array<long>"))
    else:  # each page gets those of its own keys that are known; a page without a host has only common lines to look up, as any page
        wanted = spark.createDataFrame([(k,) for k in {k for host, source in own for k in _keys_of(host, source)}], "key long")
        model = spark.sparkContext.broadcast((fit(own, Keys(keys.join(F.broadcast(wanted), "key").toPandas()["key"].to_numpy())), None))
        located = _with_own_keys(pages, of_pages, keys)
    del own
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor, known = model.value
        for whole in batches:
            for start in range(0, len(whole), 500):
                batch = whole.iloc[start : start + 500]
                nodes, owner, place, recurring, common = Nodes(), [], [], [], []
                for i, host, source, own_keys in zip(batch["id"], batch["host"], batch["html"], batch["keys"]):
                    n = len(nodes.text)
                    nodes.page(source)
                    new = nodes.text[n:]
                    flags = flagged(host, new, known if known is not None else Keys(own_keys if own_keys is not None else ()))
                    recurring += flags[0]
                    common += flags[1]
                    owner += [i] * len(new)
                    place += range(len(new))
                kept = extractor.keep(nodes, np.array(recurring, bool), np.array(common, bool))
                rows = [(owner[k], place[k], block_key(nodes.text[k]), nodes.text[k]) for k in np.flatnonzero(kept)]
                yield pd.DataFrame(rows, columns=["id", "block_no", "block_key", "block"])

    return located.select("id", "host", "html", "keys").mapInPandas(run, f"id {kind}, block_no int, block_key string, block string")


def _keys_of(host: str | None, source: str) -> set[int]:
    texts, site = block_texts(source), site_hash(host)
    return ({recurrence_key(site, t) for t in texts} if host else set()) | ({common_key(host, t) for t in texts} - {None})


def _with_own_keys(pages: DataFrame, of_pages: DataFrame, keys: DataFrame) -> DataFrame:
    """pages with the known keys among those of their blocks, by a join of keys; no site is collected."""
    own = of_pages.join(keys.select("key").distinct(), "key", "left_semi").groupBy("id").agg(F.collect_set("key").alias("keys"))
    return pages.join(own, "id", "left")
