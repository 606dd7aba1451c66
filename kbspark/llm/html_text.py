"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of block elements, with each run of text directly in a block as a leaf. Nodes have features of their tag,
attribute tokens, those of their ancestors, depth, text density and links of the subtree, and siblings. The trees tell for each node
whether main text lies in it. Decoding takes the most likely labelling in which no node of a dropped ancestor is kept, by sums over
the tree. Kept leaves give the text.

The trees are trained on a bounded sample of the pages: as they are (what lies in <article> or <main> is main text), and with their
paragraphs set anew into varied layouts, so that names of classes, plain tags and shapes of text each carry some of the decision.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
SPECIAL = re.compile(r"""[>"']""")
RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in "script style noscript template svg iframe object canvas".split()}
ATTRIBUTE = re.compile(r"""(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# HTML elements by what they do, and tokens that attributes of page parts commonly hold.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
HOLDS = set("ul ol dl table tbody thead tfoot select article section div main aside nav header footer form body html blockquote figure td th".split())
TAGS = ["html", "body", "head", "title", "nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "ul", "ol", "li", "p", "h1", "h2", "h3", "blockquote", "pre", "table", "td", "tr", "figure", "figcaption", "button", "label", "select", "#text"]
NAMES = {
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc skip tabs dropdown sitemap",
    "header": "header masthead topbar top brand logo hero site",
    "footer": "footer foot bottom copyright colophon legal contentinfo imprint",
    "side": "sidebar side aside rail widget widgets related recommended recommendations trending popular complementary secondary more teaser archive tags tagcloud",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall disclaimer banner message warning dialog privacy",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted affiliate commercial dfp adsense",
    "form": "form search login signup register contact input feedback survey poll",
    "comment": "comment comments commentlist reply replies disqus discussion respond responses reviews review thread reader readers",
    "social": "share sharing social follow facebook twitter buttons toolbar",
    "content": "content contents article post story entry main body text prose page single maincontent",
}
GROUP_OF = {w: i for i, (_, words) in enumerate(NAMES.items()) for w in words.split()}
N_GROUPS, N_TAGS = len(NAMES), len(TAGS)
TAG_OF = {t: i for i, t in enumerate(TAGS)}


@dataclass
class Nodes:
    """Nodes of several pages, parents before children. Leaves have raw text."""

    tag: list[int]
    parent: list[int]
    depth: list[int]
    names: list[int]
    chars: list[int]
    links: list[int]
    stops: list[int]
    text: list[str | None]
    page: list[int]
    name: list[str]

    @classmethod
    def empty(cls) -> Nodes:
        return cls(*([] for _ in range(10)))

    def add(self, name: str, parent: int, names: int, page: int) -> int:
        self.tag.append(TAG_OF.get(name, N_TAGS))
        self.name.append(name)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.names.append(names)
        for x in (self.chars, self.links, self.stops):
            x.append(0)
        self.text.append(None)
        self.page.append(page)
        return len(self.tag) - 1


def names_in(attributes: str) -> int:
    """Bits of the groups whose tokens stand in class, id, role or label."""
    bits = 0
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            for w in WORD.findall(m[1] or m[2] or m[3] or ""):
                g = GROUP_OF.get(w.lower())
                if g is not None:
                    bits |= 1 << g
    return bits


def tags(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Markup of a page in order: start, end, name in lower case (None: a comment or what else has no name), whether it is an end tag, and the
    text of its attributes. What looks like a tag but isn't closed by > is text; quotes in a tag hide a >, unless one isn't closed.

    Each character is looked at a few times at most: a scan that fails over quotes marks them, so that no later one follows them again."""
    at, last = 0, page.rfind(">")
    dead: set[int] = set()  # quotes that open outside of others, and from which no > is reached
    while (lt := page.find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            yield lt, at, None, False, ""
            continue
        if lt > last:  # nothing but a comment can begin here
            if (lt := page.find("<!--", lt)) >= 0:
                yield lt, len(page), None, False, ""
            return
        if page[lt + 1] in "!?":
            at = page.index(">", lt) + 1
            yield lt, at, None, False, ""
            continue
        m = NAME.match(page, lt + 1)
        if not m:
            at = lt + 1
            continue
        name = m[2].lower()
        if not m[1] and name in RAW:
            close = RAW[name].search(page, page.index(">", lt))
            at = close.end() if close else len(page)
            yield lt, at, None, False, ""
            continue
        here, seen = m.end(), []
        while True:
            found = SPECIAL.search(page, here)
            if found is None or found[0] == ">":
                break
            seen.append(found.start())
            here = -1 if found.start() in dead else page.find(found[0], found.end()) + 1
            if here <= 0:
                break
        if here > 0 and found is not None:
            end = found.start()
        else:
            dead.update(seen)
            end = page.index(">", m.end())
        at = end + 1
        yield lt, at, name, bool(m[1]), page[m.end() : end]


class Open:
    """The open block elements, (name, node) each, with the places of each name and of elements that hold others."""

    def __init__(self, root: int) -> None:
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.push("html", root)

    def push(self, name: str, node: int) -> None:
        for key in (name, *(("holds", "cells")[name in ("td", "th")],) * (name in HOLDS)):
            self.places.setdefault(key, []).append(len(self.stack))
        self.stack.append((name, node))

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            name, _ = self.stack.pop()
            for key in (name, *(("holds", "cells")[name in ("td", "th")],) * (name in HOLDS)):
                self.places[key].pop()

    def last(self, *names: str) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def close(self, names: set[str], to_rows: bool) -> bool:
        """Close the last element of these names, if it isn't around one that holds others (a row also ends the cells that it is in)."""
        at = self.last(*names)
        if at > 0 and at >= self.last("holds", *(() if to_rows else ("cells",))):
            self.cut(at)
            return True
        return False


def parse(page_html: str, page: int, out: Nodes) -> None:
    """Add the page's nodes. Elements that HTML closes by itself are closed (p, li, cells); stray end tags are passed over."""
    root = out.add("html", -1, 0, page)
    elements = Open(root)
    run: list[str] = []
    link = linked = 0

    def flush() -> None:
        nonlocal linked
        raw = "".join(run)
        if raw.strip():
            n = out.add("#text", elements.stack[-1][1], 0, page)
            out.text[n], out.chars[n], out.links[n] = raw, len(raw.strip()), linked
            out.stops[n] = sum(map(raw.count, ".,;!?"))
        run.clear()
        linked = 0

    at = 0
    for start, end, name, is_end, attributes in tags(page_html):
        if start > at:
            run.append(page_html[at:start])
            if link:
                linked += start - at
        at = end
        if name is None:
            continue
        if name == "a":
            link = 0 if is_end else 1
        if name in INLINE:
            if name == "br":
                run.append(" ")
            continue
        flush()
        if is_end:
            if name in ("p", "li", "td", "th", "tr", "dt", "dd"):
                elements.close({name}, name == "tr")
            elif elements.last(name) > 0:
                elements.cut(elements.last(name))
            link = 0
            continue
        if name == "html" or (name == "body" and elements.last("body") > 0):
            continue
        if name == "body":
            elements.cut(1)
        elements.close(CLOSES.get(name, set()) | {"p"}, name == "tr")
        if name not in VOID:
            elements.push(name, out.add(name, elements.stack[-1][1], names_in(attributes), page))
    if at < len(page_html):
        run.append(page_html[at:])
    flush()


def levels_of(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth, from the roots down."""
    return np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


def features(x: Nodes) -> np.ndarray:
    """Nodes x features. Sums over subtrees go up level by level, ancestors' names go down."""
    parent, depth, tag, names = (np.array(v, np.int64) for v in (x.parent, x.depth, x.tag, x.names))
    n, page = len(parent), np.array(x.page, np.int64)
    if not n:
        return np.zeros((0, 0))
    leaf = tag == TAG_OF["#text"]
    inside = np.stack([np.array(x.chars, float), np.array(x.links, float), np.array(x.stops, float), np.ones(n), leaf, tag == TAG_OF["p"], tag == TAG_OF["li"], np.isin(tag, [TAG_OF["h1"], TAG_OF["h2"], TAG_OF["h3"]])], axis=1).astype(float)
    above, tag_above = np.zeros(n, np.int64), np.zeros(n, np.int64)
    special = np.array([1 << i if t in ("nav", "header", "footer", "aside", "form", "article", "main", "head", "button", "label", "select", "figure") else 0 for i, t in enumerate(TAGS)] + [0], np.int64)
    levels = levels_of(depth)
    for rows in reversed(levels[1:]):
        np.add.at(inside, parent[rows], inside[rows])
    for rows in levels[1:]:
        up = parent[rows]
        above[rows], tag_above[rows] = above[up] | names[up], tag_above[up] | special[tag[up]]
    chars, links, stops, nodes, leaves, ps, lis, heads = inside.T
    has = parent >= 0
    up = np.where(has, parent, 0)
    kids = np.bincount(parent[has], minlength=n)
    order = np.lexsort((np.arange(n), up))
    first = np.r_[True, up[order][1:] != up[order][:-1]]
    place = np.empty(n)
    place[order] = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    before, after = np.zeros(n), np.zeros(n)
    same = ~first[1:]
    before[order[1:][same]] = chars[order[:-1][same]]
    after[order[:-1][same]] = chars[order[1:][same]]
    pair = up * (N_TAGS + 1) + tag
    alike = np.unique(pair, return_inverse=True, return_counts=True)
    whole = np.zeros(page.max() + 1)
    np.maximum.at(whole, page, chars)
    dense = [depth, np.log1p(chars), links / np.maximum(chars, 1), stops / np.maximum(chars, 1), chars / nodes, np.log1p(nodes), leaves, ps, lis, heads, kids, chars / np.maximum(whole[page], 1), place, kids[up], alike[2][alike[1]] / np.maximum(kids[up], 1), np.log1p(before), np.log1p(after), tag[up], chars / np.maximum(chars[up], 1)]
    bits = [tag == i for i in range(N_TAGS + 1)] + [(v >> i) & 1 for v in (names, above) for i in range(N_GROUPS)] + [(tag_above >> i) & 1 for i in range(N_TAGS) if special[i]]
    return np.stack([np.asarray(c, float) for c in dense + bits], axis=1)


class Boosted:
    """Gradient-boosted trees for a yes or no, on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.25, bins: int = 24, share: float = 0.4) -> None:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)))[:-1] for c in x.T] if len(x) else []
        whole = self.binned(x) if len(x) else x
        n, width, self.trees = len(y), bins + 1, []
        f, rng = max(1, int(share * x.shape[1])), np.random.default_rng(1)
        base = np.clip(y.mean() if n else 0.5, 0.01, 0.99)
        self.base = np.log(base / (1 - base))
        score, offset = np.full(n, self.base), np.arange(f) * width
        for _ in range(trees if n else 0):
            own = np.sort(rng.choice(x.shape[1], f, replace=False))  # each tree sees a share of the features
            b = whole[:, own]
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node, splits = np.zeros(n, np.int64), []
            for level in range(depth):
                cells = 1 << level
                flat = (node[:, None] * f * width + offset + b).ravel()
                total = [np.bincount(flat, np.repeat(v, f), cells * f * width).reshape(cells, f, width) for v in (g, h)]
                gl, hl = (np.cumsum(v, axis=2) for v in total)
                gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
                best = gain.reshape(cells, -1).argmax(axis=1)
                feature, cut = best // width, best % width
                cut = np.where(gain.reshape(cells, -1).max(axis=1) > 1e-6, cut, width)
                splits.append((own[feature], cut))
                node = 2 * node + (b[np.arange(n), feature[node]] > cut[node])
            value = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + 1)
            self.trees.append((splits, value))
            score += value[node]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1).astype(np.uint8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        if not len(x):
            return score
        b = self.binned(x)
        for splits, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = 2 * node + (b[np.arange(len(x)), feature[node]] > cut[node])
            score += value[node]
        return 1 / (1 + np.exp(-score))


def decode(x: Nodes, p: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the most likely labelling in which children of a dropped node are dropped."""
    parent, depth = np.array(x.parent, np.int64), np.array(x.depth, np.int64)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    keep, drop = np.log(p), np.log(1 - p)
    levels = levels_of(depth)
    for rows in reversed(levels[1:]):
        np.add.at(keep, parent[rows], np.maximum(keep[rows], drop[rows]))
        np.add.at(drop, parent[rows], drop[rows])
    kept = np.zeros(len(p), bool)
    for d, rows in enumerate(levels):
        kept[rows] = (keep[rows] > drop[rows]) & (kept[parent[rows]] if d else True)
    return kept


def clean(raw: str) -> str:
    return " ".join(html.unescape(raw).split())


#: Stands behind the main texts of layouts.
MARK = "\ue000"


def layout(rng: random.Random, main: list[str], other: list[str]) -> str:
    """A page with `main` as its text among parts made of `other`; main texts end with MARK."""
    pick = lambda g: rng.choice(NAMES[g].split())
    some = lambda: rng.choice(other)

    def attribute(group: str | None) -> str:
        if group is None or rng.random() < 0.15:
            return rng.choice(["", "", f' class="c{rng.randrange(9999)}"', f' id="x{rng.randrange(99)}"'])
        name = pick(group)
        name = rng.choice([name, f"{name}-{rng.choice(['box', 'wrap', 'area', 'block', 'inner', 'list'])}", f"site-{name}", f"{name}_{rng.randrange(9)}", f"c{rng.randrange(99)} {name}"])
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def named(group: str, tags: list[str], body: str) -> str:
        tag = rng.choice(tags)
        a = attribute(group)
        if tag in ("div", "section", "ul", "ol", "p") and not any(w.lower() in GROUP_OF for w in WORD.findall(a.partition("=")[2])):
            a = f' class="{pick(group)}"'  # a plain tag tells nothing by itself
        return f"<{tag}{a}>{body}</{tag}>"

    words = lambda: " ".join(some().split()[: rng.randint(1, 4)]) or "x"
    menu = lambda: "<ul>" + "".join(f'<li><a href="/{i}">{words()}</a></li>' for i in range(rng.randint(2, 9))) + "</ul>"
    para = lambda: rng.choice(["<p>%s</p>", "%s", "<p>%s</p><p>%s</p>", "<div>%s</div>", "<h3>%s</h3><p>%s</p>"]).replace("%s", some())
    parts = {
        "nav": lambda: named("nav", ["nav", "div", "ul"], menu() if rng.random() < 0.8 else "".join(f'<a href="#">{words()}</a> ' for _ in range(5))),
        "header": lambda: named("header", ["header", "div"], f"<h1>{words()}</h1>" + rng.choice(["", menu(), f"<p>{some()}</p>"])),
        "ad": lambda: named("ad", ["div", "aside", "section"], rng.choice([some(), para(), f'<a href="/buy">{some()}</a>'])),
        "notice": lambda: named("notice", ["div", "section", "aside"], para() + rng.choice(["", f"<button>{words()}</button>"])),
        "side": lambda: named("side", ["aside", "div", "section"], f"<h3>{words()}</h3>" + rng.choice([menu(), para()])),
        "form": lambda: f"<form{attribute('form')}><label>{words()}</label><input name=q><button>{words()}</button>" + rng.choice(["", f"<p>{some()}</p>"]) + "</form>",
        "social": lambda: named("social", ["div", "ul"], "".join(f'<a href="#">{words()}</a>' for _ in range(4))),
        "comment": lambda: named("comment", ["section", "div", "ol"], f"<h2>{words()}</h2>" + "".join(rng.choice([f"<div class='{pick('comment')}'><p>{some()}</p></div>", f"<li><p>{some()}</p></li>", f"<article class='{pick('comment')}'><p>{some()}</p></article>", f"<p>{some()}</p>"]) for _ in range(rng.randint(1, 5)))),
        "footer": lambda: named("footer", ["footer", "div"], f"&copy; {words()} &middot; {some()}" if rng.random() < 0.6 else menu() + para()),
    }
    body = []
    for i, t in enumerate(main):
        t = html.escape(" ".join(t.split()[: rng.randint(1, 4)]) if i and rng.random() < 0.2 else t, quote=False) + MARK
        kind = rng.random()
        body.append(f"<h1>{t}</h1>" if i == 0 and kind < 0.8 else f"<h2>{t}</h2>" if len(t) < 60 and kind < 0.5 else f"<blockquote><p>{t}</p></blockquote>" if kind < 0.06 else f"<ul><li>{t}</li></ul>" if kind < 0.12 else f"<pre>{t}</pre>" if kind < 0.14 else f"<p><b>{t}<br>" if kind < 0.2 else f"<div>{t}</div>" if kind < 0.25 else f"<table><tr><td>{t}</td></tr></table>" if kind < 0.27 else f"<p>{t}</p>")
        if i and rng.random() < 0.06:
            body.append(parts[rng.choice(["ad", "side", "social", "form", "notice"])]())
    text = "".join(body)
    wrap = rng.choice(["<article>%</article>", "<main>%</main>", "<main><article>%</article></main>", "<div class='%s'>%%</div>" % pick("content"), "<div id='%s'>%%</div>" % pick("content"), "<div>%</div>", "<section>%</section>", "<div class='c7'><div>%</div></div>", "<article class='%s'>%%</article>" % pick("content")])
    front = [parts[k]() for k in ("notice", "header", "nav", "ad", "form", "side") if rng.random() < 0.55]
    back = [parts[k]() for k in ("social", "side", "comment", "form", "ad", "nav", "notice", "footer") if rng.random() < 0.45]
    rng.shuffle(front)
    rng.shuffle(back)
    page = "".join(front) + wrap.replace("%", text) + "".join(back)
    if rng.random() < 0.06:  # nothing but text, as little as one paragraph
        page = rng.choice(["%", "<div>%</div>"]).replace("%", "".join(body[: rng.randint(1, 4)]) if rng.random() < 0.7 else f"<p>{html.escape(main[-1], quote=False)}{MARK}</p>")
    if rng.random() < 0.4:
        page = f"<div{rng.choice(['', ' id=page', ' class=wrapper', ' class=container'])}>{page}</div>"
    return f"<!DOCTYPE html><html><head><title>{words()}</title><style>p{{}}</style></head><body>{page}</body></html>"


def labelled(pages: list[str], layouts: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of the pages and of `layouts` layouts of each."""
    x, y, rng = Nodes.empty(), [], random.Random(seed)
    parts: list[list[str]] = []
    for i, page in enumerate(pages):
        start = len(x.tag)
        parse(page, i, x)
        inside = [False] * (len(x.tag) - start)
        for j in range(start, len(x.tag)):
            up = x.parent[j]
            inside[j - start] = x.name[j] in ("article", "main") or (up >= start and inside[up - start])
        if any(inside):
            y += [bool(v and x.text[start + k]) for k, v in enumerate(inside)]
        else:  # no element says where the text is: no label
            for v in (x.tag, x.parent, x.depth, x.names, x.chars, x.links, x.stops, x.text, x.page, x.name):
                del v[start:]
        parts.append([t for t in map(clean, x.text[start:]) if t] if not any(inside) else [clean(t) for t, v in zip(x.text[start:], y[start:], strict=True) if v])
    texts = parts
    pool = [t for ts in texts for t in ts if len(t) < 400] or ["Home"]
    page_no = len(pages)
    for ts in texts:
        for _ in range(layouts if len(ts) > 1 else 0):
            k = rng.randint(1, len(ts)) if rng.random() < 0.3 else len(ts)
            page = layout(rng, ts[:k], rng.sample(pool, min(len(pool), 30)))
            start = len(x.tag)
            parse(page, page_no, x)
            page_no += 1
            y += [bool(t and MARK in t) for t in x.text[start:]]
    label = np.array(y, bool)
    parent, depth = np.array(x.parent, np.int64), np.array(x.depth, np.int64)
    for rows in reversed(levels_of(depth)[1:]):  # a node holds main text if a child does
        label[parent[rows[label[rows]]]] = True
    return features(x), label.astype(float)


def train(pages: DataFrame, max_pages: int = 150, layouts: int = 6, seed: int = 7) -> Boosted:
    """Fits the trees on max_pages pages (those with the least hash of their columns; equal pages count once) and `layouts` layouts of each."""
    known = pages.filter("html is not null").select(F.xxhash64(*pages.columns).alias("at"), "html")
    least = [r["at"] for r in known.select("at").distinct().orderBy("at").limit(max_pages).collect()]
    rows = known.filter(F.col("at").isin(least)).groupBy("at").agg(F.min("html").alias("html")).orderBy("at").collect()
    sample = list(dict.fromkeys(r["html"] for r in rows))
    x, y = labelled(sample, layouts, seed)
    return Boosted(x, y)


def extract(pages: DataFrame, model: Boosted) -> DataFrame:
    """pages, any columns with html -> the same rows with text: kept blocks in page order, one to a line. Null and empty pages have an empty
    text; markup that isn't closed or is cut off is read as far as it goes; repeated rows are kept; a column text is replaced; an empty
    table gives no rows. A very long page is read whole, in time and memory in proportion to its length (256 pages go at a time)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for a in range(0, len(batch), 256):
                part, x = batch.iloc[a : a + 256], Nodes.empty()
                for i, page in enumerate(part):
                    parse(page or "", i, x)
                kept = decode(x, shared.value.predict(features(x))) if shared.value.trees else np.zeros(len(x.tag), bool)
                texts: list[list[str]] = [[] for _ in part]
                for k in np.flatnonzero(kept):
                    if x.text[k] and (t := clean(x.text[k])):
                        texts[x.page[k]].append(t)
                out += ["\n".join(t) for t in texts]
            yield pd.Series(out, index=batch.index, dtype=object)

    d = pages.drop("text")
    return d.select(*d.columns, main_text("html").alias("text"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
