"""Operator 10: main text of web pages with wrappers induced from pages of the same host.

Induction: ``exemplars`` pages of each layout of a host, and as many of the host as a whole (chosen by a hash of the page id; pages
whose text is the same count once, so that copies of an article don't make it template), are parsed to trees and aligned with
the first of them by simple tree matching, whatever their size. A node that is matched often and has the same text nearly
always is template; nodes whose text varies are slots. The wrapper has the template nodes, as hashes of place and text, and
the region that holds the content: from the root down, the only container of its kind that has most of the text in slots (not in
links, not in what extraction loses below), as long as no varying heading is left outside; an article element ends the way. If none is
the only one of its kind, it is one of several alike, by its number among them where the pages agree on how many there are; this
only at the top of a page or of a table around it, so that no parts of an article are told apart.
A layout is the set of the tags and classes of a page's containers. Each layout whose exemplars are of ``least_matches`` hosts also has a
region of all hosts, for the pages of hosts that have too few; what is template on several hosts stays in these, as they may be copies of one article.

Extraction: a page's text is that of the nodes at the region of its layout's wrapper, else of its host's, else of its layout's on all hosts,
without template nodes. A page without wrapper, or without text there, gives that of its articles, else of the main element, else of the body without blocks of
links. Scripts, styles, forms, navigation, page headers and footers, sidebars, notices, adverts and comments (by element, role and
class or id) are lost everywhere. Within an article, or a region that a wrapper found, the slots decide, and a name only tells where all its
words say so (``cookie-banner``, not ``cookie-recipe`` or ``menu-items``); words that may name parts of an article too (``legal``) not even then for tables and
paragraphs. Blocks come in page order, white space squeezed.

Defined results: a null or empty html gives an empty text; a null or unreadable url is a host without wrapper; markup
that isn't closed ends with the page, a tag whose quote isn't closed at its first >; nesting may be of any depth; rows that repeat
are extracted alike. Extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from statistics import median
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import let, only_ids, stage_table, table


@dataclass(frozen=True)
class HtmlParams:
    """exemplars: pages that a wrapper is induced from, least_matches: the fewest that do. share: the part of the text in slots that a
    region must have of what is around it. link_density: the part of a block's text in links beyond which it isn't text, outside of
    article and main elements. Wrappers are broadcast up to broadcast_nodes template nodes in all (of 8 bytes)."""

    exemplars: int = 8
    least_matches: int = 4
    share: float = 0.75
    link_density: float = 0.6
    broadcast_nodes: int = 4_000_000


#: A quoted value ends where white space, / or > follows its quote.
_VALUES = r"(?:\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)|[^'\">])*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|object|canvas|audio|video)\b(?:{_VALUES}(?=>)|[^>]*)(?<!/)>"
    rf".*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{_VALUES}(?=>|\Z)|[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "ruby", "rb", "rt", "rp",
    "label", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "picture", "nobr",
}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "option", "fieldset", "input", "dialog", "menu", "head", "map", "datalist", "progress", "meter", "frameset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist"}
#: Words of class and id names that mark what isn't the article.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "banners", "menu", "menus", "nav", "navbar", "navigation",
    "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "widget", "widgets", "related", "recommended", "recommendations", "teaser", "teasers", "share", "sharing", "social", "cookie", "cookies", "consent",
    "gdpr", "notice", "notices", "notification", "notifications", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "signin", "search", "searchbox",
    "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "reviews", "footer", "masthead", "topbar", "pagination", "pager", "copyright", "legal", "disclaimer", "skip", "toolbar", "paywall", "form",
}
#: Those of them that may name a part of an article.
UNSURE = {"legal", "form", "notice", "notices", "search", "share", "sharing", "alert", "banner", "copyright", "disclaimer", "widget", "skip", "login", "footer", "related", "reply", "respond"}
TEXTUAL = {"table", "thead", "tbody", "tr", "td", "th", "p", "blockquote", "pre", "dl", "dt", "dd", "li", "figure", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6"}
ARTICLE = ("article", "main")
FRAMES = {"table", "tbody", "tr", "center"}
CONTAINERS = {"div", "section", "article", "main", "table", "tbody", "tr", "td", "center"}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "reviews"}
#: Words beside a mark in a name that leave it a mark.
PLAIN = {
    "box", "block", "container", "wrapper", "wrap", "holder", "area", "bar", "list", "links", "link", "buttons", "button", "icons", "section", "inner", "outer", "panel", "region", "unit", "slot", "top", "bottom", "left",
    "right", "header", "site", "page", "user", "reader", "customer", "visitor", "main", "sub", "global", "row", "col", "form", "thread", "count", "title",
}
#: Further words that leave the marks of comments and of what is related to an article.
OF_ARTICLE = {"article", "articles", "post", "posts", "story", "stories", "entry", "entries", "blog", "content", "news"}
HEADERS = {"header", "site", "page", "top", "masthead", "banner"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
_SCOPE = {"ul": {"li"}, "ol": {"li"}, "dl": {"dt", "dd"}, "table": {"tr", "td", "th", "thead", "tbody"}}


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str]
    children: list = field(default_factory=list)  # Node, or (text, in a link)

    def key(self) -> str:
        """What nodes must have in common to be matched; numbers in class and id don't count."""
        if self.tag == "html" or not self.attrs:
            return self.tag
        return re.sub(r"\d+", "0", f"{self.tag}.{self.attrs.get('class', '')}#{self.attrs.get('id', '')}")

    def own_text(self) -> str:
        return " ".join(html_lib.unescape("".join(c[0] for c in self.children if isinstance(c, tuple))).split())

    def nodes(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


def parse(html: str) -> Node:
    """The tree of block elements; inline elements are dissolved in the text of their block."""
    root = Node("html", {})
    stack = [root]
    opened: Counter = Counter()  # open elements by tag: no search for one that isn't there
    links = 0
    at = 0

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append((piece, links > 0))

    def end(k: int) -> None:
        for n in stack[k:]:
            opened[n.tag] -= 1
        del stack[k:]

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["cdata"]:
                text(m["cdata"].replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if m["close"] else 1
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                text("\n")
            continue
        links = 0
        if m["close"]:
            if opened[tag] > 0:
                end(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in ("html", "body"):
            root.attrs |= _attrs(m["attrs"])
            continue
        if tag in _CLOSES:
            if any(opened[t] > 0 for t in _CLOSES[tag]):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in _CLOSES[tag]:
                        end(k)
                        break
                    if stack[k].tag in _SCOPE:
                        break
        elif stack[-1].tag == "p":  # a block ends a paragraph
            end(len(stack) - 1)
        node = Node(tag, _attrs(m["attrs"]))
        stack[-1].children.append(node)
        if not m["attrs"].rstrip().endswith("/") or tag in ("p", "div", "section", "article"):
            stack.append(node)
            opened[tag] += 1
    if at < len(html):
        rest = html[at:]
        cut = re.search(r"<[a-zA-Z/!?]", rest)
        text(rest[: cut.start()] if cut else rest)
    return root


def _attrs(source: str) -> dict[str, str]:
    if not source or "=" not in source and " " not in source:
        return {}
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(source)}


def _words(attrs: dict[str, str]) -> set[str]:
    both = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if both == " ":
        return set()
    both = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", both).lower()
    both = re.sub(r"\b(?:no|has|with|without|is|hide)[-_]+[a-z0-9]+", " ", both)
    return set(re.findall(r"[a-z]+", both))


def _marked(attrs: dict[str, str], tag: str) -> bool:
    """Does a class or id of a node within an article say that it is no part of it? All words of the name must."""
    both = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower()
    for name in both.split():
        words = set(re.findall(r"[a-z]+", name)) if not re.match(r"(?:no|has|with|without|is|hide)[-_]", name) else set()
        marks = words & MARKS
        if not marks or not words - marks <= PLAIN | (OF_ARTICLE if marks & (COMMENTS | {"related", "recommended", "share", "sharing"}) else set()):
            continue
        if not marks <= UNSURE or tag not in TEXTUAL and (words == marks or not words & (OF_ARTICLE | {"section", "box"}) or marks & (COMMENTS | {"related"})):
            return True
    return False


def dropped(node: Node, inside: bool, region: bool = False) -> bool:
    """Isn't the node part of the article? inside: it is below an article or main element. region: below the node that a wrapper chose."""
    tag, attrs = node.tag, node.attrs
    if tag in DROPPED:
        return True
    if not attrs:
        return tag == "header" and not inside
    if attrs.get("role", "").lower() in ROLES:
        return True
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    words = _words(attrs)
    if tag in ARTICLE or attrs.get("role", "").lower() in ARTICLE or attrs.get("itemprop", "") == "articleBody":
        return bool(words & (COMMENTS | {"ad", "ads", "advert", "advertisement", "teaser", "related", "promo", "sponsored"}))
    if tag == "header" and not inside:
        return True
    if "header" in words and not inside and tag == "div":
        return True
    return _marked(attrs, tag) if inside or region else bool(words & MARKS)


def is_article(node: Node) -> bool:
    return node.tag in ARTICLE or node.attrs.get("role", "").lower() in ARTICLE or node.attrs.get("itemprop", "") == "articleBody"


def place(above: int, node: Node) -> int:
    """A hash of the keys from the root down to node."""
    return crc32(node.key().encode("utf-8", "surrogatepass"), above)


def hash_of(node: Node, at: int) -> int:
    text = node.own_text()
    return (at & 0x7FFFFFFF) << 32 | crc32(text.encode("utf-8", "surrogatepass")) if text else -1


def blocks(node: Node, constant: frozenset[int] | set[int], at: int = 0, region: bool = False) -> list[tuple[str, float, bool]]:
    """Texts of the blocks below node, with the share of each that is in links, and whether it is below an article or main element.
    constant: hashes of the template nodes; at: the node's place."""
    out: list[tuple[str, float, bool]] = []
    run: list[tuple[str, bool]] = []

    def end(within: bool) -> None:
        if run:
            whole = " ".join(html_lib.unescape("".join(t for t, _ in run)).split())
            if whole:
                linked = sum(len(t.strip()) for t, a in run if a)
                out.append((whole, linked / max(1, sum(len(t.strip()) for t, _ in run)), within))
            run.clear()

    stack = [(iter(node.children), bool(constant) and hash_of(node, at) in constant, is_article(node), at)]
    while stack:
        rest, template, within, own = stack[-1]
        for c in rest:
            if isinstance(c, tuple):
                if not template:
                    run.append(c)
            else:
                end(within)
                if not dropped(c, within, region):
                    here = place(own, c) if constant else 0
                    stack.append((iter(c.children), bool(constant) and hash_of(c, here) in constant, within or is_article(c), here))
                    break
        else:
            end(within)
            stack.pop()
    return out


class _Shapes:
    """Trees by their shape: one number for all nodes whose subtrees have equal keys throughout."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.keys: list[str] = []
        self.below: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.weights: dict[tuple[int, int], int] = {}

    def add(self, root: Node) -> dict[int, int]:
        """The shape of each node, by id()."""
        order = [root]
        for n in order:
            order += n.nodes()
        shape: dict[int, int] = {}
        for n in reversed(order):
            below = tuple(shape[id(c)] for c in n.nodes())
            own = (n.key(), below)
            if own not in self.number:
                self.number[own] = len(self.keys)
                self.keys.append(own[0])
                self.below.append(below)
                self.size.append(1 + sum(self.size[c] for c in below))
            shape[id(n)] = self.number[own]
        return shape

    def middle(self, x: int, y: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
        """How many children are of equal shape at the front, and the children between these and those of equal shape at the end. To match equal
        ones there costs nothing: no other match of them is larger."""
        p, q = self.below[x], self.below[y]
        n, front = min(len(p), len(q)), 0
        while front < n and p[front] == q[front]:
            front += 1
        back = 0
        while back < n - front and p[-1 - back] == q[-1 - back]:
            back += 1
        return front, p[front : len(p) - back], q[front : len(q) - back]

    def known(self, x: int, y: int) -> int | None:
        if self.keys[x] != self.keys[y]:
            return 0
        return self.size[x] if x == y else self.weights.get((x, y))

    def weight(self, x: int, y: int) -> int:
        """Size of the largest match of shapes x and y, those of their children first."""
        todo = [(x, y)]
        while todo:
            a, b = todo[-1]
            if self.known(a, b) is not None:
                todo.pop()
                continue
            front, p, q = self.middle(a, b)
            lacking = [(c, d) for c in set(p) for d in set(q) if self.known(c, d) is None]
            if lacking:
                todo += lacking
                continue
            todo.pop()
            back = len(self.below[a]) - front - len(p)
            ends = self.below[a]
            equal = sum(self.size[c] for c in (*ends[:front], *ends[len(ends) - back :]))
            self.weights[a, b] = 1 + equal + (int(_last_row(self.table(p, q))[-1]) if p and q else 0)
        return self.known(x, y)

    def table(self, p: tuple[int, ...], q: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of different shapes, and the numbers of those of p and q in them."""
        (u, i), (v, j) = np.unique(p, return_inverse=True), np.unique(q, return_inverse=True)
        return np.array([[self.weight(c, d) for d in v.tolist()] for c in u.tolist()], np.int64), i, j


def _last_row(t: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The weights of the best matches of all of p with the beginnings of q."""
    w, i, j = t
    row = np.zeros(len(j) + 1, np.int64)
    for k in i.tolist():
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w[k][j]))
    return row


def _aligned(t: tuple[np.ndarray, np.ndarray, np.ndarray], most: int = 1 << 22) -> list[tuple[int, int]]:
    """The pairs of a best match; a table of more than most cells is halved (Hirschberg), so memory is linear."""
    w, i, j = t
    if not len(i) or not len(j):
        return []
    if len(i) > 1 and len(i) * len(j) > most:
        half = len(i) // 2
        k = int((_last_row((w, i[:half], j)) + _last_row((w, i[half:][::-1], j[::-1]))[::-1]).argmax())
        return _aligned((w, i[:half], j[:k]), most) + [(half + a, k + b) for a, b in _aligned((w, i[half:], j[k:]), most)]
    best = np.zeros((len(i) + 1, len(j) + 1), np.int64)
    for r, k in enumerate(i.tolist(), 1):
        best[r, 1:] = np.maximum.accumulate(np.maximum(best[r - 1, 1:], best[r - 1, :-1] + w[k][j]))
    out = []
    a, b = len(i), len(j)
    while a and b:
        own = w[i[a - 1], j[b - 1]]
        if own and best[a, b] == best[a - 1, b - 1] + own:
            a, b = a - 1, b - 1
            out.append((a, b))
        elif best[a, b] == best[a - 1, b]:
            a -= 1
        else:
            b -= 1
    return out[::-1]


def simple_tree_matching(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Size and pairs of the largest order-preserving match of two trees; none if their roots have different keys."""
    shapes = _Shapes()
    of = shapes.add(a) | shapes.add(b)
    size = shapes.weight(of[id(a)], of[id(b)])
    out, todo = [], [(a, b)] if size else []
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        xs, ys = x.nodes(), y.nodes()
        front, p, q = shapes.middle(of[id(x)], of[id(y)])
        back = len(xs) - front - len(p)
        todo += zip(xs[:front], ys[:front], strict=True)
        if p and q:
            todo += [(xs[front + i], ys[front + j]) for i, j in _aligned(shapes.table(p, q))]
        todo += zip(xs[len(xs) - back :], ys[len(ys) - back :], strict=True)
    return size, out


@dataclass(frozen=True)
class Wrapper:
    """path: keys from below the root to the content, empty if no region was found (before the key of one of several alike, its
    number, how many there are, and a colon); template: hashes of constant nodes."""

    path: tuple[str, ...] = ()
    template: frozenset[int] = frozenset()


def _placed(root: Node) -> list[tuple[Node, int, int]]:
    """All nodes with their places and the numbers of their parents in the list (-1 for the root)."""
    out, k = [(root, 0, -1)], 0
    while k < len(out):
        n, at, _ = out[k]
        out += [(c, place(at, c), k) for c in n.nodes()]
        k += 1
    return out


@dataclass
class _Weight:
    text: int = 0  # letters in slots, not in links
    count: int = 0
    headings: int = 0
    node: Node | None = None
    above: int = 0
    each: list[tuple[int, int]] = field(default_factory=list)  # text and headings of each node, the last one first


def _weights(root: Node, template: frozenset[int], at: int = 0, inside: bool = False) -> dict[int, _Weight]:
    """What extraction leaves of a page (of what is below root, whose place is at), summed by place."""
    rows = [[root, at, -1, inside, 0, 0]]  # node, place, parent, inside, text, headings
    k = 0
    while k < len(rows):
        n, at, _, inside = rows[k][:4]
        within = inside or is_article(n)
        rows += [[c, place(at, c), k, within, 0, 0] for c in n.nodes() if not dropped(c, within)]
        if hash_of(n, at) not in template:
            rows[k][4] = sum(len(t.strip()) for t, link in (c for c in n.children if isinstance(c, tuple)) if not link)
            rows[k][5] = int(rows[k][4] > 0 and n.tag in ("h1", "h2"))
        k += 1
    out: dict[int, _Weight] = {}
    for n, at, parent, _, text, headings in reversed(rows):
        w = out.setdefault(at, _Weight(node=n, above=rows[parent][1] if parent >= 0 else -1))
        w.text, w.count, w.headings = w.text + text, w.count + 1, w.headings + headings
        w.each.append((text, headings))
        if parent >= 0:
            rows[parent][4] += text
            rows[parent][5] += headings
    return out


def _region(trees: list[tuple[Node, int, bool]], template: frozenset[int], p: HtmlParams, top: bool = True) -> tuple[str, ...]:
    """The keys on the way to the content. trees: nodes, their place, and whether they are below an article or main element. top: nothing but
    a table is around it."""
    pages = [_weights(n, template, at, inside) for n, at, inside in trees]
    known = {at: w for page in pages for at, w in page.items()}
    below: dict[int, list[int]] = {}
    for at, w in known.items():
        if w.node.tag in CONTAINERS:
            below.setdefault(w.above, []).append(at)
    here, path = trees[0][1], []
    nothing = _Weight()

    def share(of: list[tuple[int, int]], around: list[_Weight]) -> float:
        """What nodes of these texts and headings have of the text around them; 0 if they aren't the content."""
        part = median(text / max(1, w.text) for (text, _), w in zip(of, around, strict=True))
        outside = sum(w.headings > headings for (_, headings), w in zip(of, around, strict=True))
        return part if part >= p.share and 2 * outside < len(of) else 0

    while True:
        around = [page.get(here, nothing) for page in pages]
        best = 0.0, here
        for at in below.get(here, ()):
            own = [page.get(at, nothing) for page in pages]
            if sum(w.count == 1 for w in own) >= 0.8 * len(pages) and (part := share([(w.text, w.headings) for w in own], around)) > best[0]:
                best = part, at
        if not best[0]:
            break
        here = best[1]
        path.append(known[here].node.key())
        top &= known[here].node.tag in FRAMES
        if known[here].node.tag == "article":
            return tuple(path)
    best, key = 0.0, ""
    for at in below.get(here, ()) if top else ():
        own = [page.get(at, nothing) for page in pages]
        n, agree = Counter(w.count for w in own).most_common(1)[0]
        for k in range(n) if n > 1 and agree >= 0.8 * len(pages) else ():
            of = [w.each[-1 - k] if w.count == n else (0, 0) for w in own]
            if 2 * sum(headings > 0 for _, headings in of) > len(of) and (part := share(of, around)) > best:
                best, key = part, f"{k}/{n}:{known[at].node.key()}"
    if not best:
        return tuple(path)
    chosen = [x for n, at, inside in trees for x in _at(n, (*path, key), at, inside)[:1]]
    return (*path, key, *(_region(chosen, template, p, False) if chosen[0][0].tag != "article" else ()))


def induce(pages: list[str], p: HtmlParams = HtmlParams()) -> Wrapper | None:
    """The wrapper of pages of one layout; None if too few of them differ."""
    distinct: dict[tuple, list] = {}  # copies tell nothing about what is template
    for root in (parse(h) for h in pages):
        placed = _placed(root)
        distinct.setdefault(tuple((at, n.own_text()) for n, at, _ in placed), placed)
    exemplars = list(distinct.values())
    if len(exemplars) < p.least_matches:
        return None
    trees = [e[0][0] for e in exemplars]
    matched: Counter = Counter()
    equal: Counter = Counter()
    for other in trees[1:]:
        for a, b in simple_tree_matching(trees[0], other)[1]:
            matched[id(a)] += 1
            equal[id(a)] += a.own_text() == b.own_text()
    constant = lambda k: matched[k] >= p.least_matches - 1 and equal[k] >= matched[k] - 1 and equal[k] >= 0.85 * matched[k]
    template = frozenset(hash_of(n, at) for n, at, _ in exemplars[0] if constant(id(n))) - {-1}
    return Wrapper(_region([(t, 0, False) for t in trees], template, p), template)


def _look(root: Node, wanted) -> list[Node]:
    """The topmost nodes wanted, in page order, that aren't dropped."""
    found, todo = [], [(root, False)]
    while todo:
        n, inside = todo.pop()
        if n is not root:
            if dropped(n, inside):
                continue
            if wanted(n):
                found.append(n)
                continue
        todo += [(c, n.tag in ARTICLE) for c in reversed(n.nodes())]
    return found


def _at(root: Node, path: tuple[str, ...], at: int = 0, inside: bool = False) -> list[tuple[Node, int, bool]]:
    """The nodes at a path of keys below root, with their places, and whether they are below an article or main element."""
    out = [(root, at, inside)]
    for key in path:
        among, _, key = key.partition(":") if key[0].isdigit() else ("", "", key)
        found = []
        for n, above, within in out:
            within = within or is_article(n)
            same = [(c, place(above, c), within) for c in n.nodes() if c.key() == key and not dropped(c, within)]
            if among:
                number, n = map(int, among.split("/"))
                same = same[number : number + 1] if len(same) == n else []
            found += same
        out = found
    return out


def main_text(html: str, wrapper: Wrapper | None = None, p: HtmlParams = HtmlParams()) -> str:
    return extract(html, wrapper, p)[0]


def extract(html: str, wrapper: Wrapper | None = None, p: HtmlParams = HtmlParams()) -> tuple[str, bool]:
    """The main text, and whether the region of the wrapper gave it."""
    root = parse(html)
    template = wrapper.template if wrapper else frozenset()
    join = lambda out: " ".join(t for t, links, inside in out if inside or links <= p.link_density)
    if wrapper and wrapper.path:
        text = join(b for n, at, _ in _at(root, wrapper.path) for b in blocks(n, template, at, True))
        if text:
            return text, True
    role = lambda c: c.attrs.get("role", "").lower()
    found = _look(root, lambda c: c.tag == "article" or role(c) == "article" or c.attrs.get("itemprop") == "articleBody")
    found = found or _look(root, lambda c: c.tag == "main" or role(c) == "main")
    if found:
        at = {id(n): k for n, k, _ in _placed(root)} if template else {}
        return " ".join(t for n in found for t, _, _ in blocks(n, template, at.get(id(n), 0))), False
    return join(blocks(root, template)), False


def host(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def visible(html) -> F.Column:
    """A digest of the text between tags, white space squeezed; null if there is none."""
    raw = "(?i:script|style|noscript|template)"
    text = F.regexp_replace(html, rf"<(?:!--(?s:.*?)-->|{raw}\b(?s:.*?)</{raw}\s*>|[^>]*>)", " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return let(text, lambda t: F.when(t != "", F.sha2(t, 256)))


def layout(html) -> Column:
    """A number for the set of tags and classes of the containers of a page, without digits."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:div|section|main|article|aside|nav|header|footer|table|form)\b[^>]*>"), F.lit(0))
    part = lambda t, pattern: F.regexp_extract(t, pattern, 1)
    name = lambda t: F.lower(F.translate(F.concat(part(t, r"^<(\w+)"), F.lit("."), part(t, r"(?i)\sclass\s*=\s*[\"']?([\w -]*)")), "0123456789", ""))
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(F.array_distinct(tags), name))))


def wrappers(pages: DataFrame, p: HtmlParams = HtmlParams()) -> DataFrame:
    """host (empty for all hosts), layout (null for the host as a whole), path and template of the wrappers, where there are different pages enough."""
    slim = pages.select(host(F.col("url")).alias("host"), layout(F.col("html")).alias("layout"), "page_id", "url", visible(F.col("html")).alias("v")).where("host <> '' and page_id is not null and v is not null")
    one = F.min(F.struct(F.xxhash64("page_id").alias("h"), "page_id", "url")).alias("one")
    slim = slim.groupBy("host", "layout", "v").agg(one)
    group = lambda host, layout: F.struct(host.alias("host"), layout.alias("layout"))
    groups = F.array(group(F.col("host"), F.col("layout")), group(F.col("host"), F.lit(None).cast("long")), group(F.lit(""), F.col("layout")))
    every = slim.select(F.explode(groups).alias("g"), "v", "one", F.col("host").alias("of")).select("g.*", "v", "one", "of")
    least = lambda column: F.slice(F.array_sort(column), 1, p.exemplars)
    # in two steps, so that no task holds all pages of a layout
    part = every.groupBy("host", "layout", F.pmod(F.hash("v"), F.lit(1024)).alias("part")).agg(least(F.collect_list(F.struct("one", "v", "of"))).alias("s"))
    part = part.groupBy("host", "layout", F.floor(F.col("part") / 32).alias("part")).agg(least(F.flatten(F.collect_list("s"))).alias("s"))
    chosen = part.groupBy("host", "layout").agg(least(F.flatten(F.collect_list("s"))).alias("s")).where(F.size("s") >= p.least_matches)
    # what a layout has on one host or a few isn't what it has on others
    chosen = chosen.where((F.col("host") != "") | (F.size(F.array_distinct("s.of")) >= p.least_matches))
    chosen = chosen.select(F.col("host").alias("_h"), F.col("layout").alias("_l"), F.explode("s").alias("s")).select("_h", "_l", F.col("s.one.page_id").alias("_p"), F.col("s.one.url").alias("_u"), F.col("s.v").alias("_v"))
    chosen = stage_table(chosen, "html-exemplars")
    some = only_ids(pages.select("page_id", "url", "html"), chosen.select(F.col("_p").alias("page_id")).distinct(), "page_id")
    some = some.join(chosen, (F.col("page_id") == F.col("_p")) & (F.col("url") == F.col("_u"))).where(visible(F.col("html")) == F.col("_v"))
    some = some.groupBy(F.col("_h").alias("host"), F.col("_l").alias("layout"), "_v").agg(F.min(F.struct("page_id", "html")).alias("one")).select("host", "layout", "one.page_id", "one.html")  # repeated rows

    def of_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("page_id")
        w = induce([h or "" for h in rows["html"]], p)
        own = pd.DataFrame({"host": rows["host"].iloc[:1], "layout": rows["layout"].iloc[:1].astype("Int64"), "path": [list(w.path) if w else []], "template": [sorted(w.template) if w and rows["host"].iloc[0] else []]})
        return own if w else own.iloc[:0]

    return some.groupBy("host", "layout").applyInPandas(of_group, "host string, layout long, path array<string>, template array<long>")


def _extract(batches: Iterator[pa.RecordBatch], p: HtmlParams) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[tuple, Wrapper] = {}
        texts, by = [], []
        for h, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            own = None
            if w is not None:
                key = tuple(w["path"]), tuple(w["template"])
                own = known.get(key) or known.setdefault(key, Wrapper(key[0], frozenset(key[1])))
            text, found = extract(h or "", own, p)
            texts.append(text)
            by.append(found)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(by, pa.bool_())], ["page_id", "url", "text", "n_chars", "by_wrapper"])


def extract_main_text(pages: DataFrame, p: HtmlParams = HtmlParams()) -> DataFrame:
    """page_id, url, text, n_chars of each page, and by_wrapper: the text is that of the region of a wrapper."""
    # written, so that its size is known: small ones are broadcast by the planner, others joined by host
    found = stage_table(wrappers(pages, p), "html-wrappers")
    w = F.struct("path", "template").alias("w")
    own = found.where("host <> '' and layout is not null").select("host", "layout", w)
    whole = found.where("layout is null").select("host", w.alias("w0"))
    every = found.where("host = ''").select("layout", w.alias("w1"))
    # the pages' texts stay where they are as long as the wrappers are small: 8 bytes for each node of a template
    if (found.agg(F.sum(F.size("template") + F.size("path"))).first()[0] or 0) <= p.broadcast_nodes:
        own, whole, every = F.broadcast(own), F.broadcast(whole), F.broadcast(every)
    keyed = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"), layout(F.col("html")).alias("layout"))
    joined = keyed.join(own, ["host", "layout"], "left").join(whole, "host", "left").join(every, "layout", "left")
    joined = joined.select("page_id", "url", "html", F.coalesce("w", "w0", F.expr("if(host <> '', w1, null)")).alias("w"))
    return joined.mapInArrow(partial(_extract, p=p), "page_id long, url string, text string, n_chars long, by_wrapper boolean")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
