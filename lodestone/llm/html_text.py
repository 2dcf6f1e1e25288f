"""Main text of a web page by minimum-cut labelling.

A page is parsed into text blocks. Every block is a node. Its terminal capacities are the
costs that a classifier assigns to calling it content or boilerplate: the log odds of a
logistic regression over its length, sentences, link density, element, the elements and
names around it, and its neighbours, bounded by ``MOST``. Neighbours in page order and
blocks under the same DOM parent are joined by smoothness edges, the stronger the closer
they stand in the tree; a few of them outweigh a doubtful block's own costs, so a short
paragraph inside an article stays and a lone sentence inside a menu goes. The minimum cut,
found by max-flow, is the labelling of least total cost.

The regression is fitted on ``html_training``'s labelled pages (``TRAINING_PAGES`` of them,
a documented bound) once a process, the same way on any machine; no table is read for it.

Scripts, styles, templates and hidden elements are no text at all; hidden or advert
elements inside a line are left out of it. All other mark-up is evidence only. A class, id,
form or menu says nothing about an element that holds the page's article or headline and
at least half of its text, nor does a class on article or main, unless it names comments.

Parsing takes time linear in the page: elements nest to a depth of 512 (as in browsers;
deeper ones are no nodes, their text stays), and an attribute whose quote is never closed
ends at the tag's first ``>``.

Defined results: null or empty html gives the empty text, as does a page of boilerplate
only; rows that repeat are extracted each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_training import LABEL, labelled_pages

#: Element names by what HTML says they are.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "object", "svg", "math", "canvas", "title", "xmp", "noembed", "noframes"}
HIDDEN = {"head", "select", "button", "option", "datalist", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
#: Elements that end an open paragraph.
ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "ul",
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
FENCES = {"ul", "ol", "dl", "table", "td", "th"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.DOTALL,
)
#: A start tag with a quote that is never closed, up to the first ``>``.
TORN = re.compile(r"<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)(?:>|\Z)")
ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Words in class and id names. A trailing * stands for any ending.
BAD_NAMES = """
ad ads advert* adsense banner sponsor* promo* sidebar widget widgets nav* menu* breadcrumb breadcrumbs footer header masthead topbar toolbar
cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscri* signup login share sharing social related
recommend* trending popular outbrain taboola copyright legal disclaimer pagination pager tags skip search* rating
""".split()
COMMENT_NAMES = "comment comments respond disqus reply replies discussion".split()
GOOD_NAMES = "article* content entry post story main body text hentry blog".split()
AD_NAMES = "ad ads advert* adsense sponsor* promo*".split()
#: Say what stands beside or on an element, not what it is.
STATES = set("with has no without open closed enabled active fixed".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "alertdialog"}


def _names(words: list[str]) -> re.Pattern[str]:
    return re.compile("|".join(w[:-1] + r"\w*" if w.endswith("*") else w for w in words))


BAD, COMMENT, GOOD, AD = map(_names, (BAD_NAMES, COMMENT_NAMES, GOOD_NAMES, AD_NAMES))
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
SENTENCE = re.compile(r"[.!?…:;][\"'”’)]?(?:\s|$)")
SPACE = re.compile(r"\s+")
RIGHTS = ("copyright ", "all rights reserved")

#: Bound of the terminal costs, and weights of the smoothness edges.
MOST, SMOOTH_NEXT, SMOOTH_ALIKE, SMOOTH_SIBLING = 6.0, 1.0, 2.0, 0.5
DEEPEST, FURTHEST = 512, 16
TRAINING_PAGES = 600


class Node:
    """An element, with what its own mark-up says; ``inherit`` adds what holds for it
    as a part of others."""

    __slots__ = ("name", "parent", "depth", "hidden", "bad", "good", "comment", "article", "tag", "aside", "form", "marks", "size", "inline", "y", "kind")

    def __init__(self, name: str, parent: "Node | None", attrs: str, inline: int = 0):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        self.hidden = bool(parent and parent.hidden) or name in HIDDEN
        self.bad = self.good = self.comment = False
        self.article = name in ("article", "main")
        self.tag = name in ("nav", "footer", "menu", "header")
        self.aside, self.form = name == "aside", name == "form"
        self.marks = False  # holds the headline or the article
        self.size, self.inline, self.kind = 0, inline, name
        self.y = parent.y if parent else None
        if attrs and name not in ("html", "body"):
            for key, value in attributes(attrs):
                if key in ("class", "id"):
                    self._named(value)
                    self.kind += " " + value
                elif key == "role":
                    role = value.strip().lower()
                    self.tag |= role in ROLES
                    self.article |= role in ("main", "article")
                elif hides(key, value):
                    self.hidden = True
                elif key == LABEL and value in ("0", "1"):
                    self.y = int(value)

    def _named(self, value: str) -> None:
        for name in value.lower().split():
            parts = re.split(r"[-_]+", name)
            if STATES.isdisjoint(parts):
                self.bad |= any(map(BAD.fullmatch, parts))
            self.comment |= any(map(COMMENT.fullmatch, parts))
            self.good |= any(map(GOOD.fullmatch, parts))

    def inherit(self, total: int) -> None:
        up = self.parent
        if self.name in ("article", "main"):
            self.bad = False
        if self.marks and 2 * self.size >= total:
            self.bad = self.form = False
        if up is None:
            return
        # an article's own header holds its headline; its fate is left to the costs
        self.tag = self.tag and not (self.name == "header" and up.article) or up.tag
        self.bad, self.good, self.comment = self.bad or up.bad, self.good or up.good, self.comment or up.comment
        self.aside, self.form, self.article = self.aside or up.aside, self.form or up.form, self.article or up.article


def attributes(text: str) -> Iterator[tuple[str, str]]:
    for m in ATTR.finditer(text):
        yield m[1].lower(), m[2] or m[3] or m[4] or ""


def hides(key: str, value: str) -> bool:
    return key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and bool(HIDDEN_STYLE.search(value))


def left_out(attrs: str) -> bool:
    """Whether an element inside a line is hidden or an advert."""
    for key, value in attributes(attrs):
        if hides(key, value) or key in ("class", "id") and any(AD.fullmatch(p) for name in value.lower().split() for p in re.split(r"[-_]+", name)):
            return True
    return False


class Block:
    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node, linked: int):
        self.text, self.node, self.linked = text, node, linked


_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order. Inline elements don't break a block."""
    out: list[Block] = []
    root = Node("", None, "")
    nodes, opened = [root], {"": 1}
    top = root
    inline: list[tuple[str, bool]] = []  # open inline elements, and whether they are left out
    links = skipped = 0
    parts: list[str] = []
    linked = too_deep = 0
    article = False  # one was met

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", unescape("".join(parts))).strip()
            if text and not top.hidden:
                out.append(Block(text, top, linked))
                top.size += len(text)
            parts.clear()
        linked = 0

    def leave_inline(least: int) -> None:
        nonlocal links, skipped
        while len(inline) > least:
            name, gone = inline.pop()
            links -= name == "a"
            skipped -= gone

    def close(names: set[str], fences: set[str]) -> None:
        """Close the innermost open element of ``names`` unless a fence stands before."""
        nonlocal top
        if not any(opened.get(n) for n in names):
            return
        at = top
        while at.parent is not None and at.name not in names:
            if at.name in fences:
                return
            at = at.parent
        if at.parent is not None:
            flush()
            leave_inline(at.inline)
            while top is not at.parent:
                opened[top.name] -= 1
                top = top.parent

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            if not skipped:
                parts.append(html[at:lt])
                linked += (lt - at) * (links > 0)
            at = lt
            continue
        m = TOKEN.match(html, at) or TORN.match(html, at)
        if m is None:
            parts.append("<")
            at += 1
            continue
        at = m.end()
        groups = m.groupdict()
        if groups["start"]:
            name, attrs = groups["start"].lower(), groups["attrs"]
            if name in RAW:
                if not attrs.rstrip().endswith("/"):
                    end = _RAW_END[name].search(html, at)
                    at = end.end() if end else n
            elif name == "br":
                parts.append("\n")
            elif name in INLINE:
                if len(inline) < DEEPEST:
                    gone = bool(attrs) and left_out(attrs)
                    inline.append((name, gone))
                    links += name == "a"
                    skipped += gone
            elif name in VOID:
                if name == "hr":
                    flush()
                else:
                    parts.append(" ")
            else:
                if name in ENDS_P:
                    close({"p"}, FENCES)
                if name in CLOSES:
                    close(CLOSES[name], {"ul", "ol", "dl", "table"})
                flush()
                if name in HEADINGS and top.name in HEADINGS:
                    close({top.name}, set())
                if top.depth >= DEEPEST:
                    too_deep += 1
                    continue
                top = Node(name, top, attrs, len(inline))
                nodes.append(top)
                opened[name] = opened.get(name, 0) + 1
                if name in ("h1", "main") or name == "article" and not article and not top.comment:
                    article |= name == "article"
                    up: Node | None = top
                    while up is not None and not up.marks:
                        up.marks = True
                        up = up.parent
        elif groups.get("end"):
            name = groups["end"].lower()
            if name in INLINE:
                known = next((k for k in range(len(inline) - 1, top.inline - 1, -1) if inline[k][0] == name), None)
                if known is not None:
                    _, gone = inline.pop(known)
                    links -= name == "a"
                    skipped -= gone
            elif name not in VOID and name not in RAW:
                if too_deep:
                    too_deep -= 1
                    flush()
                else:
                    close({name}, {"td", "th", "table"} - {name} if name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "article", "main", "div") else set())
        elif groups.get("cdata"):
            parts.append(groups["cdata"])
    flush()
    for x in reversed(nodes[1:]):
        x.parent.size += x.size
    for x in nodes:
        x.inherit(root.size)
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """What the classifier knows of each block."""
    own = np.zeros((len(blocks), 18))
    for i, b in enumerate(blocks):
        node, text, n = b.node, b.text, len(b.text)
        own[i] = (
            1,
            min(1, n / 200),
            np.log1p(n) / 6,
            min(1.0, b.linked / max(1, n)),
            bool(SENTENCE.search(text)),
            node.name == "p",
            node.name in HEADINGS,
            node.name == "li",
            node.article,
            node.tag,
            node.aside,
            node.form,
            node.bad,
            node.good,
            node.comment,
            text[0] == "©" or text[:20].lower().startswith(RIGHTS),
            n < 25,
            node.name in ("td", "th"),
        )
    # neighbours: their length and their links
    around = np.zeros((len(blocks), 2))
    around[:-1] += own[1:, [2, 3]]
    around[1:] += own[:-1, [2, 3]]
    return np.hstack([own, around / 2])


def fit(pages: list[str], rounds: int = 25, ridge: float = 0.5) -> np.ndarray:
    """Weights of a logistic regression on the blocks of labelled pages (Newton's method)."""
    parsed = [blocks_of(p) for p in pages]
    x = np.concatenate([features(b) for b in parsed if b])
    y = np.array([b.node.y if b.node.y is not None else -1 for p in parsed for b in p])
    x, y = x[y >= 0], y[y >= 0]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return w


@lru_cache(maxsize=1)
def trained() -> tuple[float, ...]:
    return tuple(fit(labelled_pages(TRAINING_PAGES, seed=7)))


def scores(blocks: list[Block], weights: tuple[float, ...] | None = None) -> np.ndarray:
    """Log odds of content, within +-MOST."""
    return np.clip(features(blocks) @ np.array(weights or trained()), -MOST, MOST)


def _edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness: each block with the next one in the page, and with the one before it
    under the same parent, more so if both elements have the same name and class."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, SMOOTH_NEXT / (1 + _tree_distance(blocks[i - 1].node, b.node))))
        parent = id(b.node.parent)
        if parent in last:
            j = last[parent]
            out.append((j, i, SMOOTH_ALIKE if blocks[j].node.kind == b.node.kind else SMOOTH_SIBLING))
        last[parent] = i
    return out


def _tree_distance(a: Node, b: Node) -> int:
    """Steps from one to the other in the tree; more than FURTHEST count as these."""
    steps = 0
    while a is not b and steps < FURTHEST:
        if a.depth >= b.depth and a.parent:
            a = a.parent
        elif b.parent:
            b = b.parent
        steps += 1
    return steps


def decided(costs: list[float], edges: list[tuple[int, int, float]]) -> tuple[list[int], list[float]]:
    """Labels that no cut can change (1 content, 0 boilerplate, -1 open): a node whose
    score outweighs all its open edges takes its sign, and its edges join the scores of
    its neighbours. The second list are the scores with these."""
    near: list[list[tuple[int, float]]] = [[] for _ in costs]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    score, open_ = list(costs), [sum(w for _, w in x) for x in near]
    label = [-1] * len(costs)
    work = [i for i in range(len(costs)) if abs(score[i]) > open_[i]]
    while work:
        i = work.pop()
        if label[i] >= 0:
            continue
        label[i] = int(score[i] > 0)
        for j, w in near[i]:
            if label[j] < 0:
                open_[j] -= w
                score[j] += w if label[i] else -w
                if abs(score[j]) > open_[j]:
                    work.append(j)
    return label, score


def min_cut(costs: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Dinic's max-flow; True for nodes on the source's (the content) side. costs: of
    content, of boilerplate. A node is cut from the source by the cost of boilerplate,
    from the sink by the cost of content."""
    n = len(costs)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def add(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(forth)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, (content, boiler) in enumerate(costs):
        if boiler > 0:
            add(source, i, boiler, 0.0)
        if content > 0:
            add(i, sink, content, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:  # a blocking flow, without recursion
            if a == sink:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                k = next(i for i, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[a] < len(head[a]):
                e = head[a][turn[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(head[a]):
                path.append(e)
                a = to[e]
            elif not path:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]


def labels(blocks: list[Block], weights: tuple[float, ...] | None = None) -> list[bool]:
    """The minimum cut: which blocks are content."""
    edges = _edges(blocks)
    label, score = decided(scores(blocks, weights).tolist(), edges)
    open_ = [i for i, x in enumerate(label) if x < 0]
    if open_:
        at = {i: k for k, i in enumerate(open_)}
        costs = [(0.0, score[i]) if score[i] >= 0 else (-score[i], 0.0) for i in open_]
        cut = min_cut(costs, [(at[a], at[b], w) for a, b, w in edges if a in at and b in at])
        for i, k in zip(open_, cut):
            label[i] = int(k)
    return [x == 1 for x in label]


def main_text(html: str | None, weights: tuple[float, ...] | None = None) -> str:
    if not html:
        return ""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, k in zip(blocks, labels(blocks, weights)) if k)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) per row of ``pages``."""
    weights = trained()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["_id", "_url"]].assign(text=[main_text(h, weights) for h in batch["_html"]])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    out = rows.mapInPandas(each, f"_id {kinds[id_col]}, _url {kinds[url_col]}, text string")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text")
