"""Main text of web pages: boosted trees over DOM nodes, decoded over the tree.

Pages are parsed leniently into their block elements. Each gets features of its own tag and attribute tokens, of its ancestors,
its subtree's density, its depth and its siblings; gradient-boosted trees, fitted on a fixed number of generated pages, tell how
likely it belongs to the main text. Decoding takes the likeliest labelling of the whole tree in which everything below a
rejected element is rejected, too.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cortexlake.llm import html_pages as P
from cortexlake.llm.boosting import Trees, fit_trees

#: Generated pages to learn from, and their seed.
TRAINING_PAGES, SEED = 700, 11
#: Pages whose nodes are labelled together.
AT_ONCE = 256

# Kinds of elements.
GROUPS = (
    ("p",), ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"), ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"),
    ("div", "section", "center"), ("article", "main"), ("nav",), ("header",), ("footer",), ("aside", "dialog"), ("form", "fieldset", "label", "button", "select", "textarea", "legend"),
    ("blockquote", "pre", "figure", "figcaption", "details", "summary", "address", "hr"), ("body",),
)
SKIPPED = ("script", "style", "head", "noscript", "template", "svg", "iframe", "object", "canvas", "math")
KIND = {tag: k for k, tags in enumerate(GROUPS) for tag in tags}
BLOCKISH = len(GROUPS)
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd dt", ("dl",)), "dd": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
BAD_TAGS = {KIND[t] for t in ("nav", "header", "footer", "aside", "form")}
BAD_WORDS = frozenset(w for names in (P.AD_NAMES, P.MENU_NAMES, P.SIDE_NAMES, P.NOTICE_NAMES, P.FORM_NAMES, P.SHARE_NAMES, P.COMMENT_NAMES, P.HEAD_NAMES, P.FOOT_NAMES) for n in names for w in n.split("-")) - {"site", "list", "x1", "box", "slot"} | {"navigation", "reply", "banners", "cookies", "sponsor", "promoted", "complementary", "contentinfo", "byline", "tags", "disclaimer"}
GOOD_WORDS = frozenset(w for n in P.MAIN_NAMES for w in n.split("-")) | {"articlebody", "blog", "hentry"}

PART = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<title\b[^>]*>(?:.*?</title\s*>|[^<]*)"
    r"|<(script|style|noscript|template|svg|iframe|object|canvas|math)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">]++)*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<[a-zA-Z/][^>]*\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"[a-z0-9]+")


class Tree:
    """A page's block elements in page order (a parent before its children) and its blocks of text.

    ``marked`` reads the marks of generated pages; in other pages that attribute means nothing.
    """

    def __init__(self, source: str, marked: bool = False):
        self._marked = marked
        self.parent, self.kind, self.bad, self.good, self.mark = [-1], [KIND["body"]], [0], [0], [None]
        self.texts: list[tuple[int, list[str]]] = []
        self.links: dict[int, int] = {}
        self._open: list[tuple[str, int]] = [("body", 0)]
        self._new, self._anchor, self._head = True, False, False
        at = 0
        for m in PART.finditer(source):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            tag = m[3] or m[6]
            if tag:
                (self._close if m[2] or m[5] else self._start)(tag.lower(), m[4] or m[7] or "")
        if at < len(source):
            self._text(source[at:])
        self.blocks = [(n, x) for n, parts in self.texts if (x := " ".join(html.unescape("".join(parts)).split()))]

    def _text(self, raw: str) -> None:
        if self._head:
            return
        node = self._open[-1][1]
        if self._new:
            if raw.isspace():
                return
            self.texts.append((node, []))
            self._new = False
        self.texts[-1][1].append(raw)
        if self._anchor:
            self.links[node] = self.links.get(node, 0) + len(raw.strip())

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("head", "html", "body"):
            self._head = tag == "head"
            return
        if self._head and tag in ("title", "meta", "link", "base"):
            return
        kind = KIND.get(tag, BLOCKISH if "-" in tag else None)
        if kind is None:
            if tag == "a":
                self._anchor = True
            elif tag == "br" and not self._new:
                self.texts[-1][1].append(" ")
            return
        self._head, self._new, self._anchor = False, True, False
        if tag in CLOSES:
            names, stop = CLOSES[tag]
            for k in range(len(self._open) - 1, 0, -1):
                if self._open[k][0] in stop:
                    break
                if self._open[k][0] in names.split():
                    del self._open[k:]
                    if tag != "tr":
                        break
        if self._open[-1][0] == "p" and tag not in ("button", "label", "select"):
            self._open.pop()
        node = len(self.parent)
        self.parent.append(self._open[-1][1])
        self.kind.append(kind)
        bad = good = 0
        mark = None
        if "=" in attributes:
            for name, *value in ATTRIBUTE.findall(attributes):
                value = "".join(value).lower()
                if name.lower() == P.MARK:
                    mark = int(value) if self._marked else None
                    continue
                tokens = TOKEN.findall(value)
                bad += sum(t in BAD_WORDS for t in tokens)
                good += sum(t in GOOD_WORDS for t in tokens)
        self.bad.append(bad)
        self.good.append(good)
        self.mark.append(mark)
        if tag != "hr" and not attributes.endswith("/"):
            self._open.append((tag, node))

    def _close(self, tag: str, _: str) -> None:
        if tag == "a":
            self._anchor = False
        if tag == "head":
            self._head = False
        if tag not in KIND and "-" not in tag or tag in ("body", "html"):
            return
        for k in range(len(self._open) - 1, 0, -1):
            here = self._open[k][0]
            if here == tag or KIND[tag] == 1 == KIND.get(here) if tag in KIND else here == tag:
                del self._open[k:]
                self._new, self._anchor = True, False
                return

    def labels(self) -> list[int]:
        """Of a generated page: 1 for elements of the main text and those around it."""
        out = [1] * len(self.parent)
        for i in range(1, len(out)):
            out[i] = self.mark[i] if self.mark[i] is not None else -1 if out[self.parent[i]] == -1 else out[self.parent[i]] if self._inside(i) else -1
        around = {0}
        for i, m in enumerate(self.mark):
            if m == 1:
                while i > 0:
                    around.add(i)
                    i = self.parent[i]
        return [1 if i in around or x == 1 else 0 for i, x in enumerate(out)]

    def _inside(self, i: int) -> bool:
        while i > 0:
            if self.mark[i] is not None:
                return True
            i = self.parent[i]
        return False


def features(t: Tree) -> np.ndarray:
    """One row per element."""
    n = len(t.parent)
    own = [0] * n
    stops = [0] * n
    for node, text in t.blocks:
        own[node] += len(text)
        stops[node] += text.count(".") + text.count(",")
    text, link, stop, paragraphs, nodes, good_below, bad_text = own[:], [0] * n, stops, [0] * n, [1] * n, [0] * n, [0] * n
    for node, k in t.links.items():
        link[node] = k
    children, depth = [0] * n, [0] * n
    place = [0] * n
    bad_above, good_above, tag_above, main_above = [0] * n, [0] * n, [0] * n, [0] * n
    main_kind = KIND["article"]
    for i in range(1, n):
        p = t.parent[i]
        depth[i] = depth[p] + 1
        place[i] = children[p]
        children[p] += 1
        bad_above[i] = bad_above[p] or t.bad[p]
        good_above[i] = good_above[p] or t.good[p]
        tag_above[i] = tag_above[p] or t.kind[p] in BAD_TAGS
        main_above[i] = main_above[p] or t.kind[p] == main_kind
    for i in range(n - 1, 0, -1):
        p = t.parent[i]
        text[p] += text[i]
        link[p] += link[i]
        stop[p] += stop[i]
        paragraphs[p] += paragraphs[i] + (t.kind[i] == 0)
        nodes[p] += nodes[i]
        good_below[p] |= good_below[i] | (t.good[i] > 0) | (t.kind[i] == main_kind)
        bad_text[p] += text[i] if t.bad[i] or t.kind[i] in BAD_TAGS else bad_text[i]
    out = np.zeros((n, len(GROUPS) + 1 + 19), np.float32)
    out[np.arange(n), t.kind] = 1
    whole = max(text[0], 1)
    up = [0, *t.parent[1:]]
    out[:, len(GROUPS) + 1 :] = [
        (
            t.bad[i], t.good[i], bad_above[i], good_above[i], tag_above[i], main_above[i], log1p(text[i]), min(link[i] / max(text[i], 1), 1), log1p(paragraphs[i]), text[i] / nodes[i],
            100 * stop[i] / max(text[i], 1), text[i] / whole, depth[i], place[i] / max(children[up[i]], 1), children[up[i]], log1p((text[up[i]] - text[i]) / max(children[up[i]], 1)), good_below[i],
            bad_text[i] / max(text[i], 1), t.kind[up[i]] == main_kind or t.good[up[i]] > 0,
        )
        for i in range(n)
    ]
    return out


@lru_cache(1)
def trained() -> Trees:
    r = random.Random(SEED)
    trees = [Tree(P.page(r), marked=True) for _ in range(TRAINING_PAGES)]
    return fit_trees(np.concatenate([features(t) for t in trees]).astype(np.float64), np.concatenate([t.labels() for t in trees]).astype(np.float64))


def chosen(t: Tree, margin: list[float]) -> list[bool]:
    """The likeliest labelling without a chosen element under a rejected one.

    ``margin`` is each element's log odds. Taking an element earns its margin and the best of its children; rejecting it earns 0 for
    all of its subtree. Ties reject.
    """
    n = len(t.parent)
    best = margin[:]
    for i in range(n - 1, 0, -1):
        if best[i] > 0:
            best[t.parent[i]] += best[i]
    out = [best[0] > 0] * n
    for i in range(1, n):
        out[i] = out[t.parent[i]] and best[i] > 0
    return out


def texts_of(sources: list[str], model: Trees) -> list[str]:
    trees = [Tree(s) for s in sources]
    x = [features(t) for t in trees]
    margins = np.split(model.margin(np.concatenate(x)), np.cumsum([len(v) for v in x])[:-1]) if x else []
    out = []
    for t, m in zip(trees, margins):
        keep = chosen(t, m.tolist())
        out.append("\n\n".join(text for node, text in t.blocks if keep[node]))
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Needs ``page_id``, ``url`` and ``html``; more columns are ignored. Null or empty html, and a page without main text, give an
    empty text. Rows with the same id are read one by one, an empty table gives an empty one. Whole pages are
    read, each on its own; no shuffle. The trees are fitted once, on the driver, on TRAINING_PAGES generated pages.
    """
    model = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), AT_ONCE):
                part = b.slice(lo, AT_ONCE)
                out = texts_of([x or "" for x in part.column("html").to_pylist()], model.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return named.mapInArrow(run, "page_id long, url string, text string, n_chars long")
