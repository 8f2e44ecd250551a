"""HTML extraction: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags. Every block has the number of its
words, its link density and the same of the blocks before and after it. Besides
these the tree sees how an element around the block is marked (by a tag or a name
that holds no main text, by a name with a part that often does, or not at all),
whether the block is a heading, whether it lies in the page's article or main
element (or, failing these, an element named like one), and which share of the
page's plain words lies there, so that a teaser in an article element does not
stand for a page whose text is beside it. A classification tree, grown here on the
small labelled table below, tells main text from the rest; the kept blocks are
joined in page order.

Null or empty html is an empty page; pages without main text give an empty string;
cut off pages are read as far as they go; very long pages are read whole and
nothing is capped; equal blocks are each kept in their place; repeated rows give
repeated results, extra columns are ignored, whatever their names; an empty table
gives an empty one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|math|object|video|audio|canvas|title|select|noembed|noframes)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>"
    r"|</?[a-zA-Z][^<>]*\Z",
    re.S | re.I,
)
HINT = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

# Elements that end a block, that hold others, that hold no main text.
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset(
    "article aside blockquote body details dialog div dl fieldset figure footer form header label li main menu nav ol p section span table td th tr ul a button".split()
)
BOILER_TAGS = frozenset("aside button dialog fieldset footer form head label menu nav".split())
# Names that hold no main text, as a whole name or as a part of one.
BOILER_PARTS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert alertdialog announcement banner billboard breadcrumb breadcrumbs "
    "comment comments complementary consent contentinfo cookie cookies copyright disclaimer disqus footer gdpr login masthead menu menubar "
    "nav navbar navigation newsletter notice notices pager paginate pagination popup promo promoted promotion recommended shoutbox sidebar "
    "signin signup sponsor sponsored subscribe subscription tagcloud usercomments".split()
)
# Names that do so as a whole, and as a part only in some cases.
BOILER_NAMES = frozenset(
    "dialog header modal recommend recommendations related replies reply respond rss search share sharing skip social toc toolbar topbar widget".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Names of plain elements that hold the text of a page without such an element.
MAIN_WORDS = frozenset("article articlebody body content entry main maincontent post story text".split())
#: Elements that matter on the stack only when they hold no main text.
LOOSE = frozenset(("li", "td", "th", "tr", "a", "span"))
NAMED_TAGS = frozenset(("div", "section", "td"))
MAIN_ROLES = frozenset(("main", "article"))


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    main: bool
    named: bool
    marked: int
    heading: bool


def _value(m: re.Match) -> str:
    return m.group(1) or m.group(2) or m.group(3) or ""


def _mark(tag: str, attrs: str, in_main: bool) -> int:
    """How an element is marked: 2 holds no main text, 1 may hold none, 0 not at all."""
    if tag in BOILER_TAGS or (tag == "header" and not in_main):
        return 2
    if not attrs:
        return 0
    if HIDDEN.search(attrs):
        return 2
    out = 0
    for m in HINT.finditer(attrs):
        for name in _value(m).lower().split():
            parts = re.split(r"[-_:]+", name)
            if name in BOILER_NAMES or not BOILER_PARTS.isdisjoint(parts):
                if tag not in MAIN_TAGS and tag not in ("body", "html") or "comment" in name or "related" in name or "promo" in name:
                    return 2
            elif not BOILER_NAMES.isdisjoint(parts):
                out = 1
    return out


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, character references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, mark, is main, is named so
    parts: list[str] = []
    linked: list[str] = []
    main = named = links = heading = 0
    marks = [0, 0, 0]

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            raw = "".join(parts)
            found = (html.unescape(raw) if "&" in raw else raw).split()
            if found:
                text, n = " ".join(found), len(found)
                m = len(html.unescape("".join(linked)).split()) if linked else 0
                out.append(Block(text, n, min(m, n), main > 0, named > 0, 2 if marks[2] else min(marks[1], 1), heading > 0))
        parts, linked = [], []

    def text(raw: str) -> None:
        if raw:
            parts.append(raw)
            if links:
                linked.append(raw + " ")

    at = 0
    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if m.group(1):
            if m.group(1).lower() in BLOCK:
                flush()
            continue
        tag = (m.group(3) or m.group(6) or "").lower()
        if not tag:
            continue
        closing = bool(m.group(2) or m.group(5))
        attrs = m.group(4) or m.group(7) or ""
        if tag in BLOCK:
            flush()
        if tag == "a":
            links = 0 if closing else 1
        elif tag in HEADINGS:
            heading = 0 if closing else 1
        elif heading and tag in BLOCK and tag != "br":
            # A heading that was left open ends with the next block.
            heading = 0
        if tag not in CONTAINER or attrs.endswith("/"):
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                if any(s[1] or s[2] or s[3] for s in stack[depth:]):
                    flush()
                for _, b, a, c in stack[depth:]:
                    marks[b] -= 1
                    main -= a
                    named -= c
                del stack[depth:]
            continue
        bad = _mark(tag, attrs, main > 0)
        is_main = tag in MAIN_TAGS or (bool(attrs) and any(x.group(0)[:4].lower() == "role" and _value(x) in MAIN_ROLES for x in HINT.finditer(attrs)))
        is_named = bad < 2 and bool(attrs) and tag in NAMED_TAGS and any(
            p in MAIN_WORDS for x in HINT.finditer(attrs) for p in re.split(r"[-_:\s]+", _value(x).lower()))
        if bad or is_main or is_named:
            flush()
        if tag == "p" and stack and stack[-1][0] == "p":
            # Often left open: a new paragraph ends the one before.
            marks[stack.pop()[1]] -= 1
        if tag in LOOSE and not bad:
            continue
        stack.append((tag, bad, is_main, is_named))
        marks[bad] += 1
        main += is_main
        named += is_named
    text(page[at:])
    flush()
    return out


FEATURES = ("marked", "heading", "inside", "share", "words", "link_density", "words_before", "links_before", "words_after", "links_after")

# The labelled table, from blocks of small pages read by hand. What stands around a block
# is one of a few kinds of surroundings (words and link density of the block before, then of
# the block after); a row gives the kinds in which a block of its shape was read.
AROUND = {
    "text": ((40, 0.0, 35, 0.0), (60, 0.02, 20, 0.0), (12, 0.0, 52, 0.05), (25, 0.0, 3, 0.0), (3, 0.0, 30, 0.0), (7, 0.0, 70, 0.0)),
    "links": ((2, 1.0, 3, 1.0), (5, 1.0, 4, 1.0), (1, 1.0, 1, 1.0), (14, 0.9, 12, 0.8)),
    "then links": ((30, 0.0, 3, 1.0), (48, 0.1, 6, 1.0), (70, 0.0, 1, 1.0)),
    "after links": ((4, 1.0, 25, 0.0), (6, 1.0, 50, 0.05), (1, 1.0, 60, 0.0)),
    "edge": ((0, 0.0, 0, 0.0), (0, 0.0, 20, 0.0), (35, 0.0, 0, 0.0)),
    "lines": ((4, 0.0, 5, 0.0), (3, 0.0, 2, 0.0), (6, 0.0, 0, 0.0)),
}
EVERY = tuple(AROUND)
NEAR_LINKS = ("links", "then links", "after links")
# marked, heading, inside, shares, words, link densities, surroundings, 1 for main text
SHAPES = (
    # menus, adverts, notices, share bars, reader comments, footers: by tag or name, in or beside the article
    (2, 0, 0, (0.0, 0.9), (1, 9, 30, 120), (0.0, 0.3, 1.0), EVERY, 0), (2, 0, 1, (0.9,), (1, 9, 30, 120), (0.0, 0.3, 1.0), EVERY, 0),
    (2, 1, 0, (0.0, 0.9), (2, 6), (0.0, 1.0), EVERY, 0), (2, 1, 1, (0.9,), (2, 6), (0.0, 1.0), EVERY, 0),
    # inside the article: headings, paragraphs of any length, single links between paragraphs, lists of linked titles
    (0, 1, 1, (0.1, 0.9), (1, 3, 7), (0.0, 1.0), EVERY, 1), (0, 0, 1, (0.1, 0.5, 0.9), (1, 2, 5, 12, 30, 80), (0.0, 0.1, 0.3), EVERY, 1),
    (0, 0, 1, (0.9,), (2, 4, 12), (0.5,), ("text", "edge"), 1), (0, 0, 1, (0.5, 0.9), (1, 2, 3, 8, 14), (1.0,), ("text", "edge"), 1),
    (0, 0, 1, (0.5, 0.9), (8, 14), (1.0,), NEAR_LINKS, 1),
    # inside the article: rows of short links
    (0, 0, 1, (0.5, 0.9), (1, 2, 3), (1.0,), NEAR_LINKS, 0),
    # elements with a doubtful name inside the article: titles and sections, then bylines, buttons and lists of links
    (1, 1, 1, (0.5, 0.9), (1, 3, 8), (0.0,), EVERY, 1), (1, 0, 1, (0.5, 0.9), (9, 18, 41, 90), (0.0, 0.1, 0.3), EVERY, 1),
    (1, 0, 1, (0.5, 0.9), (1, 3, 6), (0.0, 0.3), EVERY, 0), (1, 0, 1, (0.5, 0.9), (1, 6, 12, 30), (0.8, 1.0), EVERY, 0),
    # the same on pages without an article, and beside one
    (1, 1, 0, (0.0,), (3, 6), (0.0,), ("text", "after links"), 1), (1, 1, 0, (0.0,), (2, 5), (0.0,), ("links", "then links", "lines"), 0),
    (1, 0, 0, (0.0, 0.2), (22, 33, 64), (0.0, 0.2), EVERY, 1), (1, 0, 0, (0.0, 0.2), (1, 5, 12), (0.0, 0.2), EVERY, 0),
    (1, 0, 0, (0.0, 0.2), (5, 12, 30), (0.8, 1.0), EVERY, 0), (1, 0, 0, (0.7, 0.9), (4, 20, 40), (0.0, 1.0), EVERY, 0), (1, 1, 0, (0.7, 0.9), (3, 6), (0.0,), EVERY, 0),
    # without a telling name, beside an article that holds most of the page's text
    (0, 0, 0, (0.6, 0.9), (2, 8, 18, 40, 90), (0.0, 0.1, 0.3, 1.0), EVERY, 0), (0, 1, 0, (0.6, 0.9), (2, 6), (0.0, 1.0), EVERY, 0),
    # pages of plain elements: paragraphs and headings
    (0, 0, 0, (0.0,), (19, 28, 60, 120), (0.0, 0.1, 0.3), EVERY, 1), (0, 0, 0, (0.0,), (28, 60), (0.4,), EVERY, 1),
    (0, 0, 0, (0.0,), (13, 16), (0.0, 0.1), ("text", "then links", "after links", "edge", "lines"), 1),
    (0, 0, 0, (0.0,), (1, 2, 5, 9), (0.0, 0.1), ("text", "edge", "lines"), 1), (0, 1, 0, (0.0,), (1, 4, 8, 14), (0.0,), ("text", "after links", "edge", "lines"), 1),
    # such pages: link lists, lone lines between them, sign-offs
    (0, 0, 0, (0.0, 0.2), (1, 4, 12, 30), (0.6, 0.8, 1.0), EVERY, 0), (0, 0, 0, (0.0, 0.2), (2, 5, 9), (0.0, 0.1), ("links", "then links"), 0),
    (0, 0, 0, (0.0, 0.2), (13, 16), (0.0,), ("links",), 0), (0, 1, 0, (0.0, 0.2), (2, 5), (0.0, 1.0), ("links",), 0),
    (0, 0, 0, (0.0, 0.2), (2, 5), (0.0,), ("after links",), 0),
    # pages with no more than a teaser in the article element: long text beside it and what stands within that, not lone lines
    (0, 0, 0, (0.1, 0.35), (19, 28, 60, 120), (0.0, 0.1, 0.3), EVERY, 1), (0, 0, 0, (0.1, 0.35), (1, 2, 5, 9, 16), (0.0, 0.1), ("text",), 1),
    (0, 1, 0, (0.1, 0.35), (1, 4, 8), (0.0,), ("text", "after links"), 1), (0, 0, 0, (0.1, 0.35), (1, 2, 5, 9, 16), (0.0, 0.1), ("edge", "lines"), 0),
    (0, 1, 0, (0.1, 0.35), (1, 4, 8), (0.0,), ("edge", "lines"), 0),
)


def expand(shapes) -> tuple[tuple[float, ...], ...]:
    """The rows of the table that ``shapes`` stand for: the features and the label."""
    return tuple(
        (mark, heading, inside, share, words, density, *around, label)
        for mark, heading, inside, shares, lengths, densities, kinds, label in shapes
        for share in shares for words in lengths for density in densities for kind in kinds for around in AROUND[kind]
    )


LABELLED = expand(SHAPES)


@dataclass
class Node:
    """A test ``x[feature] <= limit`` with two branches, or a leaf."""

    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None
    value: bool = False


def grow(x: np.ndarray, y: np.ndarray, depth: int = 14, least: int = 1) -> Node:
    """A classification tree by Gini impurity; ties to the earlier feature and lower limit."""
    leaf = Node(value=bool(2 * y.sum() >= len(y)))
    if depth == 0 or y.all() or not y.any():
        return leaf

    def impurity(v: np.ndarray) -> float:
        p = v.mean()
        return len(v) * 2 * p * (1 - p)

    best = (impurity(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[:-1] + values[1:]) / 2:
            m = x[:, f] <= limit
            if min(m.sum(), (~m).sum()) >= least:
                score = impurity(y[m]) + impurity(y[~m])
                if score < best[0] - 1e-12:
                    best = (score, f, float(limit))
    if best[1] < 0:
        return leaf
    m = x[:, best[1]] <= best[2]
    return Node(best[1], best[2], grow(x[m], y[m], depth - 1, least), grow(x[~m], y[~m], depth - 1, least))


def train(rows=LABELLED) -> Node:
    table = np.array(rows, dtype=float)
    return grow(table[:, :-1], table[:, -1].astype(bool))


def classify(tree: Node, x: tuple[float, ...]) -> bool:
    while tree.feature >= 0:
        tree = tree.low if x[tree.feature] <= tree.limit else tree.high
    return tree.value


def vectors(found: list[Block]) -> list[tuple[float, ...]]:
    """The features of every block."""
    by_tag = any(b.main and b.marked < 2 for b in found)
    inside = [b.main if by_tag else b.named for b in found]
    plain = [b.words - b.link_words if b.marked < 2 else 0 for b in found]
    share = sum(n for n, i in zip(plain, inside) if i) / max(1, sum(plain))
    shape = [(float(b.words), b.link_words / b.words if b.words else 0.0) for b in found]
    edge = (0.0, 0.0)
    return [
        (float(b.marked), float(b.heading), float(inside[i]), share, *shape[i], *(shape[i - 1] if i else edge), *(shape[i + 1] if i + 1 < len(shape) else edge))
        for i, b in enumerate(found)
    ]


def main_text(page: str, tree: Node) -> str:
    found = blocks(page)
    return " ".join([b.text for b, v in zip(found, vectors(found)) if classify(tree, v)])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: Node | None = None) -> DataFrame:
    """One row per page: id, url, main text and its length in code points."""
    tree = tree or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[id_col, url_col, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    page = F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("page")
    return pages.select(id_col, url_col, page).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
