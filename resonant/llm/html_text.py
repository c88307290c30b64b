"""Operator 3: HTML extraction from flat text blocks by a decision tree.

A page is cut into flat text blocks at block-level tags. Each block is described by its word count
and link density, those of its neighbours, whether it is a heading, and counts of the open elements
around it whose tag or name tells of main text or of boilerplate, and which of them is innermost. No
feature decides by itself: a decision tree trained on the blocks of the small labelled pages LABELLED
tells main text from the rest. Names count word by word, but not words that only say how a thing looks or
what it has (`with-sidebar`, `no-comments`, `sidebar-right`).

Defined results. Null pages are empty: an empty text. Unclosed tags, quotes, comments and cut-off
pages are read to their end; a link that is never closed ends with its block. Repeated rows each get their
row; extra columns are ignored; an empty table gives an empty result; pages of any length are read whole, one
at a time. Where the tree's labels tie, a block is main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|math|object|canvas|textarea|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*)([^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("address article aside body button dialog details div fieldset figure footer form header main menu nav ol section table ul".split())
BOILER_TAGS = frozenset("nav footer header aside form menu button dialog fieldset head".split())
MAIN_TAGS = frozenset("article main".split())
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
LINK = re.compile(r"(?:^|\s)href\s*=", re.IGNORECASE)
ANCHOR = re.compile(r"<(/?)a\b", re.IGNORECASE)
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies copyright disclaimer disqus "
    "footer gdpr header legal login masthead menu modal nav navbar navigation navigator newsletter notice notices overlay pager pagination paywall popup promo promoted promotion recommended related reply replies "
    "respond share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget complementary search teaser".split()
)
MAIN_NAMES = frozenset("article content main post story entry body text articlebody maincontent".split())
#: Words before or after a name that make it say how something looks or what it has, not what it is.
ASIDE_WORDS, LAYOUT_WORDS = frozenset("with without no not non has have is hide show under below above before after left right".split()), frozenset("layout left right on off open closed enabled disabled active hidden visible true false count".split())
FEATURES = ("main_tags", "main_names", "boiler_tags", "boiler_names", "nearest", "words", "links", "words_before", "links_before", "words_after", "links_after", "heading")
#: Labelled pages: a block `+n` is main text of n words, `-n` is not; `_n` stands for n more words of its block. The function that reads
#: pages turns them into rows of FEATURES, so the tree is trained on what it will see.
LABELLED = (
    '<header><h1>-2</h1></header><nav><ul><li><a href=1>-1</a><li><a href=1>-2</a><li><a href=1>-1</a></ul></nav><article><h1>+7</h1><p>+60<p>+35<p>+2<p>+90</article><aside><h3>-2</h3><p>-30<p><a href=1>-8</a></aside><footer>-9</footer>',
    '<div id="top" class="menu"><a href=1>-1</a> <a href=1>_2</a></div><div id="content"><h1>+5</h1><div class="post"><p>+45<p>+80<p>+4<p>+22</div><div class="comments"><p>-25<p>-40<p>-3</div></div><div class="sidebar"><h3>-2</h3><p>-18<p><a href=1>-6</a></div><div id="footer">-12</div>',
    '<div><a href=1>-1</a> <a href=1>_1</a> <a href=1>_2</a></div><h1>+8</h1><p>+70<p>+40<p>+55<p>+28<div><a href=1>-2</a> <a href=1>_3</a></div><div>-6</div>',
    '<main class="sidebar-right"><h2>+4</h2><p>+50<p>+3<p>+33</main><div class="cookie-notice">-14</div><div class="ad">-9</div><div class="ad">-45</div><footer><p>-30<p>-5</footer>',
    '<article><h1>+6</h1><p>+40 <a href=1>_3</a><ul><li><a href=1>-4</a><li><a href=1>-6</a><li><a href=1>-3</a></ul><p>+52<ul><li>+5<li>+8 <a href=1>_2</a><li>+11</ul><p>+30</article>',
    '<a href=1><div>-5<p>-14</div></a><a href=1><div>-4<p>-18</div></a><article><p>+65<p>+30</article><a href=1><h3>-6</h3><p>-20</a><a href=1><h3>-7</h3><p>-25</a>',
    '<article><a href=1><div>-4<p>-15</div></a><h2>+3</h2><p>+48<p>+1<p>+75<a href=1><div>-6<p>-22</div></a><a href=1><div>-5<p>-17</div></a></article>',
    '<main><form><label>-3</label><p>-12</form><h1>+9</h1><p>+38<p>+5<section><h2>+2</h2><p>+85<p>+14</section><section id="comments"><h2>-2</h2><p>-60<p>-35<p>-4</section></main>',
    '<div class="newsletter"><p>-22<p>-4</div><div class="story"><h1>+10</h1><p>+44<blockquote>+20</blockquote><table><tr><td>+2<td>+3<tr><td>+1<td>+4</table><p>+31</div><div class="related"><p><a href=1>-7</a><p><a href=1>-9</a></div><p>-8 <a href=1>_6</a>',
    '<div><p><a href=1>-2</a> | <a href=1>_2</a><p>-4</div><div><h1>+7</h1><p>+120<p>+64<p>+90</div><div><p><a href=1>-9</a><p><a href=1>-7</a><p><a href=1>-8</a></div><div>-10</div>',
    '<article><nav><a href=1>-3</a></nav><h1>+5</h1><p>+36<div class="share"><p>-3<p>-2</div><aside><p>-28<p>-50</aside><p>+41<footer><p>-16</footer></article>',
    '<div class="notice"><p>-35</div><article><p>+1<p>+2<p>+1<p>+3</article><div class="promo"><p>-55<p>-6</div><div role="complementary"><p>-20</div>',
    '<p>-3 <a href=1>_4</a><p>-2<h1>+6</h1><p>+58<p>+47<p>+66<h2>+3</h2><p>+39<p>-2 <a href=1>_5</a>',
    '<ul><li><a href=1>-1</a><li><a href=1>-2</a><li><a href=1>-1</a></ul><p>+95<p>+72<h2>+3</h2><p>+80<p>+9<p>+68<div><a href=1>-40</a></div><div><a href=1>-52</a> <a href=1>_20</a></div><p>-9',
    '<div>-4</div><div><a href=1>-3</a></div><p>+110<ul><li><a href=1>-6</a><li><a href=1>-7</a></ul><p>+75<p>+18<p>+88<div><a href=1>-44</a> <a href=1>_30</a></div><div>-5</div>',
    '<h1>+4</h1><p>+16<p>+21<p>+14<p>+25<div><a href=1>-2</a> <a href=1>_2</a> <a href=1>_1</a></div><div><a href=1>-3</a></div><div>-7</div>',
    '<div><a href=1>-6</a> <a href=1>_5</a></div><p>+130<h2>+5</h2><p>+26 <a href=1>_4</a><p>+90<p>+3<p>+105<div>-3 <a href=1>_9</a></div><div><a href=1>-12</a></div>',
    '<p><a href=1>-4</a><h1>+9</h1><p>+24<p>+85<p>+31<h2>+2</h2><p>+19<p>+78<p><a href=1>-11</a><p><a href=1>-13</a><p>-4',
    '<div><a href=1>-1</a></div><div>-3</div><div>-2</div><p>+62<p>+20<p>+45<div>-3</div><div><a href=1>-2</a></div><div>-8</div>',
    '<div id="main"><p>+33<p>+8<p>+2<p><a href=1>-9</a><p><a href=1>-8</a></div><div class="social"><p>-6<p>-31</div><div class="legal"><p>-85</div>',
    '<div class="sidebar"><article><h3>-4</h3><p>-25<p>-40</article></div><main><section><p>+6<p>+51<p>+47</section></main><aside><article><p>-20</article></aside>',
    '<div class="sidebar"><article><h3>-3</h3><p>-20<p>-12</article></div><article class="post"><p>+55<p>+6<p>+20</article><div class="widget"><p>-9</div>',
)


#: Around and in the main text, and the like for boilerplate: pages of all their pairs are labelled, too.
MAIN_AROUND = (
    "<article>%s</article>", "<main>%s</main>", '<div class="post">%s</div>', '<div id="content">%s</div>', '<article class="post has-comments">%s</article>', "<main><section>%s</section></main>",
    '<main class="sidebar-left">%s</main>', '<div class="page"><div class="article-body">%s</div></div>', "<main><article>%s</article></main>",
)
MAIN_IN = (
    "<h1>+6</h1><p>+60<p>+35<p>+2<p>+90", "<p>+3", "<p>+1<p>+2<p>+1", "<h2>+4</h2><p>+15", "<p>+20<p>+7", "<h1>+9</h1><p>+5<p>+44 <a href=1>_6</a><ul><li>+4<li>+9 <a href=1>_2</a></ul>",
    "<p>+30<ul><li><a href=1>-3</a><li><a href=1>-5</a><li><a href=1>-2</a></ul><p>+28", "<p>+110<a href=1><div>-5<p>-16</div></a><p>+12<p>+1", "<p>+48<div><a href=1>-7</a> <a href=1>_4</a></div>",
    "<p>+7 <a href=1>_7</a><p>+30<p>+4 <a href=1>_3</a><p>+2 <a href=1>_2</a><p>+16",
)
BOILER_AROUND = (
    "<nav>%s</nav>", "<header>%s</header>", "<footer>%s</footer>", "<aside>%s</aside>", "<form>%s</form>", '<div class="ad">%s</div>', '<div class="sidebar">%s</div>', '<div class="comments">%s</div>', '<div class="cookie-notice">%s</div>',
    '<div id="newsletter">%s</div>', '<ul class="menu">%s</ul>', '<div role="complementary">%s</div>', '<div class="sidebar"><article>%s</article></div>', "<article><aside>%s</aside></article>", '<main><section id="comments">%s</section></main>', '<div class="post"><div class="share">%s</div></div>', "<main><form>%s</form></main>",
)
BOILER_IN = ("<p>-9", "<p>-45", "<div><a href=1>-2</a> <a href=1>_3</a></div>", "<p>-25<p>-40<p>-3", "<h3>-2</h3><p>-30", "<li><a href=1>-1</a><li><a href=1>-2</a><li><a href=1>-1</a>", "<p>-90")


def labelled_pages() -> list[str]:
    out = list(LABELLED)
    boiler = [around % within for around in BOILER_AROUND for within in BOILER_IN]
    main = [around % within for around in MAIN_AROUND for within in MAIN_IN]
    for i, page in enumerate(boiler):
        out.append(page + main[i * 7 % len(main)])
    for i, page in enumerate(main):
        out += [page, page + boiler[i * 5 % len(boiler)], boiler[i * 11 % len(boiler)] + page]
    return out


def labelled_rows(pages: Iterable[str] | None = None) -> list[tuple]:
    """Rows of FEATURES with the label last, from labelled pages."""
    out = []
    for page in labelled_pages() if pages is None else pages:
        found = blocks(re.sub(r"([+_-])(\d+)", lambda m: " ".join([f"{m[1]}w"] + ["w"] * (int(m[2]) - 1)), page))
        out += [(*row, int(b.text[0] == "+")) for row, b in zip(rows(found), found)]
    return out


def grow(table: list[tuple], depth: int = 8):
    """A classification tree by Gini impurity: (feature, cut, low, high) or the label of a leaf."""
    return _grown(np.array(table, np.float64), depth)


def _grown(table: np.ndarray, depth: int):
    y = table[:, -1]
    n, ones = len(y), y.sum()
    label = int(2 * ones >= n)
    least, best = 2 * ones * (n - ones) / n - 1e-9, None
    if not depth or ones in (0, n):
        return label
    for f in range(table.shape[1] - 1):
        order = np.argsort(table[:, f], kind="stable")
        x, low = table[order, f], np.cumsum(y[order])[:-1]
        k = np.arange(1, n)
        impurity = np.where(x[1:] > x[:-1], 2 * low * (k - low) / k + 2 * (ones - low) * (n - k - ones + low) / (n - k), np.inf)
        if len(impurity) and impurity.min() < least - 1e-9:
            i = int(impurity.argmin())
            least, best = impurity[i], (f, float(x[i] + x[i + 1]) / 2)
    if best is None:
        return label
    f, cut = best
    below = table[:, f] <= cut
    return f, cut, _grown(table[below], depth - 1), _grown(table[~below], depth - 1)


@lru_cache(maxsize=1)
def default_tree():
    return grow(labelled_rows())


def classify(tree, row: tuple) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


class Evidence(NamedTuple):
    """What the open elements around a block tell."""

    main_tags: int = 0
    main_names: int = 0
    boiler_tags: int = 0
    boiler_names: int = 0
    nearest: int = 0  # 1: the innermost that tells something tells main text, -1: boilerplate


def inside(around: Evidence, tag: str, attributes: str) -> Evidence:
    """The evidence within an element."""
    main_tag, boiler_tag = tag in MAIN_TAGS, tag in BOILER_TAGS
    main_name = boiler_name = False
    if attributes:
        for m in NAMES.finditer(attributes):
            for name in (m[2] or m[3] or m[4] or "").lower().split():
                parts = re.split(r"[^a-z0-9]+", name)
                said = [p for i, p in enumerate(parts) if p in BOILER_NAMES and not (i and parts[i - 1] in ASIDE_WORDS) and not (i + 1 < len(parts) and parts[i + 1] in LAYOUT_WORDS)]
                boiler_name = boiler_name or bool(said)
                main_name = main_name or (not said and any(p in MAIN_NAMES for p in parts))
        boiler_tag = boiler_tag or bool(HIDDEN.search(attributes))
    if main_tag or (main_name and not boiler_tag):
        boiler_name = boiler_name and not main_tag
    nearest = -1 if boiler_tag or (boiler_name and not main_tag) else 1 if main_tag or main_name else around.nearest
    return Evidence(around.main_tags + main_tag, around.main_names + main_name, around.boiler_tags + boiler_tag, around.boiler_names + boiler_name, nearest)


class Block(NamedTuple):
    text: str
    words: int
    linked: int  # words in links
    heading: bool
    evidence: Evidence


def blocks(page: str) -> list[Block]:
    """Every non-empty block in page order."""
    out: list[Block] = []
    stack: list[tuple[str, Evidence]] = []  # open containers, each with the evidence inside it
    pieces: list[str] = []
    linked = heading = 0
    nothing = Evidence()
    own: Evidence | None = None
    link = 0  # 1: in a link that ends with its block, 2: in one that is closed further on
    at = 0

    def text_to(end: int) -> None:
        nonlocal linked
        if end > at:
            piece = page[at:end]
            if "&" in piece:
                piece = html.unescape(piece)
            pieces.append(piece)
            if link:
                linked += len(piece.split())

    def flush() -> None:
        nonlocal linked
        if pieces:
            words = "".join(pieces).split()
            if words:
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), bool(heading), own or (stack[-1][1] if stack else nothing)))
            pieces.clear()
        linked = 0

    for m in TOKEN.finditer(page):
        text_to(m.start())
        at = m.end()
        tag = m[3] or m[6]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag in INLINE:
            if tag == "a":
                link = 0
                if not closing and LINK.search(attributes):
                    after = ANCHOR.search(page, at)
                    link = 2 if after and after[1] else 1
            elif tag == "br":
                pieces.append(" ")
            continue
        flush()
        if link == 1:
            link = 0
        own, heading = None, 0
        around = stack[-1][1] if stack else nothing
        if tag in CONTAINERS:
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            elif tag != "body":
                stack.append((tag, inside(around, tag, attributes)))
        elif not closing:
            heading = int(len(tag) == 2 and tag[0] == "h" and tag[1] in "123456")
            if attributes.strip() or tag == "head":
                own = inside(around, tag, attributes)
    text_to(len(page))
    flush()
    return out


def rows(found: list[Block]) -> list[tuple]:
    """FEATURES of each block."""
    around = [(0, 0.0), *((b.words, b.linked / b.words) for b in found), (0, 0.0)]
    return [(*b.evidence, *around[i], *around[i - 1], *around[i + 1], int(b.heading)) for i, b in enumerate(found, 1)]


def extract(page: str | None, tree=None) -> str:
    """The main text of one page."""
    found = blocks(page or "")
    tree = default_tree() if tree is None else tree
    return "\n\n".join(b.text for b, row in zip(found, rows(found)) if classify(tree, row))


def report(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per page page_id, url, text and n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c for c in batch.schema.names if c != "html"]
            texts = [extract(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*names, "text", "n_chars"])

    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).cast("string").alias("html"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "html")
    return source.mapInArrow(run, f"{kinds}, text string, n_chars long")
