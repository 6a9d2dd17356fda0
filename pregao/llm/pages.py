"""Main text of web pages from flat text blocks and a decision tree.

A page is read as a flat sequence of text blocks, cut wherever a block-level tag stands.
A block is described by its own words and link density, those of the blocks before and
after it, and what encloses it. A decision tree, trained on the small labelled table below,
says which blocks are main text.

Defined results: null html is an empty page, whose text is empty; a page without any main
block has an empty text; unclosed tags, comments and scripts end with the page, other hidden
elements without end at the next block; class words do not speak against the elements around the
page's largest article (``_acquit``); repeated
rows are rows of their own; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import dataclasses
import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard and words common in class names.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rp rt s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
NOT_MARKUP = frozenset("script style noscript template textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select button object video audio canvas".split())
BOILER_TAGS = frozenset("nav aside footer header form menu dialog fieldset".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside widget footer header masthead topbar toolbar cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup login form search share sharing "
    "social related recommended recommendations comment comments commentlist respond replies reply disqus opinions pagination pager "
    "tags copyright legal disclaimer".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist respond replies reply disqus opinions".split())
MAIN_TAGS = frozenset(["article", "main"])
MAIN_WORDS = frozenset("article main content post entry story body".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
SELF_CLOSING = frozenset(["p", *HEADINGS])
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+)>", re.S
)
UNCLOSED = re.compile(r"()()<(?:!--|[!?]).*()\Z", re.S)  # a comment without end, past the last ">"
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
WORD = re.compile(r"[a-z]+")

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "boiler", "main", "heading")


@dataclasses.dataclass
class Element:
    """An open element: whether it looks like page furniture or holds main text, and what may be said against that."""

    tag: str
    boiler: int = 0
    main: int = 0
    holder: bool = False  # is named as the main text
    doubtful: bool = False  # furniture by name only


@dataclasses.dataclass
class Block:
    text: str
    words: int
    density: float
    boiler: int
    main: int
    heading: int
    inside: tuple[Element, ...] = ()


def _marks(tag: str, attributes: str) -> Element:
    """Whether an element looks like page furniture, and like a holder of main text.

    Furniture is doubtful if the element is named as main text too, is a form, or has furniture words
    only as parts of longer names ("has-sidebar") that do not speak of comments.
    """
    names: set[str] = set()
    if attributes and tag not in ("html", "body"):
        for m in NAMES.finditer(attributes):
            names.update((m[1] or m[2] or m[3] or "").lower().split())
    words = {w for n in names for w in WORD.findall(n)}
    found = words & BOILER_WORDS
    boiler = tag in BOILER_TAGS or (tag != "main" and bool(found))
    holder = tag in MAIN_TAGS or bool(names & MAIN_WORDS)
    parts = tag not in BOILER_TAGS and not names & BOILER_WORDS and not found & COMMENT_WORDS
    return Element(tag, int(boiler), int(tag in MAIN_TAGS or bool(words & MAIN_WORDS)), holder, holder or tag == "form" or parts)


def _acquit(found: list[Block]) -> None:
    """Take the mark from doubtful elements around the page's largest holder of main text.

    The holder must have more words outside links than stand in all unmarked blocks elsewhere.
    """
    plain: dict[int, float] = {}
    chains: dict[int, tuple[Element, ...]] = {}
    clean = 0.0
    for b in found:
        words = b.words * (1 - b.density)
        marked = max((k for k, e in enumerate(b.inside) if e.boiler), default=-1)
        if marked < 0:
            clean += words
        elif all(e.doubtful for e in b.inside if e.boiler):
            for k, e in enumerate(b.inside):
                # Only what stands in no other marked element below counts for the holder.
                if e.holder and marked <= k:
                    plain[id(e)] = plain.get(id(e), 0.0) + words
                    chains[id(e)] = b.inside[: k + 1]
    best = max(plain, key=lambda k: plain[k], default=None)
    if best is not None and plain[best] > clean:
        for e in chains[best]:
            e.boiler = 0


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, without empty ones."""
    found: list[Block] = []
    stack: list[Element] = []  # open block-level elements
    parts: list[str] = []
    linked = links = at = 0  # ``links`` is one more than the elements open when the link began
    last = page.rfind(">") + 1

    def close() -> None:
        nonlocal parts, linked
        words = "".join(parts).split()
        if words:
            heading = int(any(e.tag in HEADINGS for e in stack[-2:]))
            main = int(any(e.main for e in stack))
            found.append(Block(" ".join(words), len(words), min(1.0, linked / len(words)), 0, main, heading, tuple(stack)))
        parts, linked = [], 0

    def text(piece: str) -> None:
        nonlocal linked
        piece = html.unescape(piece)
        parts.append(piece)
        if links:
            linked += len(piece.split())

    while True:
        m = TOKEN.search(page, at, last) if at < last else None
        m = m or UNCLOSED.search(page, max(at, last))
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        opening = not m[1]
        if tag in INLINE:
            if tag == "a":
                links = len(stack) + 1 if opening else 0
            elif tag == "br":
                parts.append(" ")
            if opening and tag not in VOID and m[3] and _hidden(m[3]):
                at = _skip(page, tag, at)
            continue
        if opening and (tag in RAW or (m[3] and tag not in VOID and tag not in ("html", "body") and _hidden(m[3]))):
            close()
            if not m[3].endswith("/"):
                at = _skip(page, tag, at)
            continue
        close()
        if opening:
            while stack and stack[-1].tag in SELF_CLOSING:
                stack.pop()
            if stack and stack[-1].tag in SIBLINGS.get(tag, ()):
                stack.pop()
            # A link holds blocks, but ends with the element in which it began.
            links = links if links <= len(stack) + 1 else 0
            if tag not in VOID:
                stack.append(_marks(tag, m[3]))
        elif any(e.tag == tag for e in stack):
            while stack.pop().tag != tag:
                pass
            links = links if links <= len(stack) + 1 else 0
    close()
    _acquit(found)
    for b in found:
        b.boiler = int(any(e.boiler for e in b.inside))
    return found


def _hidden(attributes: str) -> bool:
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "style" and NOT_SHOWN.search(value)) or (name == "aria-hidden" and value.strip().lower() == "true"):
            return True
    return False


def _skip_implied(page: str, tag: str, at: int) -> int:
    """Place where an element ends that may go without end tag: a sibling's start and the parent's end close it."""
    stack = [tag]
    while m := TOKEN.search(page, at):
        at, inner = m.end(), (m[2] or "").lower()
        if not inner or inner in INLINE or inner in VOID:
            continue
        if m[1]:
            if inner not in stack:
                return m.start()
            while stack.pop() != inner:
                pass
            if not stack:
                return at
            continue
        if inner in RAW:
            at = at if m[3].endswith("/") else _skip(page, inner, at)
            continue
        while stack and (stack[-1] in SELF_CLOSING or stack[-1] in SIBLINGS.get(inner, ())):
            stack.pop()
        if not stack:
            return m.start()
        stack.append(inner)
    return len(page)


def _skip(page: str, tag: str, at: int) -> int:
    """Place after the element's end tag, nested elements of that name included.

    Without an end tag, what is not markup ends with the page, another element at the next block-level tag.
    """
    if tag == "p" or tag in SIBLINGS:
        return _skip_implied(page, tag, at)
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).finditer(page, at):
        # The content of scripts and styles is not markup.
        depth += -1 if m[1] else int(tag not in ("script", "style", "textarea", "title"))
        if not depth:
            return m.end()
    if tag in NOT_MARKUP:
        return len(page)
    return next((m.start() for m in TOKEN.finditer(page, at) if m[2] and m[2].lower() not in INLINE), len(page))


def features(found: list[Block]) -> np.ndarray:
    rows = []
    for i, b in enumerate(found):
        before = found[i - 1] if i else None
        after = found[i + 1] if i + 1 < len(found) else None
        near = [x for n in (before, after) for x in ((n.words, n.density) if n else (0, 0.0))]
        rows.append([b.words, b.density, *near, b.boiler, b.main, b.heading])
    return np.array(rows, float).reshape(-1, len(FEATURES))


# A tree is a leaf (0 or 1) or (feature, limit, tree up to the limit, tree above it).
Tree = int | tuple


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Tree:
    """Decision tree by greatest fall in Gini impurity; ties go to the first feature and lowest limit."""
    share = y.mean()
    if depth == 0 or share in (0, 1) or len(y) < 2 * least:
        return int(share >= 0.5)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, good = x[order, f], np.cumsum(y[order])
        for cut in np.flatnonzero(values[1:] > values[:-1]) + 1:
            if cut < least or len(y) - cut < least:
                continue
            a, b = good[cut - 1] / cut, (good[-1] - good[cut - 1]) / (len(y) - cut)
            impurity = cut * a * (1 - a) + (len(y) - cut) * b * (1 - b)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, (values[cut - 1] + values[cut]) / 2)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return int(share >= 0.5)
    _, f, limit = best
    low = x[:, f] <= limit
    return f, float(limit), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def decide(tree: Tree, row: list[float]) -> int:
    while isinstance(tree, tuple):
        f, limit, low, high = tree
        tree = low if row[f] <= limit else high
    return tree


_LONG = "The council met on Tuesday to weigh a plan that would move the old market hall to a new site by the river next spring."
_MORE = "Residents spoke for almost two hours, most of them in favour, though several asked how the move would be paid for and when."
_SHORT = "A vote is due."
# The labelled table: a page, and a label for each of its blocks in order (1 main text).
LABELLED: list[tuple[str, str]] = [
    (
        f"<nav><ul><li><a href=1>Home</a><li><a href=2>World news</a><li><a href=3>Sport</a></ul></nav><div class='ad'>Fresh offers every day of the week.</div>"
        f"<article><h1>Market hall to move</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_MORE}</p></article><footer>&copy; Example press. {_SHORT}</footer>",
        "000" "0" "1111" "0",
    ),
    (
        f"<header><p>The Daily Example</p><p>All the news of the town and the valley around it, every single morning.</p></header><main><h2>Plans</h2><p>{_MORE}</p><p>No.</p>"
        f"<p>{_LONG} <a href=x>Read the plan</a></p></main><aside><h3>Most read</h3><p>{_LONG}</p></aside>",
        "00" "1111" "00",
    ),
    (
        f"<div id=menu><a href=1>News</a> <a href=2>Culture</a></div><div><h1>River path reopens</h1><div>{_LONG}</div><div>{_MORE}</div><div>{_LONG} {_MORE}</div></div>"
        "<div><a href=1>Terms</a> <a href=2>Privacy</a> <a href=3>Contact us</a></div><div>All rights reserved.</div>",
        "0" "1111" "00",
    ),
    (
        f"<article><h1>Review</h1><p>{_LONG}</p><ul><li>Good light and plenty of room</li><li>Short walk</li></ul><p>{_SHORT}</p></article>"
        f"<section id='comments'><h3>Comments</h3><p>{_MORE}</p><p>I agree.</p></section><form><p>Write your own comment about this story here and send it to us.</p></form>",
        "11111" "000" "0",
    ),
    (
        f"<div class='cookie-notice'><p>{_MORE}</p></div><article><p>{_LONG}</p><div class='advert'>{_SHORT}</div><p>{_MORE}</p><p><a href=1>Read</a> {_SHORT}</p>"
        "<p><a href=9>The full report can be read here</a></p></article><div class='related'><a href=1>Old bridge closed</a></div><div class='newsletter'>Get our letter each week.</div>",
        "0" "101" "11" "00",
    ),
    (
        f"<table><tr><td><a href=1>Start</a></td><td><a href=2>Archive of all years</a></td></tr></table><p>{_LONG}</p><p>{_MORE}</p><p>{_LONG}</p><p><a href=1>Back to the top</a></p>",
        "00" "111" "0",
    ),
    (
        f"<div class='sidebar'><p>{_LONG}</p><p><a href=1>More of this</a></p></div><div class='content'><h1>Bread prices</h1><p>{_MORE}</p><p>Why?</p><p>{_LONG}</p></div><div class='footer'><p>{_MORE}</p></div>",
        "00" "1111" "0",
    ),
    (
        f"<p><a href=1>Home</a> | <a href=2>About</a></p><p>Log in</p><h1>Harvest begins early</h1><p>{_LONG}</p><p>{_MORE}</p><p>Share this</p><p><a href=1>Next story: rain</a></p><p>Contact: desk</p>",
        "00" "111" "000",
    ),
    (
        f"<article><header><h1>Night trains return</h1><p>By our desk</p></header><p>{_MORE}</p><blockquote>{_SHORT}</blockquote><h2>What it costs</h2><p>{_LONG}</p><aside>{_LONG}</aside></article><footer><a href=1>Imprint</a></footer>",
        "00" "1111" "0" "0",
    ),
    (
        "<p>Offers</p><p>Sign in</p><p>Basket</p><article><h1>Songs</h1><p>Go.</p><p>Go on.</p><p>Come back.</p><p>Go on.</p><p>Go.</p><p>Now.</p><p>Go.</p><p>Yes.</p></article>",
        "000" "111111111",
    ),
    (
        f"<p>Edition</p><p>Town</p><p>Weather</p><p>Two degrees</p><main><p>Then.</p><p>{_LONG}</p><p>Then.</p><p>Stop.</p></main><p>Desk</p><p>Top</p>",
        "0000" "1111" "00",
    ),
    (
        f"<div><a href=1>Front page</a></div><div><a href=2>Letters to the editor of this paper</a></div><div>{_LONG}</div><div><a href=3>Older letters</a></div><div>{_MORE}</div>",
        "00101",
    ),
    (
        f"<p><a href=1>Skip to text</a></p><p>{_MORE}</p><p>{_LONG}</p><p>It opened in <a href=2>March</a>, after a long and costly repair of the roof and the floor.</p><p><a href=4>See all pictures</a></p><p>{_LONG}</p>",
        "011101",
    ),
    # Without class words: headlines of other stories are long but linked, short lines belong to their neighbours.
    (
        f"<div><a href=1>{_LONG}</a></div><div><a href=2>{_MORE}</a></div><div>{_MORE}</div><div>{_SHORT}</div><div>{_LONG}</div><div>{_MORE} <a href=5>Map</a></div>"
        f"<div><a href=3>{_MORE}</a></div><div><a href=4>{_LONG} {_SHORT}</a></div>",
        "00" "1111" "00",
    ),
    (
        f"<p><a href=1>{_MORE}</a></p><p>{_LONG}</p><p>{_SHORT}</p><p>{_MORE}</p><p>Go on.</p><p>{_LONG}</p><p><a href=2>{_LONG}</a></p><p>All for you</p><p>Your town</p>",
        "0" "11111" "000",
    ),
    (
        f"<div><a href=1>{_LONG}</a></div><div><a href=2>{_MORE}</a></div><div><a href=3>{_LONG} {_SHORT}</a></div><div>{_LONG}</div><div>{_MORE}</div><div><a href=3>{_MORE} {_SHORT}</a></div>",
        "000" "11" "0",
    ),
    (f"<div class='popup'>{_LONG}</div><div role='navigation'><a href=1>Up</a></div><main><p>{_SHORT}</p></main><div class='legal'>{_MORE}</div>", "0" "0" "1" "0"),
]


@functools.cache
def trained() -> Tree:
    rows, labels = [], []
    for page, marks in LABELLED:
        found = blocks(page)
        if len(found) != len(marks):
            raise ValueError(f"{len(found)} blocks, {len(marks)} labels: {page[:60]}")
        rows.append(features(found))
        labels += map(int, marks)
    return grow(np.concatenate(rows), np.array(labels))


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    rows = features(found).tolist()
    return "\n".join(b.text for b, row in zip(found, rows, strict=True) if decide(tree, row))


def _extract(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page or "", tree) for page in batch.column("html").to_pylist()]
        names = [n for n in batch.schema.names if n != "html"]
        yield pa.record_batch([*[batch.column(n) for n in names], pa.array(texts, pa.string())], names=[*names, "text"])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    tree = trained()
    found = rows.mapInArrow(lambda batches: _extract(batches, tree), "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
