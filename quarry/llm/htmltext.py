"""Main text of web pages from flat text blocks.

A page is cut into flat blocks of text at its block-level tags.  A block has
its word count and link density, those of the blocks before and after it, and
two marks of where it stands: inside the article, and inside something whose
tag, role, class or id names page furniture.  A class or id names furniture as
a whole (`cookie-notice`, `commentList`), not by a word in it (`with-sidebar`,
`related-work`), and an article inside such an element is an article.  A decision tree decides for each
block whether it is main text; the tree is trained on the small labelled table
below, whose rows are made up for the purpose.

Defined results: a null or empty page, or one without main text, has an empty
text; tags that are never closed end with what encloses them; script, style
and other non-text elements are skipped whole, and without an end tag the raw
ones of them (script, style, iframe, textarea, title) take the rest of the
page, the others end at the next block as well; a tag whose quote or
bracket is never closed is text; time follows the length of the page; repeated
rows repeat; an empty table gives an empty one; other columns are left behind.
"""
from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import column, map_arrow, text_blocks, texts_of

_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template svg math canvas iframe object audio video textarea select title head button datalist map".split())
#: Those of them whose content is no markup: only their own end tag ends them.
RAW_TEXT = frozenset("script style iframe textarea title".split())
#: Tags that end a skipped element without an end tag, as does the end of what encloses it.
_BEGINS = frozenset("article main section p h1 h2 h3 h4 h5 h6 div ul ol dl table blockquote pre figure header footer nav aside form address hr".split())
#: Elements that leave a block whole.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner nav navbar "
                            "navigation menu breadcrumb breadcrumbs sidebar sidebars footer masthead cookie cookies consent gdpr notice notices popup "
                            "modal newsletter subscribe subscription signup login comment comments respond disqus related recommended share sharing "
                            "social widget widgets toolbar pagination pager".split())
#: Words that may follow one of these in the name of a piece of furniture.
NEUTRAL_WORDS = frozenset("area bar block body bottom box btn button buttons card cards center col column columns container content entry form group head header "
                          "inner item items left link links list main outer panel post posts right row section slot tab title top unit wrap wrapper zone".split())
_UNCLOSED = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody"))


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    article: bool
    furniture: bool


def _names_furniture(name: str) -> bool:
    """Whether one class or id is the name of a piece of furniture: it begins
    with a word for it, and says nothing else."""
    words = [w.lower() for w in _WORD.findall(name)]
    return bool(words) and words[0] in FURNITURE_WORDS and all(w in FURNITURE_WORDS or w in NEUTRAL_WORDS or w.isdigit() for w in words[1:])


#: How sure it is that an element is furniture.
NO, NAMED, SURE = range(3)


def _furniture(tag: str, attributes: str, in_article: bool) -> int:
    if tag in FURNITURE_TAGS or (tag == "header" and not in_article):
        return SURE
    if not attributes or tag in ("html", "body", "main", "article"):
        return NO
    found = NO
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return SURE
        if name == "role" and value in FURNITURE_ROLES:
            return SURE
        if name in ("class", "id") and any(map(_names_furniture, value.split())):
            found = NAMED
    return found


class Mark:
    """A piece of markup; tag is empty for comments and declarations."""

    __slots__ = ("start", "end", "closing", "tag", "attributes")

    def __init__(self, start: int, end: int, closing: bool = False, tag: str = "", attributes: str = ""):
        self.start, self.end, self.closing, self.tag, self.attributes = start, end, closing, tag, attributes


_OPENS = re.compile(r"<(?:(?P<comment>!--)|(?P<cdata>!\[CDATA\[)|(?P<other>[!?])|(?P<closing>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*))")
_STOPS = re.compile("[>\"']")


class Scanner:
    """Finds the markup of a page from left to right, in time that follows its
    length: what a search that ended in nothing has seen is not read again."""

    def __init__(self, page: str):
        self.page = page
        self._stop = (0, -1)  # the first > or quote for places from .. to
        self._open: set[int] = set()  # quotes at which a tag began that never ends

    def _next_stop(self, at: int) -> int:
        """The first > or quote from here, or the length of the page."""
        since, found = self._stop
        if not since <= at <= found:
            m = _STOPS.search(self.page, at)
            self._stop = (at, m.start() if m else len(self.page))
        return self._stop[1]

    def _tag_end(self, at: int) -> int:
        """Behind the > that ends the tag, or -1."""
        page, opened = self.page, []
        while True:
            stop = self._next_stop(at)
            if stop < len(page) and page[stop] == ">":
                return stop + 1
            close = page.find(page[stop], stop + 1) if stop < len(page) and stop not in self._open else -1
            if close < 0:
                self._open.update(opened)
                if stop < len(page):
                    self._open.add(stop)
                return -1
            opened.append(stop)
            at = close + 1

    def search(self, at: int) -> Mark | None:
        page = self.page
        while m := _OPENS.search(page, at):
            if m["comment"] or m["cdata"]:
                sign = "-->" if m["comment"] else "]]>"
                end = page.find(sign, m.end())
                return Mark(m.start(), end + 3 if end >= 0 else len(page))
            if m["other"]:
                end = self._declaration_end(m.end())
                if end >= 0:
                    return Mark(m.start(), end)
            elif (end := self._tag_end(m.end())) >= 0:
                return Mark(m.start(), end, bool(m["closing"]), m["tag"].lower(), page[m.end():end - 1])
            at = m.end()
        return None

    _no_more = -1  # no > from here on

    def _declaration_end(self, at: int) -> int:
        if 0 <= self._no_more <= at:
            return -1
        end = self.page.find(">", at)
        if end < 0:
            self._no_more = at
        return end + 1 if end >= 0 else -1


def _raw_end(page: str, tag: str, at: int) -> int:
    """Behind the end tag of an element whose content is no markup."""
    end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
    return end.end() if end else len(page)


def _closed(page: str) -> dict[int, int]:
    """Where the skipped elements with markup inside end, by where they
    begin; those without an end tag of their own are left out."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    depth: Counter[str] = Counter()
    alone: dict[str, int] = {}  # the place in the stack of the open button and select
    scanner, at = Scanner(page), 0
    while mark := scanner.search(at):
        at, tag = mark.end, mark.tag
        if not tag:
            continue
        if mark.closing:
            if depth[tag]:
                while True:
                    was, start = stack.pop()
                    depth[was] -= 1
                    if was == tag:
                        break
                if tag in SKIPPED:
                    out[start] = at
        elif not mark.attributes.rstrip().endswith("/"):
            if tag in RAW_TEXT:
                at = _raw_end(page, tag, at)
            elif tag not in VOID:
                if tag in ("button", "select"):
                    if depth[tag]:  # one inside another: the first was never closed
                        depth[tag] -= 1
                        depth[""] += 1
                        stack[alone[tag]] = ("", -1)
                    alone[tag] = len(stack)
                stack.append((tag, mark.start))
                depth[tag] += 1
    return out


def blocks_of(page: str) -> list[Block]:
    """The page's flat text blocks, in order."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # tag, in the article, in furniture
    open_tags: Counter[str] = Counter()
    anchors = 0
    closed: dict[int, int] | None = None
    unclosed: int | None = None  # the place in the stack of the first skipped element on it

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            words = len(text.split(" "))
            in_links = len(html.unescape(" ".join(linked)).split())
            _, article, furniture = stack[-1] if stack else ("", False, NO)
            out.append(Block(text, words, min(1.0, in_links / words), article, furniture > NO))
        parts.clear()
        linked.clear()

    def push(tag: str, article: bool, furniture: int) -> None:
        stack.append((tag, article, furniture))
        open_tags[tag] += 1

    def pop() -> str:
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        return tag

    scanner, at = Scanner(page), 0
    while at < len(page):
        mark = scanner.search(at)
        piece = page[at:mark.start if mark else len(page)]
        if piece:
            parts.append(piece)
            if anchors:
                linked.append(piece)
        if not mark:
            break
        at = mark.end
        if not mark.tag:
            continue
        closing, tag, attributes = mark.closing, mark.tag, mark.attributes
        if tag in SKIPPED and not closing:
            if tag not in INLINE:
                flush()
            if not attributes.rstrip().endswith("/"):
                if tag == "head":
                    end = re.compile(r"</head\b[^>]*>", re.I).search(page, at)
                    at = end.end() if end else at
                elif tag in RAW_TEXT:
                    at = _raw_end(page, tag, at)
                else:
                    closed = _closed(page) if closed is None else closed
                    at = closed.get(mark.start, at)
                    if at == mark.end:  # never closed: furniture up to what ends it
                        unclosed = len(stack) if unclosed is None else unclosed
                        push(tag, bool(stack and stack[-1][1]), SURE)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            anchors = max(0, anchors + (-1 if closing else 1))
        if tag in INLINE:  # part of its block, whatever its class
            continue
        flush()
        anchors = 0
        if unclosed is not None and not closing and tag in _BEGINS:
            while len(stack) > unclosed:
                pop()
            unclosed = None
        if tag in VOID or (not closing and attributes.rstrip().endswith("/")):
            continue
        if not closing:
            if tag in _UNCLOSED and stack and stack[-1][0] == tag:
                pop()
            _, article, furniture = stack[-1] if stack else ("", False, NO)
            if tag in ("article", "main") and furniture == NAMED and not article:
                furniture = NO  # what is around an article is no furniture
            push(tag, article or tag in ("article", "main"), max(furniture, _furniture(tag, attributes, article)))
        elif open_tags[tag]:
            while pop() != tag:
                pass
        if unclosed is not None and len(stack) <= unclosed:
            unclosed = None
    flush()
    return out


FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "article", "furniture")


def features_of(blocks: list[Block]) -> list[tuple[float, ...]]:
    """A row of FEATURES for each block; outside the page there are no words
    and only links."""
    edge = Block("", 0, 1.0, False, False)
    around = [edge, *blocks, edge]
    return [(b.words, b.link_density, a.words, a.link_density, c.words, c.link_density, float(b.article), float(b.furniture))
            for a, b, c in zip(around, blocks, around[2:])]


# The labelled table: FEATURES, then 1 for main text.
LABELLED = (
    # headings and paragraphs of an article, short and long, with and without links
    (8, 0.0, 12, 0.0, 60, 0.0, 1, 0, 1), (60, 0.0, 8, 0.0, 45, 0.0, 1, 0, 1), (1, 0.0, 9, 0.0, 3, 0.0, 1, 0, 1), (140, 0.02, 60, 0.0, 9, 0.0, 1, 0, 1),
    (3, 0.0, 80, 0.0, 70, 0.05, 1, 0, 1), (25, 0.4, 30, 0.1, 40, 0.0, 1, 0, 1), (6, 1.0, 45, 0.0, 50, 0.0, 1, 0, 1), (4, 0.0, 1, 1.0, 6, 0.0, 1, 0, 1),
    (35, 0.0, 4, 0.0, 10, 0.4, 1, 0, 1), (2, 0.0, 2, 0.0, 2, 0.0, 1, 0, 1), (300, 0.01, 0, 1.0, 0, 1.0, 1, 0, 1), (12, 0.0, 6, 1.0, 20, 0.3, 1, 0, 1),
    (5, 0.0, 40, 0.0, 1, 1.0, 1, 0, 1), (10, 0.0, 1, 1.0, 0, 1.0, 1, 0, 1), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 1), (9, 0.9, 5, 1.0, 60, 0.0, 1, 0, 1),
    (3, 1.0, 30, 0.0, 3, 1.0, 1, 0, 1), (15, 0.8, 60, 0.0, 10, 0.9, 1, 0, 1), (3, 0.0, 2, 1.0, 4, 1.0, 1, 0, 1), (5, 0.0, 4, 0.0, 3, 0.0, 1, 0, 1),
    (8, 0.0, 3, 0.0, 2, 1.0, 1, 0, 1), (25, 0.7, 3, 1.0, 20, 0.8, 1, 0, 1), (6, 0.5, 4, 0.5, 5, 0.6, 1, 0, 1), (40, 0.6, 70, 0.0, 6, 1.0, 1, 0, 1),
    # furniture, inside an article too
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), (2, 1.0, 1, 1.0, 8, 0.0, 0, 1, 0), (20, 0.0, 1, 1.0, 8, 0.0, 0, 1, 0), (60, 0.0, 30, 0.0, 0, 1.0, 0, 1, 0),
    (12, 0.1, 80, 0.0, 0, 1.0, 0, 1, 0), (45, 0.0, 9, 0.0, 60, 0.0, 1, 1, 0), (3, 0.0, 50, 0.0, 40, 0.0, 1, 1, 0), (5, 1.0, 70, 0.0, 4, 1.0, 1, 1, 0),
    (150, 0.0, 70, 0.0, 90, 0.0, 1, 1, 0), (9, 0.0, 150, 0.0, 12, 0.0, 0, 1, 0), (30, 0.5, 12, 0.1, 0, 1.0, 0, 1, 0), (100, 0.0, 0, 1.0, 0, 1.0, 0, 1, 0),
    # pages without an article element: running text among links and crumbs
    (70, 0.0, 9, 0.0, 60, 0.0, 0, 0, 1), (45, 0.05, 70, 0.0, 80, 0.1, 0, 0, 1), (120, 0.1, 3, 1.0, 40, 0.0, 0, 0, 1), (25, 0.0, 60, 0.0, 55, 0.0, 0, 0, 1),
    (14, 0.0, 70, 0.0, 45, 0.0, 0, 0, 1), (6, 0.0, 50, 0.0, 65, 0.0, 0, 0, 1), (30, 0.2, 40, 0.0, 4, 1.0, 0, 0, 1), (18, 0.0, 5, 0.0, 90, 0.0, 0, 0, 1),
    (7, 0.0, 3, 1.0, 75, 0.0, 0, 0, 1), (200, 0.0, 0, 1.0, 0, 1.0, 0, 0, 1),
    (1, 1.0, 2, 1.0, 1, 1.0, 0, 0, 0), (4, 1.0, 30, 0.0, 3, 1.0, 0, 0, 0), (9, 0.9, 5, 1.0, 60, 0.0, 0, 0, 0), (15, 0.8, 60, 0.0, 10, 0.9, 0, 0, 0),
    (3, 0.0, 2, 1.0, 4, 1.0, 0, 0, 0), (5, 0.0, 4, 0.0, 3, 0.0, 0, 0, 0), (8, 0.0, 3, 0.0, 2, 1.0, 0, 0, 0), (2, 0.0, 0, 1.0, 1, 1.0, 0, 0, 0),
    (25, 0.7, 3, 1.0, 20, 0.8, 0, 0, 0), (6, 0.5, 4, 0.5, 5, 0.6, 0, 0, 0), (40, 0.6, 70, 0.0, 6, 1.0, 0, 0, 0), (9, 0.0, 5, 1.0, 6, 1.0, 0, 0, 0),
)

Tree = tuple  # (label,) or (feature, threshold, tree at or under it, tree above it)


def grow(rows: tuple[tuple[float, ...], ...], depth: int = 6) -> Tree:
    """A decision tree by Gini impurity over rows that end with their label;
    ties go to the feature named last, where the marks of position stand."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return (int(2 * ones >= len(rows)),)

    def impurity(part: list) -> float:
        share = sum(r[-1] for r in part) / len(part)
        return len(part) * share * (1 - share)

    best = None
    for k in reversed(range(len(rows[0]) - 1)):
        values = sorted({r[k] for r in rows})
        for low, high in zip(values, values[1:]):
            cut = (low + high) / 2
            cost = impurity([r for r in rows if r[k] <= cut]) + impurity([r for r in rows if r[k] > cut])
            if best is None or cost < best[0] - 1e-12:
                best = (cost, k, cut)
    if best is None:
        return (int(2 * ones >= len(rows)),)
    _, k, cut = best
    return (k, cut, grow(tuple(r for r in rows if r[k] <= cut), depth - 1), grow(tuple(r for r in rows if r[k] > cut), depth - 1))


def decide(tree: Tree, row: tuple[float, ...]) -> int:
    while len(tree) > 1:
        k, cut, low, high = tree
        tree = low if row[k] <= cut else high
    return tree[0]


def main_text(page: str, tree: Tree) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, row in zip(blocks, features_of(blocks)) if decide(tree, row))


def extract(pages: DataFrame, labelled: tuple = LABELLED) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    tree = grow(labelled)

    def run(batch: pa.RecordBatch):
        for block in text_blocks(batch, name="html"):
            texts = [main_text(t, tree) for t in texts_of(block, "html")]
            yield pa.RecordBatch.from_arrays([column(block, "page_id").cast(pa.int64()), column(block, "url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select("page_id", "url", "html"), run, "page_id bigint, url string, text string, n_chars bigint")
