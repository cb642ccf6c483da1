"""Main text of web pages by consensus host paths.

Each page's containers are scored by the prose that stands in them. The best one's path of tags and
classes, with digits generalised, is the page's vote; votes are counted by host in Spark, and each
host's winner is the path from which its pages are then extracted. A page without that path, or with next to nothing
in it, falls back on its own best container.

Within a container, menus, page headers and footers, side bars, notices, adverts, forms, scripts,
styles and reader comments go, told by tags, roles and words of class and id. What is left is joined block by block.

Nulls: a null or empty html has no text and no vote; a null url is a host of its own. A page is parsed
whole, in time linear in its length, however long and however broken its markup. Where scores tie, the
container that comes first on the page is the best; where votes tie, the larger total score and then the smaller path win.
Rows that repeat vote each and give a row each; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import lean, scratch, slices, small, temporary_tables

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; none of it is text of the page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements that start and end a block.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that may hold an article.
CONTAINER = frozenset("article blockquote body center div main section table tbody td".split())
#: Elements that hold no part of an article.
DROPPED = frozenset("aside button canvas dialog datalist footer form head menu nav noscript object search select svg template math audio video".split())
#: An open element of the value ends where one of the key begins, unless one of the stops stands between.
_CELLS, _ROWS = ("td", "th"), ("tr",)
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "td": (_CELLS, ("tr", "table")),
    "th": (_CELLS, ("tr", "table")),
    "tr": (_ROWS, ("table",)),
    "tbody": (("thead", "tbody"), ("table",)),
    "tfoot": (("thead", "tbody"), ("table",)),
}
#: Words of class and id that mark what is no part of an article, and words that mark one.
BOILERPLATE = frozenset(
    "ad ads adsense advert advertisement advertising adslot adbox alert aside banner bottombar breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright cta"
    " dialog disclaimer discussion disqus dropdown footer gdpr hidden legal login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination"
    " paywall popup privacy promo promotion rail recommend recommendations recommended related replies reply respond responses search share sharing sidebar sidenav signup skip skyscraper"
    " social sponsor sponsored subscribe subscription taboola teaser toolbar topbar tracking trending warning widget widgets".split()
)
HEADERS = frozenset(("header", "heading", "head"))
CONTENT = frozenset("article articlebody body content entry main post story text".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search toolbar".split())

#: Share of the page's own best score that the host's path must reach.
ENOUGH = 0.25
#: How much longer than the best container one may be that adds the main heading to it.
HEADING_SHARE = 0.2
#: Paths of so many characters take no further steps.
LONGEST_PATH = 1_000
#: Copies of each host's winner when hosts are joined by shuffle, so that one host's pages are dealt over as many tasks.
SALTS = 64

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|["'].*+|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*+)\s*+(?:=\s*+("[^"]*+"?|'[^']*+'?|[^\s"'>]++))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSING = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}


@dataclass
class Page:
    """The elements of a page, each after its parent, and its blocks of text in order."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    path: list[str] = field(default_factory=list)
    #: 1: told by tag, 2: by role, class or id, 3: a header by its class, which is one outside articles only.
    dropped: list[int] = field(default_factory=list)
    bonus: list[float] = field(default_factory=list)
    #: (element, text, characters in links)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def add(self, tag: str, parent: int, path: str, dropped: int, bonus: float) -> int:
        for to, value in ((self.tag, tag), (self.parent, parent), (self.path, path), (self.dropped, dropped), (self.bonus, bonus)):
            to.append(value)
        return len(self.tag) - 1


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'")) if value else "")
    return out


def _verdict(tag: str, a: dict[str, str], words: list[str]) -> int:
    if tag in DROPPED:
        return 1
    if tag in ("html", "body", "main"):
        return 0
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
        return 2
    if a.get("role", "").lower() in ROLES or any(w in BOILERPLATE for w in words):
        return 2
    return 3 * (any(w in HEADERS for w in words) and not any(w in CONTENT for w in words) and tag in CONTAINER)


class _Open:
    """The open elements: (number, tag), where each tag stands last, and where the last block does; all moves take constant time."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, str]] = [(0, "#root")]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        #: Elements that were open when the page was declared to end.
        self.unclosed: list[tuple[int, str]] = []

    def last(self, tag: str) -> int:
        at = self.places.get(tag)
        return at[-1] if at else 0

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((node, tag))

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop()[1]
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def close_last(self, tag: str) -> None:
        """What an end tag does: a block's closes all inside it, another's does nothing beyond the block around it."""
        depth = self.last(tag)
        if depth and (tag in BLOCK or not self.blocks or self.blocks[-1] < depth):
            if tag in ("body", "html"):
                self.unclosed += self.stack[depth + 1 :]
            self.close(depth)

    def make_way(self, tag: str) -> None:
        """What a start tag closes: an open paragraph, and elements of which there is one at a time."""
        if tag in BLOCK and self.blocks and self.stack[self.blocks[-1]][1] == "p":
            self.close(self.blocks[-1])
        if tag in ENDS:
            ended, stops = ENDS[tag]
            depth = max(map(self.last, ended))
            if depth > max(map(self.last, stops)):
                self.close(min(d for t in ended if (d := self.last(t)) > max(map(self.last, stops))))


def parse(text: str) -> Page:
    """The page, by the usual rules for elements that are not closed; unclosed, dropped ones reach to the end only where the page breaks off."""
    page, open_, buf, linked = Page(), _Open(), [], 0
    page.add("#root", -1, "", 0, 1.0)

    def flush() -> None:
        nonlocal linked
        words = " ".join("".join(buf).split()) if buf else ""
        if words:
            page.blocks.append((open_.stack[-1][0], words, linked))
        buf.clear()
        linked = 0

    def said(piece: str) -> None:
        nonlocal linked
        piece = html.unescape(piece) if "&" in piece else piece
        buf.append(piece)
        if open_.last("a"):
            linked += len(piece.strip())

    at, size = 0, len(text)
    while at < size:
        m = _MARKUP.search(text, at)
        if m is None:
            said(text[at:])
            break
        if m.start() > at:
            said(text[at : m.start()])
        at, tag = m.end(), m[1] and m[1].lower()
        if tag is None:
            continue
        if tag in BLOCK:
            flush()
        if text[m.start() + 1] == "/":
            open_.close_last(tag)
        elif tag in RAW:
            end = _CLOSING[tag].search(text, at)
            at = end.end() if end else size
        elif tag == "br":
            buf.append(" ")
        else:
            open_.make_way(tag)
            if tag not in VOID:
                open_.push(_element(page, open_.stack[-1][0], tag, m[2]), tag)
    flush()
    _settle(page, text, [i for i, tag in open_.unclosed + open_.stack if page.tag[i] == tag])
    return page


def _element(page: Page, up: int, tag: str, raw: str) -> int:
    """The number of a new element; bare inline ones go by their parent's."""
    if not raw and tag not in BLOCK and tag not in DROPPED:
        return up
    a = attributes(raw) if raw else {}
    words = [w.lower() for w in _WORD.findall(f"{a.get('class', '')} {a.get('id', '')}")] if a else []
    main = tag in ("article", "main") or a.get("role") == "main" or a.get("itemprop") == "articleBody"
    path = page.path[up]
    if tag in CONTAINER and len(path) < LONGEST_PATH:
        path = f"{path}/{'.'.join([tag, *sorted({re.sub(r'[0-9]+', '9', c) for c in a.get('class', '').split()})])}"
    return page.add(tag, up, path, _verdict(tag, a, words), 1.5 if main else 1.2 if any(w in CONTENT for w in words) else 1.0)


def _settle(page: Page, text: str, still_open: list[int]) -> None:
    """Unmark elements that hold an article by other signs, or were never closed on a page that is; pass marks down."""
    end = text[-200:].lower()
    if "</body" in end or "</html" in end:
        for i in still_open:
            page.dropped[i] = 0
    inside = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        inside[i] = (around := inside[page.parent[i]]) or page.tag[i] in ("article", "main")
        if page.dropped[i] == 3:
            page.dropped[i] = 0 if around else 2
        elif page.tag[i] == "header" and not around:
            page.dropped[i] = 1
    holds = [False] * len(page.tag)
    for i in range(len(page.tag) - 1, 0, -1):
        if holds[i] and page.dropped[i] == 2:
            page.dropped[i] = 0
        if holds[i] or page.tag[i] in ("article", "main") and not page.dropped[i]:
            holds[page.parent[i]] = True
    for i in range(1, len(page.tag)):
        page.dropped[i] = page.dropped[page.parent[i]] or page.dropped[i]


def scores(page: Page) -> dict[int, float]:
    """Score of each container that holds prose: its own blocks' characters outside links, and half of its parts', by what it is."""
    own = [0.0] * len(page.tag)
    for node, text, linked in page.blocks:
        if not page.dropped[node] and 2 * linked <= len(text):
            while node > 0 and page.tag[node] not in CONTAINER:
                node = page.parent[node]
            own[node] += len(text) - linked
    out: dict[int, float] = {}
    for i in range(len(page.tag) - 1, 0, -1):
        if own[i] and page.tag[i] in CONTAINER:
            out[i] = own[i] * page.bonus[i]
        own[page.parent[i]] += own[i] / (2 if page.tag[i] in CONTAINER else 1)
    if own[0] and not out:  # prose without any element around it
        out[0] = own[0]
    return out


def best(page: Page, found: dict[int, float]) -> int:
    """The container with the highest score, or the article or main element around it; the whole page where there is none.

    Without such an element, containers around it are taken as long as they add the main heading and little else.
    """
    if not found:
        return 0
    top = min(found, key=lambda i: (-found[i], i))
    around, up = 0, top
    while up > 0:
        if page.tag[up] in ("article", "main"):
            around = up
            if page.tag[up] == "article":
                break
        up = page.parent[up]
    if around or not top:
        return around
    said, heads = [0] * len(page.tag), [False] * len(page.tag)
    for node, text, _ in page.blocks:
        if not page.dropped[node]:
            said[node] += len(text)
            heads[node] |= page.tag[node] == "h1"
    for i in range(len(page.tag) - 1, 0, -1):
        said[page.parent[i]] += said[i]
        heads[page.parent[i]] |= heads[i]
    up = top
    while up > 0 and not heads[top]:
        up = page.parent[up]
        if said[up] > (1 + HEADING_SHARE) * said[top]:
            break
        if heads[up] and page.tag[up] in CONTAINER:
            top = up
    return top


def content(page: Page, chosen: set[int]) -> str:
    """The blocks inside the chosen elements, one a line."""
    under = [False] * len(page.tag)
    for i in range(len(page.tag)):
        under[i] = i in chosen or (i > 0 and under[page.parent[i]])
    return "\n".join(text for node, text, _ in page.blocks if under[node] and not page.dropped[node])


def vote(text: str) -> tuple[str, float] | None:
    """The generalised path of the page's best container and its score."""
    page = parse(text)
    found = scores(page)
    node = best(page, found)
    return (page.path[node], found.get(node, 0.0)) if node else None


def extract(text: str, path: str | None) -> tuple[str, bool]:
    """Text of the page, and whether it came from ``path``."""
    page = parse(text)
    found = scores(page)
    own = best(page, found)
    same = {i for i, p in enumerate(page.path) if p == path and page.tag[i] in CONTAINER} if path else set()
    if same and sum(found.get(i, 0.0) for i in same) >= ENOUGH * found.get(own, 0.0):
        return content(page, same), True
    return content(page, {own}) if found else "", False


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: of every host the path with most votes. ``pages`` has host and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [(h, *v) for h, text in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True) if text and (v := vote(text))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([round(f[2]) for f in found], pa.int64())], names=["host", "path", "score"])

    votes = pages.select("host", "html").mapInArrow(lean(run), "host string, path string, score bigint")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    return counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), -F.col("score"), "path")).alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and by_host (the text came from the host's path) of every row of ``pages`` (page_id, url, html)."""
    given = pages.select("page_id", "url", host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    keep: list[DataFrame] = []
    with temporary_tables(keep):
        winners = scratch(host_paths(given), "host-paths")
        keep.append(winners)
    few = small(winners, 400)
    if few is not winners:
        placed = given.join(few, "host", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.lit(SALTS)).cast("int")
        spread = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = given.withColumn("salt", salt).join(spread, ["host", "salt"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in given.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            done = [extract(text or "", path) for text, path in zip(b.column("html").to_pylist(), b.column("path").to_pylist(), strict=True)]
            texts = [t for t, _ in done]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([by for _, by in done], pa.bool_())], names=["page_id", "url", "text", "n_chars", "by_host"])

    return placed.select("page_id", "url", "html", "path").mapInArrow(lean(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint, by_host boolean")
