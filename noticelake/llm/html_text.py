"""The main text of web pages from parser events, text-to-tag ratios and their smoothing.

The standard library's parser streams a page's events. Block-level tags part its text into lines;
each has a ratio of characters outside of links to tags, so that lists of links have next to none. Lines in
elements that are no article text by their tag, role or mark are vetoed. The ratios of the rest are smoothed with a
Gaussian, and lines at or over the smoothed ratios' standard deviation form the content cluster.

The cluster decides the regions. From the first clustered line to the last everything is text, and so is what
stands in an article or main part, or in a container of its own, with a clustered line, and a heading
before the first one. Of all that only lists of links fall: lines outside of the cluster, one after
the other, most of whose words are links, three or more together. Tables, short sections and notes of the article stay.

All of it is linear in the page: every element carries its veto and its sums, none looks up its
ancestors.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import in_slices, prepare

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that part a page into regions; the others, tables too, hold text. Parts of an article are one region with the rest of it.
_CONTAINERS = frozenset("html body main article section div center".split())
_ARTICLE = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never article text, wherever they stand.
_VETOED = frozenset(
    "head title script style noscript template nav footer aside form button select option textarea input label fieldset iframe object embed "
    "svg math canvas audio video map menu dialog search".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id names by which a page says of an element that it is something else.
_MARKS = frozenset("ad ads advert advertisement advertisements advertising sponsored promo cookie cookies consent notice banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead newsletter share sharing".split())
#: Those by which it says that readers wrote it; they may write more than the article has.
_READERS = frozenset("comment comments discussion discussions disqus reply replies respond responses".split())
#: Links in a row that make a list of links.
_LINKS = 3
#: A start tag of these ends an open paragraph.
_ENDS_P = _BLOCK - {"body", "html", "caption", "dd", "dt", "legend", "li", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
_P_HOLDERS = frozenset("article main section div td th li button blockquote body".split())
_SAME = {"a": ("a",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = {"a": _CONTAINERS, "li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Open elements looked at for one that a start tag ends by itself.
_REACH = 64


def _words(parts: list[str]) -> int:
    """How many hold a letter or digit."""
    return sum(any(map(str.isalnum, p)) for p in parts)


class _Events(HTMLParser):
    """Collects elements (parent, tag, vetoes, whether a reader's) and lines (element, text, tags, links, words in links, characters in links)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.hard, self.soft, self.reader = [-1], [""], [False], [False], [False]
        self.open = [0]
        self.count: dict[str, int] = {}
        self.cut = 0  # open elements whose text is cut out of its line
        self.lines: list[tuple[int, str, int, int, int, int]] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.tags = self.links = 0

    def _line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            words = "".join(self.linked).split()
            self.lines.append((self.open[-1], text, max(1, self.tags), self.links, _words(words), sum(map(len, words)) + max(0, len(words) - 1)))
        self.parts, self.linked, self.tags, self.links = [], [], 0, 0

    def _leave(self, at: int) -> None:
        """Ends all open elements from the place ``at`` on."""
        for e in self.open[at:]:
            self.count[self.tag[e]] -= 1
            self.cut -= self._cuts(e)
        del self.open[at:]

    def _cuts(self, e: int) -> bool:
        return self.hard[e] and self.tag[e] not in _BLOCK

    def _close(self, tags: tuple[str, ...], within: set[str] | frozenset[str]) -> None:
        """Ends the nearest open element of ``tags`` unless one of ``within`` is nearer."""
        if any(self.count.get(t) for t in tags):
            for at in range(len(self.open) - 1, max(0, len(self.open) - _REACH), -1):
                tag = self.tag[self.open[at]]
                if tag in tags:
                    return self._leave(at)
                if tag in within:
                    return None
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK:
            self._line()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        if tag in _ENDS_P:
            self._close(("p",), _P_HOLDERS)
        if tag in _SAME:
            self._close(_SAME[tag], _HOLDS[tag])
        values = {k: v or "" for k, v in attrs}
        names = set(re.split(r"[^a-z0-9]+", f"{values.get('class', '')} {values.get('id', '')}".lower())) if "class" in values or "id" in values else set()
        hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I)
        masthead = tag == "header" and not (self.count.get("article") or self.count.get("main"))
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.hard.append(bool(tag in _VETOED or hidden))
        self.soft.append(bool(masthead or values.get("role", "").lower() in _ROLES or names & _MARKS))
        self.reader.append(bool(names & _READERS))
        self.links += tag == "a"
        self.open.append(len(self.tag) - 1)
        self.count[tag] = self.count.get(tag, 0) + 1
        self.cut += self._cuts(len(self.tag) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self._line()
        self.tags += 1
        if tag == "a" and self.linked:
            self.linked.append(" ")  # links that touch are two words
        if self.count.get(tag):
            at = len(self.open) - 1
            while self.tag[self.open[at]] != tag:
                at -= 1
            self._leave(at)

    def handle_data(self, data: str) -> None:
        if not self.cut:
            self.parts.append(data)
            if self.count.get("a"):
                self.linked.append(data)

    def unknown_decl(self, data: str) -> None:
        pass


def _parsed(html: str) -> _Events:
    for source in (html, re.sub(r"<!\[[^>]*>", " ", html)):
        events = _Events()
        try:
            events.feed(source)
            events.close()
        except AssertionError:  # an unknown marked section; the second source has none
            continue
        break
    events._line()
    return events


def smoothed(ratios: list[float], sigma: float = 0.6, radius: int = 2) -> list[float]:
    """The ratios under a normalised Gaussian kernel; beyond the ends the kernel is cut off."""
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    out = []
    for at in range(len(ratios)):
        lo, hi = max(0, at - radius), min(len(ratios), at + radius + 1)
        weights = kernel[lo - at + radius : hi - at + radius]
        out.append(sum(w * r for w, r in zip(weights, ratios[lo:hi], strict=True)) / sum(weights))
    return out


def _vetoes(e: _Events) -> list[bool]:
    """By element, whether it stands in a vetoed one.

    A mark does not count on what holds the page's main part, its first heading, or without both its first article. On a
    page without any of them a mark that is not of readers does not count on what holds most of the text.
    """
    n = len(e.tag)
    named = {"main", "h1"} & set(e.tag)
    first = e.tag.index("article") if not named and "article" in e.tag else -1
    told = bool(named) or first > 0
    holds = [t in ("body", "main", "h1") or at == first for at, t in enumerate(e.tag)]
    prose, hard = [0] * n, [False] * n
    for at in range(1, n):
        hard[at] = hard[e.parent[at]] or e.hard[at]
    for element, text, *_, linked in e.lines:
        prose[element] += 0 if hard[element] else len(text) - linked
    for at in range(n - 1, 0, -1):
        prose[e.parent[at]] += prose[at]
        holds[e.parent[at]] |= holds[at] and not e.hard[at]
    out = [False] * n
    for at in range(1, n):
        marked = (e.soft[at] and (e.tag[at] == "header" or not holds[at] and (told or 2 * prose[at] <= prose[0]))) or (e.reader[at] and not holds[at])
        out[at] = out[e.parent[at]] or e.hard[at] or marked
    return out


def _within(e: _Events, tags: frozenset[str], inner: bool) -> list[int]:
    """By element, its nearest (``inner``) or outermost element of ``tags``, itself included; 0 for none."""
    out = [0] * len(e.tag)
    for at in range(1, len(e.tag)):
        up = out[e.parent[at]]
        out[at] = at if e.tag[at] in tags and (inner or not up) else up
    return out


def extract(html: str | None, smooth: Callable[[list[float]], list[float]] = smoothed) -> str:
    """The page's main text: blocks joined by an empty line; empty if there is none."""
    if not html:
        return ""
    e = _parsed(html)
    vetoed = _vetoes(e)
    lines = [x for x in e.lines if not vetoed[x[0]]]
    if not lines:
        return ""
    ratio = smooth([max(0, len(text) - linked) / tags for _, text, tags, _, _, linked in lines])
    mean = sum(ratio) / len(ratio)
    limit = math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio))
    content = [r >= limit for r in ratio]
    if not any(content):
        return ""
    # regions: what lies between clustered lines, and what shares an article or a container with one
    article, box = _within(e, _ARTICLE, False), _within(e, _CONTAINERS, True)
    full = {article[x[0]] for x, c in zip(lines, content, strict=True) if c} - {0}
    boxes = {box[x[0]] for x, c in zip(lines, content, strict=True) if c}
    start, end = content.index(True), len(content) - content[::-1].index(True)
    while start and e.tag[lines[start - 1][0]] in _HEADINGS:
        start -= 1
    titles = [i for i in range(start) if e.tag[lines[i][0]] == "h1"]
    start = titles[-1] if titles else start
    keep = [start <= i < end or article[x[0]] in full or box[x[0]] in boxes for i, x in enumerate(lines)]
    # lists of links fall
    at = 0
    while at < len(lines):
        stop, links = at, 0
        while stop < len(lines) and not content[stop] and 2 * lines[stop][4] > _words(lines[stop][1].split()):
            links += lines[stop][3]
            stop += 1
        if links >= _LINKS:
            keep[at:stop] = [False] * (stop - at)
        at = max(stop, at + 1)
    return "\n\n".join(x[1] for x, k in zip(lines, keep, strict=True) if k)


def main_text():
    """A function from a column of pages to their main text. Null counts as empty."""

    @F.arrow_udf("string")
    def text(pages: pa.Array) -> pa.Array:
        return in_slices(pages, lambda part: pa.array([extract(p) for p in part.to_pylist()], pa.string()))

    return text


def with_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Adds the main text of every page. Repeated rows and all other columns stay; one named ``out`` is replaced.

    Null, empty and blank pages, and pages without an unvetoed line, have an empty text.
    """
    prepare(pages.sparkSession)
    column: Column = main_text()(F.col(f"`{html}`").cast("string"))
    return pages.withColumn(out, column)
