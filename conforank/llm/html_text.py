"""Main text of web pages from parser events and text-to-tag ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters given to the parser at a time.
CHUNK = 1 << 20
#: Standard deviation of the smoothing in lines, and how far it reaches.
SIGMA, REACH = 1.5, 4
#: Clusters of log ratios whose centres are closer are one.
LEAST_GAP = float(np.log(2.0))

# Element names of HTML and words that sites use in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "tfoot thead tr ul".split()
)
SPACED = frozenset("br td th img wbr".split()) - {"wbr"}
NEVER = frozenset(
    "head script style noscript template iframe object svg math canvas audio video select button textarea datalist map".split()
)
NAMED = frozenset("nav footer aside form menu dialog".split())
REGIONS = frozenset("article main".split())
GROUPS = frozenset("section div td blockquote body center header nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form note".split())
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments commentlist "
    "disqus replies cookie cookies consent gdpr sidebar nav navbar navigation menu menubar footer breadcrumb breadcrumbs "
    "newsletter subscribe subscription signup login popup modal overlay masthead toolbar pagination pager".split()
)
WEAK = frozenset(
    "respond notice notification alert share sharing social related recommended skip widget".split()
)
MILD = frozenset("header banner top bottom".split())
GOOD = frozenset("article content post entry main story body text".split())
CLOSED_BY_BLOCK = BLOCK - {"html", "body"}
SIBLINGS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}}


PLAIN, HINTED, BOILERPLATE, UNREAD = range(4)


def state_of(tag: str, attrs: list[tuple[str, str | None]], in_region: bool) -> int:
    """What the names of an element say of its text.

    UNREAD: never text. BOILERPLATE: menu, header, footer, sidebar, notice, advert, form, comments,
    or hidden. HINTED: a name that articles use too, inside an article; ratios decide. Else PLAIN.
    """
    if tag in NEVER:
        return UNREAD
    if tag in NAMED or (tag == "header" and not in_region):
        return BOILERPLATE
    if tag == "header" or (tag in REGIONS | {"html", "body"} and not in_region):
        return PLAIN
    state = PLAIN
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return BOILERPLATE
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return BOILERPLATE
        if name == "role" and value in ROLES:
            return BOILERPLATE
        if name in ("class", "id"):
            words = set(re.split(r"[^a-z0-9]+", value))
            if words & STRONG:
                return BOILERPLATE
            if words & WEAK or (words & MILD and not words & GOOD and tag in ("div", "section", "p")):
                state = HINTED if in_region else BOILERPLATE
    return state


class Line(NamedTuple):
    """A block of a page: text, tags met with it, characters inside links, its region and whether names rule it out."""

    text: str
    tags: int
    linked: int
    region: int
    named: bool


class Lines(HTMLParser):
    """Collects the lines of a whole page; only what is never text is left out here.

    ``parents`` and ``sure`` are by region: the region around it, and whether it is an article.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, int]] = []  # name, state, region
        self.parts: list[str] = []
        self.parents, self.sure = [-1], [False]
        self.tags, self.linked, self.links, self.articles = 1, 0, 0, 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, state, region = self.open[-1] if self.open else ("", PLAIN, 0)
            self.lines.append(Line(text, self.tags, min(self.linked, len(text)), region, state == BOILERPLATE))
        self.parts, self.tags, self.linked = [], 1, 0

    def leave(self, at: int, flush: bool = True) -> None:
        if flush:
            self.flush()
        for name, _, _ in self.open[at:]:
            self.links -= name == "a"
            self.articles -= name in REGIONS
        del self.open[at:]

    def last(self, names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> int:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                return i
            if self.open[i][0] in stop:
                break
        return -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag in BLOCK:
                self.flush()
            elif tag in SPACED:
                self.parts.append(" ")
            return
        if tag == "body" and (i := self.last({"head"}, frozenset())) >= 0:
            self.leave(i)
        if tag in CLOSED_BY_BLOCK and (i := self.last({"p"}, GROUPS | REGIONS | NEVER | {"li", "table"})) >= 0:
            self.leave(i)
        if tag in SIBLINGS and (i := self.last({tag}, SIBLINGS[tag])) >= 0:
            self.leave(i)
        if tag in BLOCK:
            self.flush()
        elif tag in SPACED:
            self.parts.append(" ")
        _, outer, region = self.open[-1] if self.open else ("", PLAIN, 0)
        inside = self.articles > 0
        state = max(outer, state_of(tag, attrs, inside))
        if state != outer and state != UNREAD:
            self.flush()
        opens = not inside and tag in REGIONS | GROUPS
        if state != UNREAD and (opens or (state != outer and state == HINTED)):
            self.parents.append(region)
            self.sure.append(state == PLAIN and tag in REGIONS)
            region = len(self.parents) - 1
        self.links += tag == "a"
        self.articles += tag in REGIONS
        self.open.append((tag, state, region))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                state = self.open[i][1]
                outer = self.open[i - 1][1] if i else PLAIN
                self.leave(i, tag in BLOCK or (state != outer and state != UNREAD))
                break
        else:
            if tag in BLOCK:
                self.flush()

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1] == UNREAD):
            self.parts.append(data)
            if self.links:
                self.linked += len(" ".join(data.split()))


def smoothed_ratios(lines: list[Line]) -> np.ndarray:
    """Logarithms of text outside links per tag, smoothed over the lines of the page."""
    ratio = np.log1p([(len(x.text) - x.linked) / x.tags for x in lines])
    window = np.exp(-(np.arange(-REACH, REACH + 1) ** 2) / (2 * SIGMA**2))
    middle = slice(REACH, REACH + len(ratio))
    return np.convolve(ratio, window)[middle] / np.convolve(np.ones(len(ratio)), window)[middle]


def threshold(values: np.ndarray) -> float:
    """Least value of the upper of two clusters, by the split with the least sum of squares.

    If the two centres are closer than LEAST_GAP there is one cluster, and all values belong to it.
    """
    order = np.sort(values)
    if len(order) < 2:
        return -np.inf
    low = np.arange(1, len(order))
    high = len(order) - low
    sums = np.cumsum(order)
    below, above = sums[:-1] / low, (sums[-1] - sums[:-1]) / high
    at = int(np.argmax(low * high * (above - below) ** 2))
    return order[at + 1] if above[at] - below[at] >= LEAST_GAP else -np.inf


def content_regions(lines: list[Line], parents: list[int], sure: list[bool]) -> set[int]:
    """Regions of a page that are content.

    These are articles, and regions with a line in the upper cluster and less than half of their
    characters in links. Regions with as few links that lie between two of them in the same
    surrounding region belong to the run and stay, however short they are.
    """
    if not lines:
        return set()
    values = smoothed_ratios(lines)
    cut = threshold(values)
    size, linked = np.zeros(len(parents)), np.zeros(len(parents))
    for x in lines:
        size[x.region] += len(x.text)
        linked[x.region] += x.linked
    plain = 2 * linked < size
    content = {x.region for x, value in zip(lines, values) if sure[x.region] or (value >= cut and plain[x.region])}
    spans: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        if x.region in content and not x.named:
            spans.setdefault(parents[x.region], [i, i])[1] = i
    for i, x in enumerate(lines):
        first, last = spans.get(parents[x.region], (i, i))
        if first < i < last and plain[x.region]:
            content.add(x.region)
    return content


def lines_of(html: str | None) -> Lines:
    """Parser events of a whole page, read in pieces of ``CHUNK`` characters."""
    parser = Lines()
    for start in range(0, len(html or ""), CHUNK):
        parser.feed(html[start : start + CHUNK])
    # A tag that the page breaks off in is markup, not text.
    parser.rawdata = re.sub(r"<[A-Za-z/!?][^>]*$", "", parser.rawdata)
    parser.close()
    parser.flush()
    return parser


def main_text(html: str | None) -> str:
    """The article of a page: its blocks joined by empty lines."""
    page = lines_of(html)
    keep = content_regions(page.lines, page.parents, page.sure)
    return "\n\n".join(x.text for x in page.lines if x.region in keep and not x.named)


def extracted(html: Column) -> Column:
    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(x.as_py()) for x in pages], pa.string())

    return extract(html)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by ``text``, the main text, and its length ``n_chars``.

    Each page by itself: parser events give the lines of the whole page. A line's text outside
    links over its tags is smoothed with a Gaussian, and the logarithms fall into two clusters. A
    region (article, or innermost group where there is none) with a line of the upper cluster is
    content and all its lines stay, short ones too; menus and lists of links go by this. What reads
    like text but is none of the article (footers, adverts, notices, forms, comments) goes by the
    names of its elements. White space in a block becomes one space; blocks are joined by an empty line.

    Null and empty html, and pages without text, give the empty text. Broken and cut-off markup
    is read as far as it goes. Whole pages are parsed, in pieces of ``CHUNK`` characters.
    """
    out = pages.withColumn("text", extracted(F.col("html"))).drop("html")
    return out.withColumn("n_chars", F.length("text").cast("long"))
