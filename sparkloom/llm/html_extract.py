"""Main text of HTML pages from a stream of parser events.

The standard library's parser turns a page into lines, one for each stretch of text between block tags. Each line has a
text-to-tag ratio: its characters outside links over the tags met since the line before. Lines of elements that pages mark as
menus, adverts, forms, comments and the like, by tag or by a word in class, id or role, count ``MARK_TAGS`` tags more: a mark
makes a line stand as if in denser markup, and no more than that. Lines belong to regions (an article or main element, or
else the block that holds the line; a marked element is a region of its own). The ratios' logarithms are smoothed by a
Gaussian kernel over neighbouring lines, where each border of a region counts as ``BORDER`` lines. A region's value is the
mean over its characters outside links; two-means clustering of the regions' values finds the threshold, and regions above it
are content, whether they are marked or not. All lines of content regions make the text, in page order, but for lines below
the threshold that are mostly links.

Defined results: a null or empty page, or one without text, gives the empty text; broken markup never fails; tags that
are not closed end with their parents, and an inline end tag does not reach out of its block; pages whose regions are all
alike are content as a whole if they have more than ``LEAST_RATIO`` characters a tag; repeated rows are extracted each by
itself, and an empty table gives an empty result; other columns are carried along, and
columns named as an output are replaced. Work is linear in the length of a page, however its tags nest.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from sparkloom.llm.arrow import map_columns

SIGMA, RADIUS = 1.0, 2
BORDER = 2.0  # lines that a border of a region counts as
MARK_TAGS = 10  # tags that a mark counts as for a line
LEAST_RATIO = 1.0  # characters a tag that content has at least, whatever the other lines are like
MOST_LINKS = 0.5  # share of a line's characters inside links, from which on a line below the threshold is left out

_BLANK = re.compile(r"\s+")
_TOKEN = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BREAKS = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td
    tfoot th thead title tr ul""".split()
)
#: Elements whose text a reader does not see as text.
_UNSEEN = frozenset("audio button canvas head iframe map noscript object option script select style svg template textarea title video".split())
#: Elements that hold something beside the article.
_BESIDE = frozenset("aside dialog fieldset footer form label legend menu nav".split())
_REGION = frozenset(("article", "main"))
#: Blocks that belong to the block around them.
_INNER = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote ul ol dl dt dd hr br center address figure figcaption".split())
_ENDS_OWN_KIND = {"li": "li", "tr": "tr", "td": "td th", "th": "td th", "dt": "dt dd", "dd": "dt dd", "option": "option"}
#: Words in class, id or role that mark what is not the article.
_MARKS = frozenset(
    """ad ads advert advertisement adverts advertising adsense alert banner breadcrumb breadcrumbs byline comment comments complementary
    consent contentinfo cookie cookies copyright dialog disclaimer disqus footer form gdpr header hidden legal login masthead
    menu modal nav navbar navigation newsletter notice notices notification pager pagination popup privacy promo promoted
    promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored
    subscribe subscription toolbar topbar widget""".split()
)


class Line(NamedTuple):
    text: str
    tags: int
    link_chars: int
    region: int
    marked: bool


class _Open(NamedTuple):
    """An open element: its tag, what its text is (0 content, 1 marked, 2 unseen), its region, and if that is an article."""

    tag: str
    kind: int
    region: int
    article: bool


_PAGE = _Open("", 0, 0, False)


class PageLines(HTMLParser):
    """Feeds on a page and collects its lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[_Open] = []
        self.at: dict[str, list[int]] = {}  # where each tag is open
        self.blocks: list[int] = []  # where blocks are open
        self.parts: list[str] = []
        self.tags = self.link_chars = self.count = 0

    def _top(self) -> _Open:
        return self.open[-1] if self.open else _PAGE

    def _flush(self) -> None:
        if self.parts:
            text = _BLANK.sub(" ", "".join(self.parts)).strip()
            self.parts.clear()
            if text:
                top = self._top()
                self.lines.append(Line(text, self.tags, min(self.link_chars, len(text)), top.region, top.kind == 1))
                self.tags = 0
            self.link_chars = 0

    def _close(self, down_to: int) -> None:
        while len(self.open) > down_to:
            tag = self.open.pop().tag
            self.at[tag].pop()
            if self.blocks and self.blocks[-1] >= len(self.open):
                self.blocks.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        is_block = tag in _BREAKS
        if is_block:
            self._flush()
        if tag in _VOID:
            return
        block = self.blocks[-1] if self.blocks else -1
        if is_block and block >= 0 and self.open[block].tag == "p":  # a paragraph ends where another block begins
            self._close(block)
            block = self.blocks[-1] if self.blocks else -1
        if block >= 0 and self.open[block].tag in _ENDS_OWN_KIND.get(tag, "").split():
            self._close(block)
        elif tag == "a" and self.at.get("a") and self.at["a"][-1] > block:  # links do not nest
            self._close(self.at["a"][-1])
        if tag in _REGION or tag == "body":  # an element left open before it does not reach into it
            while self.open and self.open[-1].kind:
                self._close(len(self.open) - 1)
        around = self._top()
        self.count += 1
        kind, region, article = around.kind, around.region, around.article
        if tag in _UNSEEN:
            kind = 2
        elif not kind:
            if tag in _REGION:
                region, article = (region if article else self.count), True
            elif tag in _BESIDE or (tag == "header" and not article) or (attrs and tag not in ("html", "body") and _marked(attrs, article)):
                kind, region = 1, self.count
            elif is_block and not article and tag not in _INNER:
                region = self.count
        if is_block:
            self.blocks.append(len(self.open))
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(_Open(tag, kind, region, article))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        is_block = tag in _BREAKS
        if is_block:
            self._flush()
        where = self.at.get(tag)
        if where and (is_block or not self.blocks or where[-1] > self.blocks[-1]):
            self._close(where[-1])

    def handle_data(self, data: str) -> None:
        if self._top().kind < 2:
            self.parts.append(data)
            if self.at.get("a"):
                self.link_chars += len(data)

    def close(self) -> None:
        super().close()
        self._flush()


def _marked(attrs: list, in_region: bool) -> bool:
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if value and name in ("class", "id", "role"):
            words = _TOKEN.findall(value.lower())
            found = _MARKS.intersection(words)
            if in_region:  # an article's own header holds its title
                found -= {"header", "byline"}
            if found:
                return True
        elif name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def text_to_tag_ratios(lines: list[Line]) -> np.ndarray:
    return np.array([(len(x.text) - x.link_chars) / max(1, x.tags + MARK_TAGS * x.marked) for x in lines], float)


def smooth(values: np.ndarray, regions: np.ndarray | None = None, sigma: float = SIGMA, radius: int = RADIUS, border: float = BORDER) -> np.ndarray:
    """Gaussian smoothing over lines, of which those in another region stand further off; weights beyond the ends are left out."""
    n = len(values)
    crossed = np.zeros(n) if regions is None else np.concatenate(([0], np.cumsum(regions[1:] != regions[:-1])))
    total, weights = values.astype(float), np.ones(n)
    for step in range(1, min(radius, n - 1) + 1):
        weight = np.exp(-0.5 * ((step + border * (crossed[step:] - crossed[:-step])) / sigma) ** 2)
        total[step:] += weight * values[:-step]
        total[:-step] += weight * values[step:]
        weights[step:] += weight
        weights[:-step] += weight
    return total / weights


def threshold(x: np.ndarray, least: float = float(np.log1p(LEAST_RATIO))) -> float:
    """Border between the two means of ``x``, ``least`` at the smallest; just ``least`` if the values do not differ."""
    if not len(x) or x.max() - x.min() < 1e-9:
        return least
    low, high = x.min(), x.max()
    for _ in range(50):
        above = x > (low + high) / 2
        new = (x[~above].mean(), x[above].mean()) if above.any() and not above.all() else (low, high)
        if new == (low, high):
            break
        low, high = new
    return max(least, float((low + high) / 2))


def page_lines(page: str) -> list[Line]:
    parser = PageLines()
    parser.feed(page)
    parser.close()
    return parser.lines


def region_values(lines: list[Line]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's smoothed log ratio and the number of its region, and each region's mean, NaN for those of links only."""
    regions = np.array([x.region for x in lines])
    ratios = smooth(np.log1p(text_to_tag_ratios(lines)), regions)
    own = np.array([len(x.text) - x.link_chars for x in lines], float)
    _, number = np.unique(regions, return_inverse=True)
    size = np.bincount(number, own)
    return ratios, number, np.where(size > 0, np.bincount(number, own * ratios) / np.maximum(size, 1), np.nan)


def content_lines(lines: list[Line], border: Callable[[np.ndarray], float] | None = None) -> list[bool]:
    """Which lines are content. border: finds the threshold of the regions' values, two-means clustering if not given."""
    if not lines:
        return []
    ratios, number, values = region_values(lines)
    above = (border or threshold)(values[~np.isnan(values)])
    good = np.nan_to_num(values, nan=-np.inf) > above
    return [bool(good[k]) and (bool(r > above) or x.link_chars <= MOST_LINKS * len(x.text)) for x, r, k in zip(lines, ratios, number, strict=True)]


def main_text(page: str | None, border: Callable[[np.ndarray, np.ndarray], float] | None = None) -> str:
    """The page's main text: content lines in page order, joined by one space."""
    lines = page_lines(page) if page else []
    return " ".join(x.text for x, ok in zip(lines, content_lines(lines, border), strict=True) if ok)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each page."""
    return map_columns(pages, {"html": html_col}, f"`{text_col}` string", lambda html: [[main_text(x) for x in html.to_pylist()]])
