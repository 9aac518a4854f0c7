"""Main text of HTML pages: parser events, text-to-tag ratio of each line, Gaussian smoothing, threshold clustering.

The standard library's streaming parser splits a page into lines (one for each block of text) and counts the
tags of each. The ratio of text to tags is high in running text and low in menus. After Gaussian smoothing over
neighbouring lines, the lines above a threshold (the spread of the smoothed ratios) seed content regions, and a
region that holds a seed is kept whole, short lines included. What markup already names is settled first: lines
inside menus, headers, footers, sidebars, forms, adverts, notices, scripts, styles or reader comments are never
content, and where the page has an article or main element, only what is inside it can be. Each such element is one region.

Where there is no such element, the regions between the first and the last seed, below the innermost element that holds both, are of the text, too,
unless half of what they say or more is links (such a region is no seed either, if another one is); and so is the nearest top heading before them. A name or a form that could be wrong is doubtful and settled when the whole
page is known: an element that holds an article is not excluded by its name if no article stands outside of it (but readers' comments are, whatever they hold), and a
form is not if it holds most of the text, as it wraps the page then.

Defined results: null or empty html gives an empty text; a page without text outside the excluded parts gives an
empty text; a page in which no line stands out keeps the region with the best line. A header element is left out wherever it stands, an article's own
included. Broken markup is read as
browsers do: a paragraph, list item or table cell ends where the next begins, other unclosed elements end with their parent, stray end tags are ignored. Repeated rows give repeated
results; whole pages are read, however long, in time in proportion to their length. Other columns pass through.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import table

#: Elements without an end tag, and inline elements, which don't end a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose text is never content.
EXCLUDED = frozenset(
    "head title script style noscript template nav header footer aside button select option textarea input iframe object embed svg canvas audio video dialog menu".split()
)
#: What a start tag ends if it is open and nothing of the second set lies in between; block elements end a paragraph.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li dt dd main menu nav ol p pre search section summary table ul".split()
)
P_SCOPE = frozenset("button caption html object table td template th".split())
#: Not content either, but some wrap the whole page.
WRAPPERS = frozenset(["form"])
#: Words of a class, an id or a role that mark an element whose text is never content, if its whole name is made of them and of ``PLAIN`` words.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar navigation nav navbar menu "
    "breadcrumb breadcrumbs footer masthead topbar toolbar comment comments disqus reply replies respond cookie cookies consent gdpr notice notices "
    "alert newsletter subscribe subscription signup popup modal overlay share sharing social related recommended form search login pagination pager widget complementary contentinfo".split()
)
#: Words that say where such an element is or what it holds, but not that it is one.
PLAIN = frozenset(
    "left right top bottom upper lower side site page post posts article articles user reader readers global main primary secondary mobile desktop sticky fixed floating inline "
    "wrapper wrap container box block blocks list item items section area bar bars column col row inner outer content body title text link links icon icons button buttons "
    "slot unit group panel message count thread input field media tools bottom google the and of by for us our".split()
)
#: Marks that say it whatever else the name says, where they come first or last in it; behind one of ``DENIED`` they say the opposite.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsored sidebar navbar breadcrumb breadcrumbs comment comments disqus cookie cookies consent gdpr newsletter popup modal pagination pager masthead".split()
)
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
DENIED = frozenset("has with no without not hide".split())
#: Elements whose id is the name of their topic: only strong marks count in it.
TOPICS = frozenset("section h1 h2 h3 h4 h5 h6".split())
#: These count only outside the article, whose own parts may be called so.
OUTER_MARKS = frozenset("header".split())
CONTENT = frozenset(["article", "main"])
#: Their class, id or role never marks their text.
UNMARKED = CONTENT | {"html", "body"}
REGIONS = frozenset("article main section div td body html".split())
#: Of the Gaussian, in lines.
SIGMA = 1.0
_MARK = re.compile(r"[A-Za-z]+")


class _Line(NamedTuple):
    text: str
    tags: int
    region: int
    may: bool  # be content, as far as is certain
    inside: bool  # an article or main element
    doubt: int  # the innermost doubtful element around it, or 0
    links: int  # characters in links
    title: bool


class _Open(NamedTuple):
    tag: str
    out: bool
    inside: bool
    region: int
    doubt: int


class _Lines(HTMLParser):
    """Collects the lines of a page, its regions and its doubtful elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.lines: list[_Line] = []
        self.buffer: list[str] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # of each tag: where it is in the stack
        self.blocks: list[int] = []  # where the stack has elements that are not inline
        self.tags = self.links = 0
        self.region_end, self.region_in = [0], [0]  # of each region: the last region within it, and the region around it
        # Of each doubtful element: the one around it, whether it is a form, whether it is for comments, whether it holds an article outside of others within.
        self.doubt_in, self.doubt_form, self.doubt_comments, self.doubt_holds = [0], [False], [False], [False]
        self.now = _Open("", False, False, 0, 0)

    def end_line(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        if text:
            now = self.now
            self.lines.append(_Line(text, self.tags, now.region, not now.out, now.inside, now.doubt, min(self.links, len(text)), bool(self.places["h1"])))
            self.tags = 0
        self.links = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.buffer.append(" ")
        if tag in ENDS_P:
            self._imply({"p"}, P_SCOPE)
        if tag in IMPLIED:
            while self._imply(*IMPLIED[tag]):
                pass
        if tag in VOID:
            if tag == "hr":
                self.end_line()
            return
        now = self.now
        out = now.out or tag in EXCLUDED or self._hidden(attrs)
        doubtful = not out and (tag in WRAPPERS or self._marked(tag, attrs))
        if tag not in INLINE or out != now.out or doubtful:
            self.end_line()
            self.tags = max(self.tags, 1)
        region, doubt = now.region, now.doubt
        if tag in REGIONS and not now.inside:  # what an article holds is of its region
            region = len(self.region_in)
            self.region_in.append(now.region)
            self.region_end.append(region)
        if doubtful:
            doubt = len(self.doubt_in)
            self.doubt_in.append(now.doubt)
            self.doubt_form.append(tag in WRAPPERS)
            self.doubt_comments.append(any(name in ("class", "id", "role") and COMMENTS.intersection(map(str.lower, _MARK.findall(value or ""))) for name, value in attrs))
            self.doubt_holds.append(False)
        if tag in CONTENT:
            self.doubt_holds[doubt] = True
        self.places[tag].append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.now = _Open(tag, out, now.inside or tag in CONTENT, region, doubt)
        self.stack.append(self.now)

    def _cut(self, at: int) -> None:
        for x in self.stack[at:]:
            self.places[x.tag].pop()
            if x.tag not in INLINE:
                self.blocks.pop()
            self.region_end[x.region] = len(self.region_in) - 1
        del self.stack[at:]
        self.now = self.stack[-1] if self.stack else _Open("", False, False, 0, 0)

    def _imply(self, ended: set[str], scope) -> bool:
        """Ends the innermost open element of ``ended`` within the scope."""
        last = lambda tags: max((self.places[t][-1] for t in tags if self.places[t]), default=-1)
        at = last(ended)
        if at < 0 or at < last(scope):
            return False
        self.end_line()
        self._cut(at)
        return True

    @staticmethod
    def _hidden(attrs) -> bool:
        return any(name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value or "") for name, value in attrs)

    def _marked(self, tag, attrs) -> bool:
        if tag in UNMARKED:
            return False
        marks = MARKS if self.now.inside else MARKS | OUTER_MARKS
        for name, value in attrs:
            if name not in ("class", "id", "role"):
                continue
            for title in (value or "").split():
                words = list(map(str.lower, _MARK.findall(title)))
                if not words or words[0] in DENIED:
                    continue
                if words[0] in STRONG or words[-1] in STRONG:
                    return True
                if not (name == "id" and tag in TOPICS) and marks.intersection(words) and (marks | PLAIN).issuperset(words):
                    return True
        return False

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash has no meaning in HTML; void elements are known by name

    def handle_endtag(self, tag):
        self.tags += 1
        at = self.places[tag][-1] if self.places[tag] else -1
        if tag in INLINE and self.blocks and at < self.blocks[-1]:
            at = -1  # the end of an inline element does not end the blocks within it
        if at < 0:
            if tag == "p":
                self.end_line()
            return
        around = self.stack[at - 1] if at else _Open("", False, False, 0, 0)
        if tag not in INLINE or around.out != self.now.out or around.doubt != self.now.doubt:
            self.end_line()
        self._cut(at)

    def handle_data(self, data):
        self.buffer.append(data)
        if self.places["a"]:
            self.links += len(data.strip())

    def finish(self) -> None:
        self.end_line()
        self._cut(0)
        self.region_end[0] = len(self.region_in) - 1

    def excluded(self) -> list[bool]:
        """Of each doubtful element, now that the page is known, whether it goes, or one around it does."""
        n, chars, holds, outside = len(self.doubt_in), [0] * len(self.doubt_in), self.doubt_holds[:], self.doubt_holds[:]
        for x in self.lines:
            if x.may:
                chars[x.doubt] += len(x.text)
        for k in range(n - 1, 0, -1):  # an element stands behind the one around it
            chars[self.doubt_in[k]] += chars[k]
            holds[self.doubt_in[k]] |= holds[k]
        out = [False] * n
        for k in range(1, n):
            around = self.doubt_in[k]
            wraps = holds[k] and not outside[around] and not self.doubt_comments[k] or self.doubt_form[k] and 2 * chars[k] > chars[0]
            out[k] = out[around] or not wraps
            outside[k] |= outside[around]
        return out

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    radius = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    return np.convolve(np.pad(ratios, radius, mode="edge"), kernel, mode="valid")


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.finish()
    lines, out = parser.lines, parser.excluded()
    can = [x.may and not out[x.doubt] for x in lines]
    article = any(ok and x.inside for ok, x in zip(can, lines))
    if article:
        can = [ok and x.inside for ok, x in zip(can, lines)]
    if not any(can):
        return ""
    ratio = smoothed(np.array([len(x.text) / max(x.tags, 1) for x in lines]))
    ratio_of_can = np.where(can, ratio, -1.0)
    seeds = ratio_of_can > ratio.std()
    if not seeds.any():
        seeds = ratio_of_can == ratio_of_can.max()
    linked = set() if article else _linked(lines)
    if (own := seeds & [x.region not in linked for x in lines]).any():
        seeds = own
    places = np.flatnonzero(seeds)
    chosen = {lines[i].region for i in places}
    keep = [ok and x.region in chosen for ok, x in zip(can, lines)]
    if not article:
        _fill(parser, can, keep, int(places[0]), int(places[-1]), linked)
    return "\n".join(x.text for ok, x in zip(keep, lines) if ok)


def _linked(lines: list[_Line]) -> set[int]:
    """Regions half of whose own characters or more are links."""
    chars, links = defaultdict(int), defaultdict(int)
    for x in lines:
        chars[x.region] += len(x.text)
        links[x.region] += x.links
    return {r for r in chars if 2 * links[r] >= chars[r]}


def _fill(parser: _Lines, can: list[bool], keep: list[bool], first: int, last: int, linked: set[int]) -> None:
    """Marks in ``keep`` what lies between the first and the last seed below the innermost region around both, and the heading before."""
    lines = parser.lines
    low, high = (f(x.region for x, ok in zip(lines, keep) if ok) for f in (min, max))
    around = low
    while around and parser.region_end[around] < high:
        around = parser.region_in[around]
    for i in range(first, last + 1):
        region = lines[i].region
        if can[i] and around <= region <= parser.region_end[around] and region not in linked:
            keep[i] = True
    start = keep.index(True)
    heading = next((i for i in range(start - 1, -1, -1) if can[i] and lines[i].title), None)
    if heading is not None and not any(x.title for x, ok in zip(lines, keep) if ok) and 2 * lines[heading].links < len(lines[heading].text):
        keep[heading] = True


@F.pandas_udf(StringType())
def extract_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pages.map(main_text, na_action=None)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without its html, with ``text`` (main text) and ``n_chars`` (its code points)."""
    keep = [f"`{c}`" for c in pages.columns if c not in (html, "text", "n_chars")]
    return pages.select(*keep, extract_text(F.col(f"`{html}`")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
