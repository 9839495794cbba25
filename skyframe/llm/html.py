"""The main text of web pages, by the ratio of text to tags along the page.

The standard library's parser streams a page as events. They are cut into lines, one a block, each
with its text, the tags met since the line before, and where it stands. Ratios of text to tags are
smoothed by a Gaussian, and lines over a threshold form clusters, which say which region of the page
is content: its articles, its main element, or the container of the largest cluster. What elements
and their names say is not content, menus and adverts for instance, has a ratio of zero.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.tables import with_row

# Lines on either side that a line's ratio is smoothed over, and the Gaussian's width in lines.
RADIUS, SIGMA = 2, 1.0
# Lines under the threshold that a cluster may have between two over it.
GAP = 3
# The share of a line's characters, or a list's, that makes it links.
LINKS = 0.9

# Elements by what they do.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead title tr ul".split()
)
_NEVER = set(
    "script style noscript template title head nav footer aside menu dialog form button select textarea input label "
    "fieldset iframe object embed applet svg math canvas audio video map noframes datalist output progress meter".split()
)
_HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
_CONTAINERS = set("html body div section article main td th center form fieldset details".split())
# What an element of the name closes, up to the elements that hold such a list.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_HEAD = set("title meta link base script style noscript template".split())
# Words in a class or an id that say what is not content, and those that turn the saying around.
_APART = set(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo "
    "promos promotion promotions nav navbar navigation navi menu menus breadcrumb breadcrumbs masthead banner topbar "
    "toolbar header footer foot sidebar sidebars side aside rail widget widgets cookie cookies consent gdpr notice "
    "notices notification notifications alert alerts warning modal popup overlay newsletter subscribe subscription signup "
    "login share sharing social follow comment comments disqus reply replies respond response responses discussion related "
    "recommended recommendations pagination pager copyright disclaimer search skip form forms feedback".split()
)
_AROUND = set("has with without no not non".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


def _apart(tag: str, attributes: dict[str, str | None]) -> bool:
    """Whether an element's attributes say that it is not content."""
    if "hidden" in attributes or (attributes.get("aria-hidden") or "").lower() == "true":
        return True
    if (attributes.get("role") or "").lower() in _ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style") or "", re.I):
        return True
    if tag in ("html", "body", "main"):
        return False
    for name in f"{attributes.get('class') or ''} {attributes.get('id') or ''}".split():
        words = {word.lower() for word in _WORD.findall(name)}
        if words & _APART and not words & _AROUND:
            return True
    return False


class _Element:
    __slots__ = ("tag", "drop", "form", "article", "main", "list", "container")

    def __init__(self, tag: str, above: _Element | None):
        self.tag = tag
        self.drop = above.drop if above else False
        # Whether it is dropped for a form around it alone: some pages are one form.
        self.form = above.form if above else False
        self.article = above.article if above else 0
        self.main = above.main if above else 0
        self.list = above.list if above else 0
        self.container = above.container if above else 0


class _Line:
    __slots__ = ("text", "linked", "tags", "article", "main", "list", "container", "heading")

    def __init__(self, text: str, linked: int, tags: int, at: _Element, heading: bool):
        self.text, self.linked, self.tags, self.heading = text, linked, tags, heading
        self.article, self.main, self.list, self.container = at.article, at.main, at.list, at.container

    def letters(self) -> int:
        return len(self.text) - self.text.count(" ")


class _Lines(HTMLParser):
    """The lines of a page, as its events come."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        # The container above each, and those that are the page itself.
        self.above, self.whole = [0], {0}
        self.stack = [_Element("", None)]
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked = self.tags = self.elements = 0
        self.left_out = self.ended = False

    def updatepos(self, i: int, j: int) -> int:
        # Nobody asks for line numbers.
        return j

    # What a page cut short ends in is markup, not text.

    def parse_starttag(self, i: int) -> int:
        k = super().parse_starttag(i)
        return self._beyond(i) if k < 0 and self.ended else k

    def parse_endtag(self, i: int) -> int:
        k = super().parse_endtag(i)
        return self._beyond(i) if k < 0 and self.ended else k

    def parse_html_declaration(self, i: int) -> int:
        k = self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)
        return self._beyond(i) if k < 0 and self.ended else k

    def parse_pi(self, i: int) -> int:
        k = super().parse_pi(i)
        return self._beyond(i) if k < 0 and self.ended else k

    def parse_comment(self, i: int, report: int = 1) -> int:
        k = super().parse_comment(i, report)
        return len(self.rawdata) if k < 0 and self.ended else k

    def _beyond(self, i: int) -> int:
        return self.rawdata.find(">", i + 1) + 1 or len(self.rawdata)

    # Events.

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in _BLOCK:
            self._line()
        if tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        if tag not in _HEAD and self.open.get("head"):
            self._close({"head"}, set())
        if tag in _BLOCK and tag != "title":
            self._close({"p", "title"}, None)
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if tag == "a":
            self._close({"a"}, None)
        above = self.stack[-1]
        element = _Element(tag, above)
        self.elements += 1
        attributes = dict(attrs)
        article = tag == "article" or (attributes.get("itemprop") or "").lower() == "articlebody"
        main = tag == "main" or (attributes.get("role") or "").lower() == "main"
        if above.form and (article or main):
            element.drop = element.form = False
        if not element.drop:
            element.drop = (tag in _NEVER or _apart(tag, attributes)) and not (tag in _HEADINGS and self._titled(above))
            element.form = element.drop and tag == "form"
            if tag == "header":
                element.drop = True
        elif tag in _HEADINGS and self._titled(above):
            element.drop = False
        if not element.drop:
            element.article = above.article or (self.elements if article else 0)
            element.main = above.main or (self.elements if main else 0)
            element.list = above.list or (self.elements if tag in ("ul", "ol", "dl") else 0)
        if tag in _CONTAINERS:
            self.above.append(element.container)
            element.container = len(self.above) - 1
            if tag in ("html", "body"):
                self.whole.add(element.container)
        self.stack.append(element)
        self.open[tag] = self.open.get(tag, 0) + 1

    def _titled(self, above: _Element) -> bool:
        """Whether a heading here is in the header of an article, and so its title."""
        return above.article > 0 and any(e.tag == "header" for e in self.stack[-3:]) and not any(
            e.drop and e.tag != "header" for e in self.stack[-3:]
        )

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        block = tag in _BLOCK
        if block:
            self._line()
        if self.open.get(tag):
            self._close({tag}, set() if block else None)

    def _close(self, tags: set[str], within: set[str] | None) -> None:
        """Closes the nearest open element of the names, and those in it: up to the nearest element
        of `within`, or to the nearest block if there is none given."""
        if not any(self.open.get(tag) for tag in tags):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[at].tag
            if tag in tags:
                for element in self.stack[at:]:
                    self.open[element.tag] -= 1
                del self.stack[at:]
                return
            if (tag in _BLOCK) if within is None else (tag in within):
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # A slash does not close an element that is not void.
        self.handle_starttag(tag, attrs)
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)

    def handle_data(self, data: str) -> None:
        if self.stack[-1].drop:
            self.left_out = self.left_out or not data.isspace()
            return
        self.parts.append(data)
        if self.open.get("a"):
            self.linked += sum(map(len, data.split()))

    def _line(self) -> None:
        text = " ".join("".join(self.parts).split())
        at = self.stack[-1]
        if text or self.left_out:
            heading = any(element.tag in _HEADINGS for element in self.stack[-4:])
            self.lines.append(_Line(text, self.linked, self.tags, at, heading))
            self.tags = 0
        self.parts, self.linked, self.left_out = [], 0, False


def _lines(html: str) -> _Lines:
    page = _Lines()
    page.feed(html)
    page.ended = True
    page.close()
    page._line()
    return page


def _over_threshold(lines: list[_Line]) -> list[int]:
    """The lines with text whose smoothed ratio of text to tags is over the threshold."""
    ratios = np.array([max(0, line.letters() - line.linked) / max(1, line.tags) for line in lines])
    offsets = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(offsets**2) / (2 * SIGMA**2))
    smooth = np.convolve(ratios, kernel / kernel.sum())[RADIUS : RADIUS + len(ratios)]
    limit = min(smooth.std(), smooth.mean())
    return [i for i, line in enumerate(lines) if line.text and smooth[i] >= limit]


def _menus(lines: list[_Line]) -> set[int]:
    """Lists that are links."""
    totals: dict[int, list[int]] = {}
    for line in lines:
        if line.list:
            total = totals.setdefault(line.list, [0, 0, 0])
            total[0] += 1
            total[1] += line.letters()
            total[2] += line.linked
    return {which for which, (n, letters, linked) in totals.items() if n > 1 and linked >= LINKS * letters}


def _container(page: _Lines, chosen: list[int]) -> int:
    """The nearest container of all the lines."""
    def way(at: int) -> list[int]:
        found = [at]
        while found[-1]:
            found.append(page.above[found[-1]])
        return found[::-1]

    shared = way(page.lines[chosen[0]].container)
    for i in chosen[1:]:
        own = way(page.lines[i].container)
        same = 0
        while same < min(len(own), len(shared)) and own[same] == shared[same]:
            same += 1
        shared = shared[:same]
    return shared[-1]


def main_text(html: str | None) -> str:
    """The content of a page, a line a block; empty if it has none."""
    page = _lines(html or "")
    lines = page.lines
    chosen = _over_threshold(lines) if lines else []
    if not chosen:
        return ""
    menus = _menus(lines)
    kept = [i for i, line in enumerate(lines) if line.text and line.list not in menus]
    for region in ("article", "main"):
        regions = {getattr(lines[i], region) for i in chosen} - {0}
        if regions:
            return "\n".join(lines[i].text for i in kept if getattr(lines[i], region) in regions)

    # The largest cluster, and what stands with it.
    clusters = [[chosen[0]]]
    for i in chosen[1:]:
        if i - clusters[-1][-1] > GAP + 1:
            clusters.append([])
        clusters[-1].append(i)
    best = max(clusters, key=lambda cluster: sum(lines[i].letters() - lines[i].linked for i in cluster))
    region = _container(page, best)
    inside = {region}
    for at in range(region + 1, len(page.above)):
        if page.above[at] in inside:
            inside.add(at)
    first, last = best[0], best[-1]
    if region in page.whole:
        # The page itself: from the cluster's headings to its end.
        while first > 0 and lines[first - 1].heading and lines[first - 1].text:
            first -= 1
    else:
        first, last = 0, len(lines) - 1
    body = [i for i in kept if first <= i <= last and lines[i].container in inside]
    return "\n".join(lines[i].text for i in body if lines[i].linked < LINKS * lines[i].letters())


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every row of `pages`, its columns as they are in a struct `row`, with `main_text` and
    `main_chars`, its code points.

    Blocks of the content are lines; white space inside a block is one space and character
    references are decoded. A null or empty page, or one without content, gives an empty text. The
    rest of a page cut short is read as far as it goes. Pages are told apart by nothing, so repeated
    rows come out as often as they are there; an empty table gives an empty one. A page is read
    whole, by itself, and nothing is shuffled.
    """
    source = pages.select(F.struct("*").alias("row"), F.col(f"`{html}`").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [main_text(value.as_py()) for value in part.column(1)]
                own = [pa.array(texts, pa.string()), pa.array([len(text) for text in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *own], ["row", "main_text", "main_chars"])

    return source.mapInArrow(run, with_row(source, "main_text string, main_chars bigint"))
