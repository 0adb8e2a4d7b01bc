"""Main text of web pages, from parser events and the text-to-tag ratio of lines.

The standard library's parser streams events. Every block-level tag ends a line, which keeps its text,
the tags seen in it and the elements around it. The logarithms of the lines' ratios of text to tags are
smoothed by a Gaussian, so that a short line in a dense stretch counts as dense. What the tags say is
evidence that scales this density: the furniture of a page (navigation, header, footer, aside, form, or
a class, id or role that says so) lowers it, an article, a main or a heading raises it. Two clusters of
the result part the core lines from the others. The content region is the container in which core text
outweighs other text by most, where what an article holds besides counts neither way; the text is the
region's core lines, and its other lines unless evidence is against them, so short paragraphs stay. A class or id that only partly names furniture weighs little, and one
around most of the page nothing.

Defined results: a null or empty page, and one without text outside furniture, gives an empty text;
unclosed and stray tags and broken markup are borne; a page cut off is read to its end; character references are decoded;
white space inside a block becomes one space; equal pages each return a row, null ids too; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA = 1.0
#: Characters for each tag from which a line is simply dense.
DENSE = 100
#: What evidence makes of a line's density.
FURNITURE, DOUBTFUL, FAVOURED = 0.1, 0.7, 1.5
#: Shares of the page's text from which a class, id or role around it says nothing: with a title, main or article in it, and without.
MOST, NEARLY_ALL = 0.5, 0.9

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH_LIKE = HEADINGS | {"p"}
#: Elements that are parts of a region, not regions.
LINES = PARAGRAPH_LIKE | frozenset("li dt dd tr td th thead tbody tfoot caption pre figcaption summary legend address".split())
BLOCKS = HEADINGS | frozenset(
    "html head body article main section div nav header footer aside form table thead tbody tfoot tr td th caption ul ol dl li dt dd menu p pre hr address figure figcaption details summary dialog fieldset legend blockquote center title template noscript svg math iframe object select option button textarea script style".split()
)
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
UNSEEN = frozenset("head title script style template noscript svg math iframe object select option button textarea".split())
OF_THE_PAGE = frozenset("nav footer aside menu dialog".split())
ARTICLES = frozenset(("article", "main"))
#: An open element of the key ends where one of these begins.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Words of a class or id that name furniture, and words that may stand beside them.
NAMES = frozenset(
    "nav navbar navigation menu submenu sidebar footer ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup comment comments disqus respond reply replies share sharing social breadcrumb breadcrumbs pagination pager related recommended widget copyright login search skip toolbar masthead".split()
)
BESIDE = frozenset("site global primary secondary top bottom left right inner outer box block bar area section container wrapper wrap list slot unit item items link links button buttons form post posts panel module header text".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())


#: Weights of class and id attributes, as they come up.
WEIGHTS: dict[tuple[str, bool], float] = {}


def _named(value: str, of_id: bool) -> float:
    """What a class or id attribute does to density: FURNITURE if one of its names says nothing else, DOUBTFUL if one says so partly."""
    weight = WEIGHTS.get((value, of_id))
    if weight is not None:
        return weight
    weight = 1.0
    for name in [value] if of_id else value.split():
        words = [w for w in re.split(r"[^a-z]+", name.lower()) if w]
        if found := [w for w in words if w in NAMES]:
            whole = all(w in NAMES or w in BESIDE for w in words) and found
            weight = min(weight, FURNITURE if whole else DOUBTFUL)
    if len(WEIGHTS) >= 10_000:
        WEIGHTS.clear()
    WEIGHTS[value, of_id] = weight
    return weight


def _evidence(tag: str, attrs: list[tuple[str, str | None]]) -> float:
    """What an element's attributes do to the density of its text; 0 hides it."""
    weight = 1.0
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return 0.0
        if name == "role" and (value or "").lower() in ROLES:
            weight = FURNITURE
        elif value and (name == "class" or (name == "id" and tag not in HEADINGS)):
            weight = min(weight, _named(value, name == "id"))
    return weight


class Element:
    """An open or closed element: its own evidence, what it holds, and what is around it."""

    __slots__ = ("tag", "outer", "own", "attrs", "size", "content", "net", "number")

    def __init__(self, tag: str, outer: Element | None, own: float, attrs: float, number: int):
        self.tag, self.outer, self.own, self.attrs, self.number = tag, outer, own, attrs, number
        self.size = 0  # characters within
        self.content = False  # whether a title, main or article is within
        self.net = 0  # core characters less the others


class Page(HTMLParser):
    """Collects lines (text, tags, element) and the elements, outer ones first."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", None, 1.0, 1.0, 0)
        self.elements, self.stack = [self.root], [self.root]
        self.open: Counter[str] = Counter()  # elements of the stack, by tag
        self.inline: list[tuple[str, Element]] = []  # open inline elements with evidence
        self.lines: list[tuple[str, int, Element]] = []
        self.parts: dict[int, tuple[Element, list[str]]] = {}
        self.tags = 0

    def _end_line(self) -> None:
        for element, parts in self.parts.values():
            if text := " ".join("".join(parts).split()):
                self.lines.append((text, self.tags, element))
                self.tags = 0
        self.parts = {}
        self.inline.clear()

    def _new(self, tag: str, outer: Element, attrs) -> Element:
        own = 1.0
        if tag in UNSEEN:
            own = 0.0
        elif tag in OF_THE_PAGE or (tag == "header" and not any(self.open[t] for t in ARTICLES)):
            own = FURNITURE
        weight = _evidence(tag, attrs) if attrs else 1.0
        if tag == "form":
            weight = min(weight, FURNITURE)
        element = Element(tag, outer, own, weight, len(self.elements))
        self.elements.append(element)
        if tag == "h1" or (tag in ARTICLES and weight == 1):
            element.content = True
        return element

    def _close(self, i: int) -> None:
        self.open.subtract(e.tag for e in self.stack[i:])
        del self.stack[i:]

    def handle_starttag(self, tag, attrs) -> None:
        self.tags += 1
        if tag == "br":
            self.handle_data(" ")
        elif tag in BLOCKS:
            self._end_line()
            while len(self.stack) > 1 and (self.stack[-1].tag in PARAGRAPH_LIKE or tag in ENDED_BY.get(self.stack[-1].tag, ())):
                self._close(len(self.stack) - 1)
            element = self._new(tag, self.stack[-1], attrs)
            if tag not in VOID:
                self.stack.append(element)
                self.open[tag] += 1
        elif attrs and tag not in VOID and _evidence(tag, attrs) != 1:
            self.inline.append((tag, self._new(tag, self.inline[-1][1] if self.inline else self.stack[-1], attrs)))

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
            if self.open[tag]:
                i = len(self.stack) - 1
                while self.stack[i].tag != tag:
                    i -= 1
                self._close(i)
        else:
            for i in range(len(self.inline) - 1, -1, -1):
                if self.inline[i][0] == tag:
                    del self.inline[i:]
                    break

    def handle_data(self, data) -> None:
        element = self.inline[-1][1] if self.inline else self.stack[-1]
        if element.number not in self.parts:
            self.parts[element.number] = element, []
        self.parts[element.number][1].append(data)

    def parse_html_declaration(self, i: int) -> int:
        """A marked section that the parser doesn't know is a comment."""
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def finish(self, html: str) -> Page:
        self.feed(html)
        self.close()
        self._end_line()
        return self


def weights_of(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """What evidence against each line makes of its density (0: text that isn't shown), and what evidence for it does."""
    seen: list[float] = []  # by element, the tags alone
    for e in page.elements:
        seen.append(e.own * (seen[e.outer.number] if e.outer else 1.0))
    total = 0
    for text, _, e in page.lines:
        if seen[e.number] == 1:
            e.size += len(text)
            total += len(text)
    for e in reversed(page.elements):
        if e.outer:
            e.outer.size += e.size
            e.outer.content |= e.content
    weight, favour = [], []
    for e in page.elements:
        said = e.attrs
        if 0 < said < 1 and e.size >= (MOST if e.content else NEARLY_ALL) * max(1, total):
            said = 1.0
        weight.append(min(e.own, said) * (weight[e.outer.number] if e.outer else 1.0))
        favour.append(e.tag in HEADINGS or e.tag in ARTICLES or bool(e.outer and favour[e.outer.number]))
    at = [e.number for _, _, e in page.lines]
    return np.array(weight)[at], np.where(np.array(favour)[at], FAVOURED, 1.0)


def smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    return np.convolve(ratio, kernel, "full")[reach : reach + len(ratio)] / np.convolve(np.ones(len(ratio)), kernel, "full")[reach : reach + len(ratio)]


def threshold(values: np.ndarray) -> float:
    """The middle between two clusters of the values and zero, which a page of one density lies above."""
    values = np.append(values, 0.0)
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        at = (low + high) / 2
        below, above = values[values < at], values[values >= at]
        new = (float(below.mean()) if len(below) else low, float(above.mean()) if len(above) else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page().finish(html)
    weight, favour = weights_of(page)
    plain = weight == 1
    if not plain.any():
        return ""
    density = weight * favour * smooth(np.log1p([min(len(text) / max(1, tags), DENSE) for text, tags, _ in page.lines]))
    core = density >= threshold(density)
    for (text, _, e), c, against in zip(page.lines, core, plain & (favour == 1)):
        e.net += len(text) if c else -len(text) if against else 0
    for e in reversed(page.elements):
        if e.outer:
            e.outer.net += e.net
    region = max((e for e in page.elements if e.tag not in LINES), key=lambda e: (e.net, -e.number))  # of equal ones the outermost
    inside = set()
    for e in page.elements[region.number :]:
        if e is region or (e.outer and e.outer.number in inside):
            inside.add(e.number)
    return " ".join(text for (text, _, e), keep in zip(page.lines, plain | (core & (weight > 0))) if keep and e.number in inside)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
