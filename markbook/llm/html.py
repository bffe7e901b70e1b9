"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events.  They are cut into lines, one per block of text, each with its characters of
text, of link text and its number of tags.  Ratios of text to tags are smoothed with a Gaussian along the page, and a
threshold found by clustering the page's own smoothed ratios in two separates content from boilerplate.  Regions whose role
the markup itself names (menus, headers, footers, sidebars, adverts, forms, comments ...) never count as content, and an
article or main element, where the page has one, bounds it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.llm.common import query, table, travels

travels(__name__)

SIGMA = 1.5  # lines
# Elements that end a line of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead title tr ul".split())
# Elements whose text is never content.
SILENT = frozenset(
    "applet audio button canvas datalist dialog embed footer form head header iframe input menu nav noframes noscript object "
    "script select style svg template textarea title video aside".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation note search status toolbar".split())
# Words of class and id attributes that name a region as no part of an article.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising|isements)?|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|"
    r"masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|notification|pager|pagination|popup|promo|promoted|"
    r"recommended|related|replies|respond|share|sharing|sidebar|sidenav|social|sponsor|sponsored|subscribe|toolbar|widget)(?:$|[\s_-])")
KEEP = frozenset("html body main article".split())  # never silenced by their names, except when they are comments
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|replies|disqus)(?:$|[\s_-])")
SPACE = re.compile(r"\s+")
CLOSES = {  # a start tag ends these open elements, as the markup rules have it
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}


class _Lines(HTMLParser):
    """Lines of a page: (text, linked characters, tags before it, whether an article holds it)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []
        self.parts: list[str] = []
        self.linked = self.tags = 0
        self.open: list[tuple[str, bool]] = []  # element, whether it silenced what it holds
        self.counts: Counter[str] = Counter()  # open elements by name
        self.silent = self.links = self.articles = 0

    def _end_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.linked, self.tags, self.articles > 0))
            self.tags = 0
        self.parts.clear()
        self.linked = 0

    def _silences(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in SILENT and not (tag == "header" and self.articles):
            return True
        for name, value in attrs:
            if name == "hidden":
                return True
            if not value or name not in ("class", "id", "role", "aria-hidden", "style"):
                continue
            value = value.lower()
            if name == "role" and value in ROLES or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and re.search(r"display\s*:\s*none", value):
                return True
            if name in ("class", "id") and (COMMENT if tag in KEEP else NAMES).search(value):
                return True
        return False

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end_line()
            while self.counts["p"]:  # a paragraph ends where another block begins
                self._close()
        if not self.silent:
            self.tags += 1
        if tag in CLOSES:
            while self.open and self.open[-1][0] in CLOSES[tag]:
                self._close()
        if tag in VOID:
            if tag == "br" and not self.silent:
                self.parts.append(" ")
            return
        silences = self._silences(tag, attrs)
        self.open.append((tag, silences))
        self.counts[tag] += 1
        self.silent += silences
        self.links += tag == "a"
        if not self.silent and tag in ("article", "main"):
            self.articles += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "span", "b", "i"):
            self.handle_endtag(tag)

    def _close(self) -> None:
        tag, silenced = self.open.pop()
        self.counts[tag] -= 1
        if not self.silent and tag in ("article", "main"):
            self.articles -= 1
        self.silent -= silenced
        self.links -= tag == "a"

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._end_line()
        if not self.silent:
            self.tags += 1
        # The nearest open element of that name ends, and all that was left open in it.
        while self.counts[tag]:
            if self.open[-1][0] == tag:
                self._close()
                break
            self._close()

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def parse_html_declaration(self, i):
        """Marked sections (CDATA, conditional comments) are markup up to the next bracket, whatever stands in them."""
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def finish(self) -> list[tuple[str, int, int, bool]]:
        self.close()
        self._end_line()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the lines; weights beyond the page's ends are left out and the others made up."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[reach:-reach]
    return np.convolve(ratios, kernel, "full")[reach:-reach] / weight


def threshold(values: np.ndarray) -> float:
    """Middle between two clusters of the values (two means from the extremes); no threshold where they are one cluster."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        under, over = values[values < cut], values[values >= cut]
        if not len(under) or not len(over):
            break
        moved = float(under.mean()), float(over.mean())
        if moved == (low, high):
            break
        low, high = moved
    return (low + high) / 2 if high > 3 * low else 0.0


def extract(html: str | None) -> str:
    """The page's main text: blocks joined by an empty line, white space inside a block made one blank."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    lines = parser.finish()
    if not lines:
        return ""
    inside = np.array([a for _, _, _, a in lines])
    size = np.array([len(t) for t, _, _, _ in lines], float)
    linked = np.array([n for _, n, _, _ in lines], float)
    tags = np.array([max(n, 1) for _, _, n, _ in lines], float)
    ratio = smoothed((size - np.minimum(linked, size)) / tags)
    if inside.any():
        # The markup bounds the content: within it, a line goes only if it is nothing but links among links.
        keep = inside & ((linked < 0.9 * size) | (ratio >= threshold(ratio)))
    else:
        keep = (ratio >= threshold(ratio)) & (linked < 0.9 * size)
    return "\n\n".join(t for (t, _, _, _), k in zip(lines, keep) if k)


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` plus ``text``, the main text of ``html``; null and empty pages have an empty text."""

    @F.pandas_udf("string")
    def extracted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in parts:
            yield html.map(extract, na_action=None)

    return pages.withColumn("text", extracted("html"))


@query("op1_html")
def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    pages = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
