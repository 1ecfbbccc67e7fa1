"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams a page's events. Text is gathered into lines, one per
block element; each line knows its characters and tags and the element that holds it. The ratio
of characters to tags, smoothed over neighbouring lines with a Gaussian, is split by a threshold
(a share of its deviation); runs of lines above it are the content. Where the articles of a page
hold the bulk of its content, all those with content are its text, else the ``main`` that does,
with all of their lines, short ones included. On other pages the text is the lowest element
that holds all content, from the line before the first content to the last. Elements that by
name, class, id or role are menus, headers, footers, sidebars, notices, adverts, forms, comments,
scripts or styles give no lines at all. A name is a whole token of class, id or role, alone or put
together from such words and words of place or shape ("cookie-notice", "comment-list"); a token with
any other word ("overflow-hidden", "has-sidebar", "related-to-health") says nothing, and "hidden"
stands alone.

Defined cases: NULL and empty pages, and pages without content, give an empty text; repeated
pages are read each for themselves; NULL ids and urls stay; an empty table gives an empty
result; other columns are ignored; an article in another one belongs to the outer one; broken
nesting and missing end tags are closed by the next block or by the end of an outer element.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelbook.llm.frames import map_arrow, sub_batches

# Element names by their role in HTML, and words of class, id and role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "aside button canvas datalist dialog footer form head iframe input map menu nav noscript object option script "
    "select style svg template textarea title".split()
)
REGIONS = frozenset(["article", "main"])
CONTAINERS = frozenset("article blockquote body details div main section td".split())
NOISE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disclaimer footer gdpr hidden masthead menu modal nav navbar navigation newsletter notice "
    "notification notifications pagination paywall popup promo promotion related replies respond share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription toolbar widget alert complementary contentinfo search "
    "disqus commentlist discussion reactions topbar".split()
)

# Words that leave a name of NOISE what it is, as in "site-footer" or "comment-list".
BESIDE = frozenset(
    "area bar bottom box block btn button buttons container fixed form item items link links list main page post posts "
    "primary secondary section site thread top wrap wrapper".split()
)

# Standard deviation of the smoothing, in lines, and the threshold as a share of the deviation of the ratios.
SIGMA = 1.0
THRESHOLD = 0.5
# The share of the content that is the bulk of it.
BULK = 0.7


def _is_noise(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name in ("hidden",) or (name == "aria-hidden" and value == "true"):
            return True
        if value and name in ("class", "id", "role"):
            for token in value.split():
                words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())) - {""}
                named = words == {"hidden"} or "hidden" not in words and words & NOISE and words <= NOISE | BESIDE
                if named or (name == "role" and words & {"banner", "form"}):
                    return True
    return False


class _Lines(HTMLParser):
    """Lines of one page: text, tags, and the chain of containers of each."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []  # text, tags, container
        self.parents: list[int] = [-1]
        self.names: list[str] = ["page"]
        self._open: list[tuple[str, bool, int]] = []  # name, skipped, container
        self._container = 0
        self._skipping = 0
        self._parts: list[str] = []
        self._tags = 0

    def finish(self) -> None:
        self.close()
        self._end_line()

    def _end_line(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            self.lines.append((text, self._tags, self._container))
            self._tags = 0
        self._parts.clear()

    def _pop(self) -> None:
        _, skipped, container = self._open.pop()
        self._skipping -= skipped
        self._container = container

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self._end_line()
        elif tag == "br":
            self._parts.append(" ")
        if tag in VOID:
            return
        if tag in REGIONS and self._skipping and not _is_noise(tag, attrs):
            # An article does not lie in a menu or an advert: their end tags are missing.
            while self._skipping:
                self._pop()
        if tag in BLOCKS:
            self._close_implied(tag)
        elif tag not in SKIPPED:
            return
        skipped = tag in SKIPPED or (tag not in ("html", "body") and _is_noise(tag, attrs))
        if tag == "header":
            skipped = skipped or not any(name in REGIONS for name, _, _ in self._open)
        self._open.append((tag, skipped, self._container))
        self._skipping += skipped
        if tag in CONTAINERS:
            self.parents.append(self._container)
            self.names.append(tag)
            self._container = len(self.parents) - 1

    def _close_implied(self, tag: str) -> None:
        closes = {
            "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"),
            "td": ("td", "th", "p"), "th": ("td", "th", "p"), "body": ("head", "title"),
        }.get(tag, ("p",))
        while self._open and self._open[-1][0] in closes:
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self._end_line()
        if tag in BLOCKS or tag in SKIPPED:
            for i in range(len(self._open) - 1, -1, -1):
                if self._open[i][0] == tag:
                    while len(self._open) > i:
                        self._pop()
                    break
                if self._open[i][0] in REGIONS and tag not in ("article", "main", "body", "html"):
                    break  # an end tag without its start does not close an article

    def handle_data(self, data: str) -> None:
        if not self._skipping:
            self._parts.append(data)


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """``values`` averaged with their neighbours by a Gaussian, edges renormalised."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(values, kernel)[reach:reach + len(values)]
    weight = np.convolve(np.ones(len(values)), kernel)[reach:reach + len(values)]
    return total / weight


def content_lines(lines: list[tuple[str, int, int]], sigma: float = SIGMA, threshold: float = THRESHOLD) -> np.ndarray:
    """Whether each line belongs to the content cluster."""
    ratios = np.array([len(text) / max(1, tags) for text, tags, _ in lines])
    smooth = smoothed(ratios, sigma)
    return smooth >= min(threshold * ratios.std(), smooth.max())


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.finish()
    lines = parser.lines
    if not lines:
        return ""
    content = content_lines(lines)
    mass = np.zeros(len(parser.parents))
    for (text, _, container), inside in zip(lines, content, strict=True):
        while inside and container >= 0:
            mass[container] += len(text)
            container = parser.parents[container]
    # Containers are numbered in page order, parents first.
    for name in ("article", "main"):
        regions = []
        for i, own in enumerate(parser.names):
            if own == name and mass[i] > 0 and not any(_within(i, outer, parser.parents) for outer in regions[-1:]):
                regions.append(i)
        if sum(mass[i] for i in regions) >= BULK * mass[0]:
            chosen = [
                i for i, (_, _, container) in enumerate(lines)
                if any(_within(container, region, parser.parents) for region in regions)
            ]
            return "\n\n".join(lines[i][0] for i in chosen)
    inside = np.flatnonzero(content)
    best = lines[inside[0]][2]
    while mass[best] < mass[0]:
        best = parser.parents[best]
    chosen = [
        i for i, (_, _, container) in enumerate(lines)
        if inside[0] - 1 <= i <= inside[-1] and _within(container, best, parser.parents)
    ]
    return "\n\n".join(lines[i][0] for i in chosen)


def _within(container: int, region: int, parents: list[int]) -> bool:
    while container > region:
        container = parents[container]
    return container == region


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text`` (blocks joined by an empty line) and
    ``n_chars``, its code points. One pass without a shuffle."""
    chosen = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in sub_batches(batch, "html"):
                texts = [main_text(html) for html in part.column("html").to_pylist()]
                yield {
                    "page_id": part.column("page_id"),
                    "url": part.column("url"),
                    "text": texts,
                    "n_chars": [len(t) for t in texts],
                }

    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    return map_arrow(chosen, work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
