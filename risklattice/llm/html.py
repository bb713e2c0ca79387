"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters.

The standard library's parser streams through the markup once and yields text blocks ("lines"), each with its length,
its number of tags and the part of it that is link text. Blocks inside page furniture (menus, adverts, forms, ...) are
never content. The ratio text / tags of the remaining blocks is smoothed over neighbours; blocks above one standard
deviation of the smoothed ratios form clusters, and the regions (article elements, or else the parent elements) that
hold a cluster are the content, whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The elements of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video".split())
FURNITURE = frozenset("nav footer aside form button select textarea label fieldset menu dialog datalist".split())
BLOCKS = frozenset("address article aside blockquote body caption dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
REGIONS = frozenset("article main section div body td".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
NOISE = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar toolbar comment comments disqus respond replies reply cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe signup login social share sharing related recommended widget pagination pager skip search form".split()
)
SIGMA = 1.0  # of the Gaussian, in blocks


@dataclass
class Block:
    region: int  # the article it lies in, or 0
    parent: int  # nearest enclosing region element
    tags: int = 0
    linked: int = 0
    parts: list[str] = field(default_factory=list)
    text: str = ""


def _is_noise(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not inside):
        return True
    if tag in ("html", "body", "article", "main"):
        return any(k in ("class", "id") and v and {"comment", "comments", "reply"} & set(re.split(r"[^a-z0-9]+", v.lower())) for k, v in attrs) and tag == "article"
    for k, v in attrs:
        if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "role" and v in ROLES):
            return True
        if k in ("class", "id") and v and NOISE.intersection(re.split(r"[^a-z0-9]+", v.lower())) - ({"header"} if inside else set()):
            return True
        if k == "style" and v and re.search(r"display\s*:\s*none", v, re.I):
            return True
    return False


class BlockParser(HTMLParser):
    """Collects the blocks of one page outside hidden elements and furniture."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, int, bool]] = []  # tag, serial, noise
        self.depth: dict[str, int] = {}
        self.noise = self.links = self.serial = 0
        self.articles: list[int] = []
        self.parents: list[int] = [0]
        self.now = Block(0, 0)

    def _flush(self) -> None:
        text = " ".join("".join(self.now.parts).split())
        if text:
            self.now.text, self.now.parts = text, []
            self.blocks.append(self.now)
        self.now = Block(self.articles[0] if self.articles else 0, self.parents[-1])

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and self.depth.get("p") and tag not in ("html", "body"):
            self._close("p")  # a block ends an open paragraph
        if tag == "li" and self.depth.get("li"):
            inner = next((t for t, _, _ in reversed(self.open) if t in ("ul", "ol", "li", "div")), "")
            if inner == "li":
                self._close("li")
        if tag in BLOCKS:
            self._flush()
        if not self.noise:
            self.now.tags += 1
            if tag in ("br", "td", "th"):
                self.now.parts.append(" ")
        if tag in VOID:
            return
        noise = tag in HIDDEN or _is_noise(tag, attrs, bool(self.articles))
        self.serial += 1
        self.open.append((tag, self.serial, noise))
        self.depth[tag] = self.depth.get(tag, 0) + 1
        self.noise += noise
        self.links += tag == "a"
        if tag in ("article", "main") and not self.noise:
            self.articles.append(self.serial)
        if tag in REGIONS:
            self.parents.append(self.serial)
        if tag in BLOCKS:
            self._flush()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str) -> None:
        while self.open:
            t, serial, noise = self.open.pop()
            if t in BLOCKS:
                self._flush()
            self.depth[t] -= 1
            self.noise -= noise
            self.links -= t == "a"
            if self.articles and self.articles[-1] == serial:
                self.articles.pop()
            if len(self.parents) > 1 and self.parents[-1] == serial:
                self.parents.pop()
            if t in BLOCKS:
                self._flush()
            if t == tag:
                return

    def handle_endtag(self, tag):
        if not self.noise:
            self.now.tags += 1
        if self.depth.get(tag):
            self._close(tag)

    def handle_data(self, data):
        if self.noise:
            return
        self.now.parts.append(data)
        if self.links:
            self.now.linked += len(data)


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing with the kernel cut at three sigma and renormalised at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi])) / sum(weights))
    return out


def content_blocks(html: str | None) -> list[str]:
    """Content blocks of one page in page order; none for a null, empty or textless page."""
    if not html:
        return []
    parser = BlockParser()
    parser.feed(html)
    parser.close()
    parser._flush()
    blocks = parser.blocks
    if not blocks:
        return []
    ratio = smoothed([(len(b.text) - min(b.linked, len(b.text))) / max(1, b.tags) for b in blocks])
    mean = sum(ratio) / len(ratio)
    spread = math.sqrt(sum((x - mean) ** 2 for x in ratio) / len(ratio))
    high = [x >= min(spread, max(ratio)) and x > 0 for x in ratio]
    articles = {b.region for b, h in zip(blocks, high) if h and b.region}
    if articles:
        return [b.text for b in blocks if b.region in articles]
    parents = {b.parent for b, h in zip(blocks, high) if h}
    return [b.text for b in blocks if b.parent in parents and b.linked <= len(b.text) / 2]


def main_text(html: Column | str) -> Column:
    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series(["\n".join(content_blocks(p)) for p in pages], dtype=object)

    return extracted(html)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page.

    Null, empty and textless pages give an empty text. Null ids or urls and repeated rows are kept, a row each; other
    columns are not read. Broken markup never fails: unclosed elements end with what encloses them. No shuffle.
    """
    out = pages.select("page_id", "url", main_text(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
