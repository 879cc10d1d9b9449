"""Main text of web pages: text-to-tag ratios, smoothed and clustered.

Standard-library parser events are cut into lines, one for each block element.
A line's ratio is its characters over its tags; the ratios of a page are
smoothed by a Gaussian, and lines above a threshold (the deviation of the
ratios) form the content cluster. Main text is every region (an outermost article
or main element) and every stretch of the body with a line of the cluster: whole,
with its headings and short lines, but without those of its parts that are menus,
headers, footers, notices, adverts, forms or comments by element,
role or a whole word of its class or id. Headings (h1 to h6) are never such a part, nor are those in an article's own header.
A part by class, role or form that holds most of the page's text, and a region or main heading or all of a form's page, is a wrapper of
the page and counts as inside. A stretch of the body ends at a region or at a part that is no main text; stretches between two
selected ones belong to them, and so do those before and after that are a heading or whole sentences without links.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements, roles and class words whose content is never main text.
OUTSIDE = frozenset("aside button dialog footer form head header iframe menu nav noscript object script select style svg template textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form navigation search".split())
CLASSES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Names of several words that are such parts as a whole.
COMPOUNDS = frozenset("ad-banner ad-container ad-slot ad-wrapper author-box back-to-top comment-form comment-list comments-area comments-section cookie-banner cookie-bar cookie-consent cookie-notice main-menu main-nav main-navigation nav-bar nav-menu newsletter-signup page-footer page-header post-navigation privacy-notice related-articles related-posts share-buttons side-bar site-footer site-header site-menu site-nav site-navigation skip-link social-links social-share sticky-ad top-bar top-nav".split())
#: Parts that stay outside however much they hold.
COMMENTS = frozenset("comment comments comment-form comment-list comments-area comments-section disqus".split())
#: Elements whose kind is told by themselves; a form or header may be a wrapper.
SOFT = frozenset(("form", "header"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS = (".", "!", "?", "\u2026", '"', "\u201d", "'", "\u2019", ")")
REGIONS = frozenset(("article", "main"))
NEVER_OUTSIDE = REGIONS | HEADINGS | frozenset(("html", "body"))
CLOSES_P = BLOCK - {"body", "html", "head"}
SPACE = re.compile(r"\s+")
SIGMA = 1.0


#: Kinds of parts: inside, outside unless it is a wrapper, outside.
INSIDE, MAYBE, NEVER = range(3)


def outside(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    if tag in OUTSIDE:
        return MAYBE if tag in SOFT else NEVER
    if tag in NEVER_OUTSIDE:
        return INSIDE
    kind = INSIDE
    for k, v in attrs:
        if k in ("class", "id") and v:
            words = frozenset(v.lower().split())
            if words & COMMENTS:
                return NEVER
            if words & (CLASSES | COMPOUNDS):
                kind = MAYBE
        elif k == "role" and (v or "").lower() in ROLES:
            kind = MAYBE
        elif k == "hidden" or (k == "aria-hidden" and v == "true"):
            return NEVER
    return kind


class Lines(HTMLParser):
    """Collects lines as (text, tags, number of the region, inside a part that is never main text, plain).

    plain: the line is a heading, or ends as a sentence and holds no link. wrappers: numbers of start tags of parts that count as inside
    though their kind is MAYBE; held tells for each part of that kind how many characters it holds outside
    parts of kind NEVER, and whether a region or an h1 is among them.
    """

    def __init__(self, wrappers: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.wrappers, self.number, self.total = wrappers, 0, 0
        self.parts: list[list] = []  # open parts of kind MAYBE: number, depth in the stack, characters and marks when it began
        self.marks, self.never = 0, 0  # regions and main headings so far; open parts of kind NEVER
        self.of_wrapper: dict[int, tuple[str, int, int]] = {}
        self.links, self.heading, self.linked = 0, False, False
        self.stack: list[tuple[str, int, bool, bool, bool]] = []  # element, its region, outside, text to be skipped, of kind NEVER
        self.open: Counter[str] = Counter()  # elements in the stack
        self.regions = 0
        self.lines: list[tuple[str, int, int, bool]] = []
        self.held: list[str] = []
        self.tags = 0

    @property
    def state(self) -> tuple[int, bool]:
        return self.stack[-1][1:3] if self.stack else (0, False)

    def cut(self) -> None:
        text = SPACE.sub(" ", "".join(self.held)).strip()
        if text:
            plain = self.heading or (not self.linked and text.endswith(ENDS))
            self.lines.append((text, self.tags, *self.state, plain))
            self.total += 0 if self.never else len(text)
        self.held, self.tags, self.heading, self.linked = [], 0, False, bool(self.open["a"])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.held.append(" ")
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        self.number += 1
        if tag in VOID:
            return
        self.heading |= tag in HEADINGS
        self.linked |= tag == "a"
        if tag in CLOSES_P and self.open["p"]:
            self.close_to("p", barrier=("article", "main", "section", "div", "td", "li", "body", "blockquote"))
        elif tag in ("li", "td", "th", "tr", "dd", "dt", "option") and self.stack and self.stack[-1][0] == tag:
            self.cut_stack(len(self.stack) - 1)
        region, out = self.state
        if tag in REGIONS and not out and not region:  # one inside another is part of it
            self.regions += 1
            region = self.regions
        kind = outside(tag, attrs)
        if not self.never and (tag in REGIONS or tag == "h1"):
            self.marks += 1
        if kind == MAYBE and not self.never:
            self.parts.append([self.number, len(self.stack), self.total, self.marks, tag])
            kind = INSIDE if self.number in self.wrappers else kind
        now = out or kind != INSIDE
        if out and region and tag in HEADINGS and self.stack[-1][0] == "header":
            now = False  # a heading in an article's own header
        self.never += kind == NEVER
        # an element inside a line that is no main text leaves the line whole
        skip = bool(self.stack and self.stack[-1][3]) or (now and not out and tag not in BLOCK)
        self.stack.append((tag, region, now, skip, kind == NEVER))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # in HTML a slash does not close

    def close_to(self, tag: str, barrier: tuple = ()) -> None:
        for i in reversed(range(len(self.stack))) if self.open[tag] else ():
            if self.stack[i][0] == tag:
                self.cut_stack(i)
                return
            if self.stack[i][0] in barrier:
                return

    def cut_stack(self, depth: int) -> None:
        for x in self.stack[depth:]:
            self.open[x[0]] -= 1
            self.never -= x[4]
        while self.parts and self.parts[-1][1] >= depth:
            number, _, total, marks, tag = self.parts.pop()
            self.of_wrapper[number] = (tag, self.total - total, self.marks - marks)
        del self.stack[depth:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        if tag == "p":
            self.close_to(tag, barrier=("article", "main", "section", "div", "td", "li", "body"))
        else:
            self.close_to(tag)

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1][3]):
            self.held.append(data)


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel's part that fits is scaled up."""
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(x)), kernel)[r : r + len(x)]
    return np.convolve(x, kernel)[r : r + len(x)] / weight


def read(html: str) -> Lines:
    """A page's lines; parts that wrap the page count as inside."""
    p = Lines()
    for wrappers in (False, True):
        p.feed(html)
        p.close()
        p.cut()
        p.cut_stack(0)
        found = frozenset(n for n, (tag, chars, marks) in p.of_wrapper.items() if 2 * chars > p.total and (marks or tag == "form"))
        if wrappers or not found:
            return p
        p = Lines(found)
    return p


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The lines of the regions and body stretches that the cluster selects, joined by \\n; '' if there are none."""
    if not html:
        return ""
    p = read(html)
    if not p.lines:
        return ""
    ratio = smoothed(np.array([len(t) / (1 + n) for t, n, *_ in p.lines]), sigma)
    content = ratio >= ratio.std()
    parts: list[int] = []  # of each line: 0 outside, a region's number, or less than 0 for a stretch of the body
    stretch, ended = 0, True
    for _, _, region, out, _ in p.lines:
        if out or region:
            parts.append(0 if out else region)
        else:
            stretch -= ended
            parts.append(stretch)
        ended = bool(out or region)
    # if no line of the cluster may count, all do
    chosen = {k for k, c in zip(parts, content, strict=True) if c and k} or {k for k in parts if k}
    body = [k for k in chosen if k < 0]
    if body:  # what stands between two chosen stretches of the body stays
        low, high = min(body), max(body)
        plain: dict[int, bool] = {}
        for k, (*_, x) in zip(parts, p.lines, strict=True):
            if k < 0:
                plain[k] = plain.get(k, True) and x
        while plain.get(low - 1):
            low -= 1
        while plain.get(high + 1):
            high += 1
        chosen.update(range(low, high + 1))
    return "\n".join(t for (t, *_), k in zip(p.lines, parts, strict=True) if k in chosen)


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """``keep`` columns and text for every row; '' for a null or empty page, or one without main text."""
    return map_texts(pages, keep, html, pa.schema([("text", pa.string())]), lambda: lambda texts: [[main_text(t) for t in texts]])
