"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams events; each block element's text is a
line with its text length, tags and link text.  Scripts and the like never
give text.  Elements that stand beside an article by their tag, or by a whole
class, id or role token (menus, headers, footers, sidebars, notices, forms,
comments), are marked as they open; at the end each marked element is left out
unless it holds most of the page's text outside links.  Over the remaining
lines in page order the text-to-tag ratios are smoothed by a Gaussian and split
by threshold clustering (two means); the lines of the upper cluster are seeds.
The content region is the smallest main element that holds nearly all of the
seeds' text, else half of it, else such an article, else the smallest container
with nearly all.  Its lines are the result, without those that are links only
outside of runs of text (headings stay).

Defined cases: a null or empty html gives an empty text; unclosed and stray
tags are tolerated, a comment or tag that the page never closes is no text; a
page without markup is one block; repeated rows each keep a row; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import needed

BLOCKS = frozenset((
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset((
    "audio button canvas head iframe input noscript object script select style svg template textarea title video").split())
MARKED = frozenset("aside dialog footer form header menu nav".split())
INLINE = frozenset("a b em font i small span strong u".split())
CONTAINERS = frozenset("article main section div td body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role tokens that name something beside the article, and
# words that may stand next to them in one token (sidebar-left, nav_menu, commentList).
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
BESIDE = COMMENTS | frozenset((
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs complementary consent contentinfo "
    "cookie cookies footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay "
    "pager pagination popup promo promoted promotion recommended related search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe toc toolbar widget").split())
NEUTRAL = frozenset((
    "area articles bar block bottom box col column container fixed global group inner item items left links list main outer page panel posts "
    "primary right secondary section site stories sticky text top wrap wrapper").split())
MOST, NEARLY_ALL, HALF = 0.5, 0.9, 0.5         # shares of the text outside links
_WORD = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TAG = re.compile(r"<[A-Za-z/!?]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# An open element of the first kind ends when one of the second opens.
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"},
          "option": {"option"}, "head": {"body"}}
SIGMA, RADIUS = 1.0, 3
_KERNEL = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)


class Blocks(HTMLParser):
    """Folds parser events into blocks (text, tags, link characters, containers, marked elements, own tag)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.open, self.text, self.tags, self.linked, self.links = [], [], [], 0, 0, 0
        self.dropped, self.in_article, self.n = 0, 0, 0
        self.kind, self.marks = {}, {}

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            while self.open and tag in CLOSES.get(self.open[-1][0], ()):
                self.pop()
            if self.open and self.open[-1][0] in INLINE:               # inline elements left open end with their block
                self.open = [e for e in self.open if e[0] not in INLINE]
                self.links, self.dropped = 0, sum(e[1] for e in self.open)
                while self.open and tag in CLOSES.get(self.open[-1][0], ()):
                    self.pop()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        drop = tag in DROPPED or hidden(attrs)
        self.n += 1
        if tag in CONTAINERS:
            self.kind[self.n] = tag
        if not drop and (why := self.beside(tag, attrs)):
            self.marks[self.n] = why
        self.open.append((tag, drop, self.n))
        self.dropped += drop
        self.links += tag == "a"
        self.in_article += tag in ("article", "main")

    def beside(self, tag, attrs) -> str:
        """Why an element is marked: by its ``tag`` (a form: ``beside``), as ``comments`` or ``beside`` by a token; empty: it is not."""
        if tag in ("html", "body", "main"):
            return ""
        found = "" if tag not in MARKED or tag == "header" and self.in_article else "beside" if tag == "form" else "tag"
        for name, value in attrs:
            if value and name in ("class", "id", "role"):
                for token in value.split():
                    words = set(_WORD.findall(_CAMEL.sub(" ", token).lower()))
                    named = words & BESIDE
                    if named == {"header"} and (self.in_article or tag == "article"):
                        continue
                    if named and words <= BESIDE | NEUTRAL | {w for w in words if w.isdigit()}:
                        if named & COMMENTS:
                            return "comments"
                        found = found or "beside"
        return found

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag not in BLOCKS:
            self.tags += 1
            if tag == "br":
                self.text.append(" ")
            elif tag in BLOCKS:
                self.flush()
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if any(e[0] == tag for e in reversed(self.open)):
            while self.pop() != tag:
                pass

    def pop(self):
        tag, drop, _ = self.open.pop()
        self.dropped -= drop
        self.links -= tag == "a" and self.links > 0
        self.in_article -= tag in ("article", "main")
        return tag

    def handle_data(self, data):
        if not self.dropped:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text:
            own = next((t for t, _, _ in reversed(self.open) if t in BLOCKS), "")
            self.blocks.append((text, self.tags, min(self.linked, len(text)), tuple(n for t, _, n in self.open if t in CONTAINERS),
                                tuple(n for _, _, n in self.open if n in self.marks), own))
        self.text, self.tags, self.linked = [], 0, 0

    def kept(self):
        """The blocks outside of marked elements; one that holds most of the page's text outside links counts as unmarked.

        Comments, and elements whose tag says what they are, count as unmarked only if no text stands outside of them.
        """
        mass: dict[int, int] = {}
        total = 0
        for b in self.blocks:
            own = len(b[0]) - b[2]
            total += own
            for n in b[4]:
                mass[n] = mass.get(n, 0) + own
        gone = {n for n, why in self.marks.items() if mass.get(n, 0) < (MOST if why == "beside" else 1.0) * total or not mass.get(n)}
        return [b for b in self.blocks if not gone.intersection(b[4])]


def hidden(attrs) -> bool:
    return any(name == "hidden" or name == "aria-hidden" and value == "true" or value and name == "style" and _HIDDEN.search(value) for name, value in attrs)


def closed(html: str) -> str:
    """The page without a comment or tag that is open at its end."""
    at = html.rfind("<!--")
    if at >= 0 and html.find("-->", at + 4) < 0:
        html = html[:at]
    at = html.rfind("<")
    if at >= 0 and _TAG.match(html, at) and html.find(">", at) < 0:
        html = html[:at]
    return html


def seeds(ratio: np.ndarray) -> np.ndarray:
    """Lines of the upper cluster of the smoothed text-to-tag ratios."""
    padded = np.pad(ratio, RADIUS, mode="edge")
    smooth = np.convolve(padded, _KERNEL / _KERNEL.sum(), "valid")
    low, high = smooth.min(), smooth.max()
    if high <= 1.5 * low or len(ratio) < 3:               # one cluster
        return np.ones(len(ratio), bool)
    for _ in range(20):
        upper = smooth > (low + high) / 2
        new = smooth[~upper].mean(), smooth[upper].mean()
        if math.isclose(new[0], low) and math.isclose(new[1], high):
            break
        low, high = new
    return smooth > (low + high) / 2


def main_text(html: str) -> str:
    """The page's main text: blocks joined by an empty line."""
    if not html:
        return ""
    p = Blocks()
    p.feed(closed(html))
    p.close()
    p.flush()
    blocks = p.kept()
    if not blocks:
        return ""
    size = np.array([len(b[0]) for b in blocks], float)
    plain = size - np.array([b[2] for b in blocks], float)
    chosen = seeds(np.log1p(plain / (np.array([b[1] for b in blocks]) + 1.0)))
    region = content_region(blocks, plain, chosen, p.kind)
    inside = [k for k, b in enumerate(blocks) if not region or region in b[3]]
    linked = [len(blocks) > 1 and size[k] - plain[k] >= 0.8 * size[k] for k in inside]
    text_at = [i for i, only in enumerate(linked) if not only]
    out = []
    for i, (k, only) in enumerate(zip(inside, linked)):
        # a block of links only stays as a heading, or alone between blocks of text
        alone = text_at and text_at[0] < i < text_at[-1] and not linked[i - 1] and not linked[i + 1]
        if not only or alone or blocks[k][5] in HEADINGS:
            out.append(blocks[k][0])
    return "\n\n".join(out)


def content_region(blocks, plain: np.ndarray, chosen: np.ndarray, kind: dict[int, str]) -> int:
    """Number of the container that holds the seeds' text; 0: the whole page."""
    mass: dict[int, float] = {}
    for b, s, c in zip(blocks, plain, chosen):
        for n in b[3] if c else ():
            mass[n] = mass.get(n, 0.0) + s
    total = float(plain[chosen].sum())
    for tag in ("main", "article"):
        for share in (NEARLY_ALL, HALF):
            if found := [n for n, m in mass.items() if kind[n] == tag and m >= share * total]:
                return max(found)                      # the innermost: numbers rise as elements open
    near = [n for n, m in mass.items() if m >= NEARLY_ALL * total]
    return max((n for n in near if any(b[3][-1] != n for b in blocks if n in b[3])), default=max(near, default=0))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    t = needed(pages, "page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string")
    return t.withColumn("n_chars", F.char_length("text").cast("bigint"))
