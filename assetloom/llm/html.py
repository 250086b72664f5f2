"""Main text of web pages from parser events, text-to-tag ratios and clustering of smoothed lines.

The standard-library parser is fed each page once and its events build lines: a line is the text of one block, with the
number of tags in it and the containers around it. The ratio of text to tags is smoothed by a Gaussian over
neighbouring lines and split into two clusters; the high one marks content. The content regions are the article-like
containers that hold marked lines; on a page without such a container, every marked line is content, with what stands
between marked lines. Elements that are something else by their tag, role or style (navigation, form, hidden, ...) never
count. A class or id that says so is a claim, which the clusters can refute: if its element holds most of the marked
text, it is the layout that the name speaks of. Comments are believed as long as marked text is left outside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element and attribute vocabulary.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
            "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody tfoot thead title tr ul".split())
DROPPED = set("script style noscript template svg math iframe object canvas audio video head title nav footer aside form button select textarea input menu dialog".split())
REGION = {"article", "main"}
CONTAINER = {"article", "main", "section", "div", "td", "body", "html", "center", "blockquote", "table"}
UNWANTED = set("ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
               "footer cookie cookies consent notice notices alert popup modal overlay social share sharing comment comments disqus reply replies respond related "
               "recommended newsletter subscribe subscription signup login widget toolbar pagination pager copyright masthead skip".split())
COMMENTS = {"comment", "comments", "disqus", "reply", "replies", "respond"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
LAYOUT = {"has", "with", "without", "no", "is", "layout", "page", "js", "wp"}
#: Words for the main text; and words that say nothing of their own in a compound name such as ``ad-box`` or ``left_sidebar``.
MAIN = set("main content article post entry story body text".split())
NEUTRAL = MAIN | set("a the site page global primary secondary left right top bottom upper lower inner outer wrap wrapper container holder box block area section zone slot unit panel column col row bar "
                     "list item items link links button buttons btn icon icons header head title form field message msg policy thread posts articles stories news sticky fixed small large big mobile desktop".split())
#: What an article-like element itself may say it is, if not the article.
UNWANTED_REGION = {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "comment", "comments", "reply", "related", "recommended"}
#: Reach and width of the smoothing, in lines.
REACH, SIGMA = 2, 1.0
#: Part of the marked text, and characters of it, from which an element is not what its name claims.
MOST, LEAST_CHARS = 0.5, 250
#: Part of a line's text in links from which an unmarked line is a menu, where no article-like element is.
LINKS = 0.6
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_WORD = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")
_CUT_TAG = re.compile(r"<[/!?A-Za-z][^<>]*\Z")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _claims(value: str, words: set[str]) -> set[str]:
    """Unwanted words of a class or id whose whole names say nothing else.

    ``share-price`` is about a price; names like ``has-sidebar`` speak of the layout around, as does a compound name
    beside a name for the main text (``main sidebar-right``).
    """
    names = [[x.lower() for x in _WORD.findall(name)] for name in value.split()]
    main = any(len(parts) == 1 and parts[0] in MAIN for parts in names)
    found: set[str] = set()
    for parts in names:
        hit = words.intersection(parts)
        if hit and parts[0] not in LAYOUT and not (main and len(parts) > 1) \
                and all(x in UNWANTED or x in NEUTRAL or any(c.isdigit() for c in x) for x in parts):
            found |= hit
    return found


def _unwanted(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, set[str]]:
    """Whether an element is certainly not content, and the unwanted words that its class and id claim."""
    if tag in ("body", "html"):
        return False, set()
    words = UNWANTED_REGION if tag in REGION else UNWANTED
    sure, claimed = False, set()
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            sure = True
        elif value and name in ("class", "id"):
            claimed |= _claims(value, words)
        elif value:
            sure |= (name == "role" and value.lower() in ROLES) or (name == "style" and bool(_HIDDEN.search(value.lower())))
    return sure, claimed


class _Lines(HTMLParser):
    """Lines of one page: ``(text, tags, link characters, containers, claims, heading)``, in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, tuple[int, ...], tuple[int, ...], bool]] = []
        self.stack: list[tuple[str, bool, int, bool]] = []  # tag, drops its content, container number, is a claim
        self.regions: set[int] = set()
        self.claims: dict[int, bool] = {}  # whether it claims comments
        self.number = 0
        self.drops = 0
        self.links = 0
        self._begin()

    def _begin(self):
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.linked, tuple(c for _, _, c, _ in self.stack if c), tuple(c for _, _, c, claim in self.stack if claim),
                               any(t in HEADINGS for t, *_ in self.stack)))
        self._begin()

    def _pop(self):
        tag, drop, *_ = self.stack.pop()
        self.drops -= drop
        self.links -= tag == "a"

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        elif tag in ("td", "th"):
            self.parts.append(" ")
        self.tags += 1
        unwanted, claimed = _unwanted(tag, attrs)
        if tag in REGION and not (unwanted or claimed):  # an article does not lie in a menu: the menu was left open
            while self.drops and self.stack[-1][0] not in ("article", "main", "body", "html"):
                self._pop()
        if tag in VOID:
            return
        if tag == "p":  # a paragraph ends the one before it
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == "p":
                    while len(self.stack) > k:
                        self._pop()
                    break
                if self.stack[k][0] in CONTAINER or self.stack[k][0] in DROPPED:
                    break
        inside = any(t in REGION for t, *_ in self.stack)
        drop = tag in DROPPED or unwanted or (tag == "header" and not inside) or (bool(claimed) and tag not in BLOCK and tag != "td")
        number = 0
        if tag in CONTAINER or (claimed and not drop):
            self.number += 1
            number = self.number
            if tag in REGION and not drop and not claimed:
                self.regions.add(number)
            if claimed and not drop:
                self.claims[number] = not COMMENTS.isdisjoint(claimed)
        self.stack.append((tag, drop, number, bool(claimed) and not drop))
        self.drops += drop
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        elif tag in ("td", "th"):
            self.parts.append(" ")
        self.tags += 1
        if any(t == tag for t, *_ in self.stack):
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        if not self.drops:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def _content_lines(lines) -> np.ndarray:
    """Marks of the lines in the upper of two clusters of the smoothed text-to-tag ratios (two means, in one dimension)."""
    ratio = np.array([len(x[0]) / max(1, x[1]) for x in lines])
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel, "full")[REACH:REACH + len(ratio)]
    smooth = np.convolve(ratio, kernel, "full")[REACH:REACH + len(ratio)] / weight
    low, high = smooth.min(), smooth.max()
    for _ in range(50):
        cut = (low + high) / 2
        above = smooth >= cut
        new = (smooth[~above].mean() if (~above).any() else low, smooth[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (smooth >= (low + high) / 2) | (ratio >= high)  # a long line between short ones is as good as those of the upper cluster


def _believed(lines, parser: _Lines) -> set[int]:
    """Claims that the clusters do not refute: judged among the lines of article-like elements, if there are any."""
    within = [not parser.regions.isdisjoint(x[3]) for x in lines]
    if not any(within):
        within = [True] * len(lines)
    held, total = dict.fromkeys(parser.claims, 0.0), 0.0
    for line, m, here in zip(lines, _content_lines(lines), within, strict=True):
        if m and here:
            total += len(line[0])
            for c in line[4]:
                held[c] += len(line[0])
    return {c for c, comments in parser.claims.items() if held[c] < LEAST_CHARS or held[c] <= (total - LEAST_CHARS if comments else MOST * total)}


def main_text(html: str | None) -> str:
    """Text of the content regions: blocks in page order, joined by newlines."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(_CUT_TAG.sub("", html))  # a tag cut off at the end is not text
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    gone = _believed(lines, parser)
    lines = [x for x in lines if gone.isdisjoint(x[4])]
    if not lines:
        return ""
    marked = _content_lines(lines)
    regions = {c for x, m in zip(lines, marked, strict=True) if m for c in x[3] if c in parser.regions}
    if regions:
        return "\n".join(x[0] for x in lines if not regions.isdisjoint(x[3]))
    content = np.flatnonzero(marked)
    # unmarked lines count between marked ones, and as headings of the first, unless they are menus
    first, last = content[0], content[-1]
    while first and lines[first - 1][5]:
        first -= 1
    menu = [x[2] >= LINKS * len(x[0]) for x in lines]
    return "\n".join(x[0] for i, x in enumerate(lines) if marked[i] or (first <= i < last and not menu[i]))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``row`` (all columns but the markup) and ``text`` for every page.

    One pass, no shuffle. Null or empty markup gives an empty text, as does a page of which nothing is content. Markup
    that is cut off or badly nested is read as far as it goes. Repeated rows give equal texts; long pages are read whole.
    """
    rest = [c for c in pages.columns if c != html]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{html}`").cast("string").alias("html"))
    return rows.mapInArrow(_extract, f"row {rows.schema['row'].dataType.simpleString()}, text string")
