"""Main text of web pages from flat text blocks.

A page is cut into blocks at block-level tags. Each block has its word count and link density, those of the blocks beside it,
and the kind of container it lies in, where a heading in none is a kind of its own. What lies in an aside by its tag, role, class or id is
no text; of all other blocks a decision tree, grown on the small labelled table below, tells text from the rest.

Defined results: null, empty and malformed html give an empty text or the blocks that can be read; white space inside a block is one
space; blocks are joined by one line feed in page order; repeated rows give repeated rows; a page's size is bounded by its row
only; columns besides id, url and html are not read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
UNSEEN = {"script", "style", "head", "title", "noscript", "template", "svg", "iframe", "object", "textarea", "select", "canvas", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ASIDE = {"nav", "footer", "header", "aside", "form", "button", "dialog", "menu", "fieldset"}
CENTRE = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
# a class name or id names an aside if its parts are words of these and of PLACE_WORDS: site-header, but not has-sidebar
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion nav navbar navigation menu sidebar "
    "sidebars footer header masthead topbar cookie cookies consent gdpr notice notices notification alert comment comments "
    "disqus reply replies respond discussion share sharing social related recommended breadcrumb breadcrumbs pagination pager "
    "popup modal overlay newsletter subscribe subscription signup login search widget widgets toolbar disclaimer copyright "
    "legal hidden skip tags paywall".split()
)
PLACE_WORDS = set(
    "site page main top bottom left right primary secondary global inner outer wrap wrapper container box block area slot unit item items "
    "list links section region body inline sticky fixed bar form post article entry user the my".split()
)
# words for the kind of a text: they make no aside of a paragraph, heading or item
KIND_WORDS = set("legal disclaimer copyright notice notices notification notifications alert consent discussion share related search tags header".split())
TEXT_TAGS = HEADINGS | {"p", "li", "pre", "blockquote", "dt", "dd", "figcaption", "caption", "td"}
# what readers write, which may be longer than the text
THREAD_WORDS = set("comment comments disqus reply replies respond discussion".split())
# an article of such a name is no text of the page
CARD_WORDS = THREAD_WORDS | set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion related recommended".split())
HARD, SOFT = -2, -1  # an aside of any size; one that is none if most of the page's words lie in it
ENDS_P = BLOCK - {"body", "head", "html", "caption", "dd", "dt", "figcaption", "legend", "li", "optgroup", "option", "summary", "tbody", "td", "tfoot", "th", "thead", "title", "tr"}

# Labelled blocks: words, link density; words and link density of the block before; of the block after; container (0 none,
# 0.5 a heading in none, 1 article or main); is it text.
# Blocks of pages 0 to 13 of the small table of pages, labelled by their place in the page's source, with class names taken out and articles
# turned into plain elements: the advert, the heading, the first, the middle and the last paragraph of each.
PAGE_BLOCKS = [
    (10, 0.0, 1, 1.0, 9, 0.0, 0, 0),
    (10, 0.0, 107, 0.0, 10, 0.0, 0, 1),
    (10, 0.0, 12, 0.0, 46, 0.0, 0.5, 1),
    (10, 0.0, 7, 0.0, 13, 0.0, 0.5, 1),
    (10, 0.0, 9, 0.0, 32, 0.0, 0.5, 1),
    (11, 0.0, 1, 1.0, 2, 0.0, 0, 0),
    (11, 0.0, 4, 0.0, 23, 0.0, 0.5, 1),
    (11, 0.0, 5, 0.0, 14, 0.0, 0.5, 1),
    (11, 0.0, 8, 0.0, 41, 0.0, 0.5, 1),
    (12, 0.0, 1, 1.0, 10, 0.0, 0, 0),
    (12, 0.0, 1, 1.0, 8, 0.0, 0, 0),
    (13, 0.0, 10, 0.0, 45, 0.0, 0, 1),
    (13, 0.0, 33, 0.0, 9, 0.0, 0, 1),
    (13, 0.0, 6, 0.0, 68, 0.0, 0, 1),
    (14, 0.0, 11, 0.0, 32, 0.0, 0, 1),
    (14, 0.0, 17, 0.0, 22, 0.0, 0, 1),
    (14, 0.0, 8, 0.0, 35, 0.0, 0.5, 1),
    (143, 0.0, 49, 0.0, 11, 0.0, 0, 1),
    (152, 0.0, 26, 0.0, 6, 0.0, 0, 1),
    (17, 0.0, 35, 0.0, 49, 0.0, 0, 1),
    (17, 0.0, 83, 0.0, 14, 0.0, 0, 1),
    (18, 0.0, 17, 0.0, 70, 0.0, 0, 1),
    (2, 0.0, 11, 0.0, 2, 0.0, 0.5, 1),
    (2, 0.0, 2, 0.0, 32, 0.0, 0, 1),
    (20, 0.0, 4, 0.0, 222, 0.0, 0, 1),
    (23, 0.0, 11, 0.0, 58, 0.0, 0, 1),
    (26, 0.0, 6, 0.0, 102, 0.0, 0, 1),
    (27, 0.0, 8, 0.0, 31, 0.0, 0, 1),
    (31, 0.0, 5, 0.0, 1, 0.0, 0, 1),
    (32, 0.0, 10, 0.0, 21, 0.0, 0, 1),
    (35, 0.0, 14, 0.0, 17, 0.0, 0, 1),
    (4, 0.0, 1, 1.0, 11, 0.0, 0, 0),
    (4, 0.0, 4, 0.0, 19, 0.0, 0, 1),
    (4, 0.0, 5, 0.0, 12, 0.0, 0, 1),
    (4, 0.0, 7, 0.0, 4, 0.0, 0.5, 1),
    (41, 0.0, 11, 0.0, 17, 0.0, 0, 1),
    (43, 0.0, 3, 0.0, 153, 0.0, 0, 1),
    (45, 0.0, 13, 0.0, 9, 0.0, 0, 1),
    (46, 0.0, 10, 0.0, 10, 0.0, 0, 1),
    (46, 0.0, 76, 0.0, 8, 0.0, 0, 1),
    (5, 0.0, 1, 1.0, 11, 0.0, 0, 0),
    (5, 0.0, 41, 0.0, 11, 0.0, 0, 1),
    (5, 0.0, 9, 0.0, 15, 0.0, 0, 1),
    (50, 0.0, 63, 0.0, 10, 0.0, 0, 1),
    (58, 0.0, 23, 0.0, 15, 0.0, 0, 1),
    (6, 0.0, 1, 1.0, 8, 0.0, 0, 0),
    (6, 0.0, 8, 0.0, 13, 0.0, 0.5, 1),
    (66, 0.0, 21, 0.0, 40, 0.0, 0, 1),
    (69, 0.0, 35, 0.0, 7, 0.0, 0, 1),
    (7, 0.0, 1, 1.0, 10, 0.0, 0, 0),
    (7, 0.0, 1, 1.0, 4, 0.0, 0, 0),
    (7, 0.0, 7, 0.0, 22, 0.0, 0, 1),
    (7, 0.0, 8, 0.0, 7, 0.0, 0.5, 1),
    (8, 0.0, 1, 1.0, 11, 0.0, 0, 0),
    (8, 0.0, 1, 1.0, 14, 0.0, 0, 0),
    (8, 0.0, 1, 1.0, 6, 0.0, 0, 0),
    (8, 0.0, 1, 1.0, 7, 0.0, 0, 0),
    (8, 0.0, 12, 0.0, 8, 0.0, 0.5, 1),
    (8, 0.0, 6, 0.0, 8, 0.0, 0.5, 1),
    (8, 0.0, 8, 0.0, 17, 0.0, 0, 1),
    (8, 0.0, 8, 0.0, 27, 0.0, 0, 1),
    (9, 0.0, 1, 1.0, 10, 0.0, 0, 0),
    (9, 0.0, 10, 0.0, 9, 0.0, 0.5, 1),
    (9, 0.0, 29, 0.0, 13, 0.0, 0, 1),
    (9, 0.0, 31, 0.0, 13, 0.0, 0, 1),
    (9, 0.0, 6, 0.0, 11, 0.0, 0, 1),
    (9, 0.0, 9, 0.0, 6, 0.0, 0, 1),
]
# Blocks written by hand: what other pages have inside and outside article and main.
WRITTEN_BLOCKS = [
    (80, 0.0, 9, 0.0, 60, 0.0, 1, 1),
    (11, 0.0, 5, 0.0, 90, 0.0, 1, 1),
    (3, 0.0, 90, 0.0, 5, 0.0, 1, 1),
    (1, 0.0, 60, 0.0, 40, 0.0, 1, 1),
    (2, 0.0, 70, 0.0, 12, 0.0, 1, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 1, 1),
    (200, 0.1, 100, 0.0, 20, 0.2, 1, 1),
    (40, 0.3, 60, 0.0, 70, 0.0, 1, 1),
    (25, 0.5, 60, 0.0, 70, 0.0, 1, 1),
    (6, 0.0, 2, 1.0, 50, 0.0, 1, 1),
    (5, 0.0, 6, 0.0, 3, 0.0, 1, 1),
    (70, 0.0, 10, 0.0, 90, 0.0, 1, 1),
    (20, 0.0, 1, 0.0, 30, 0.0, 1, 1),
    (10, 0.0, 45, 0.0, 15, 0.0, 1, 1),
    (12, 0.0, 3, 1.0, 12, 0.0, 1, 1),
    (90, 0.0, 12, 0.0, 14, 0.0, 1, 1),
    (4, 0.0, 7, 0.0, 8, 0.0, 1, 1),
    (7, 0.0, 4, 0.0, 7, 0.0, 1, 1),
    (16, 0.0, 16, 0.0, 3, 1.0, 1, 1),
    (150, 0.0, 4, 0.0, 12, 0.0, 1, 1),
    (5, 0.0, 30, 0.0, 2, 0.0, 1, 1),
    (1, 0.0, 2, 0.0, 1, 0.0, 1, 1),
    (30, 0.05, 25, 0.0, 2, 0.5, 1, 1),
    (6, 0.0, 50, 0.0, 5, 1.0, 1, 1),
    (3, 0.0, 20, 0.0, 1, 1.0, 1, 1),
    (9, 0.1, 8, 0.0, 12, 1.0, 1, 1),
    (1, 0.0, 1, 0.0, 3, 1.0, 1, 1),
    (8, 1.0, 90, 0.0, 6, 1.0, 1, 0),
    (4, 1.0, 4, 1.0, 5, 1.0, 1, 0),
    (2, 1.0, 60, 0.0, 12, 0.0, 1, 0),
    (12, 0.9, 8, 1.0, 7, 1.0, 1, 0),
    (90, 0.0, 8, 0.0, 70, 0.0, 0, 1),
    (60, 0.0, 1, 0.0, 40, 0.0, 0, 1),
    (75, 0.0, 2, 1.0, 10, 0.0, 0, 1),
    (110, 0.0, 3, 0.0, 2, 1.0, 0, 1),
    (40, 0.1, 4, 0.0, 25, 0.0, 0, 1),
    (24, 0.0, 10, 0.0, 12, 0.0, 0, 1),
    (60, 0.1, 90, 0.0, 3, 1.0, 0, 1),
    (45, 0.0, 2, 1.0, 50, 0.0, 0, 1),
    (30, 0.2, 40, 0.0, 35, 0.0, 0, 1),
    (18, 0.0, 45, 0.0, 60, 0.0, 0, 1),
    (20, 0.0, 60, 0.0, 4, 0.0, 0, 1),
    (8, 0.0, 40, 0.0, 60, 0.0, 0, 1),
    (7, 0.0, 3, 1.0, 80, 0.0, 0, 1),
    (5, 0.0, 70, 0.0, 50, 0.0, 0, 1),
    (6, 0.0, 2, 1.0, 3, 1.0, 0, 0),
    (1, 0.0, 0, 0.0, 60, 0.0, 0, 0),
    (1, 0.0, 0, 0.0, 90, 0.0, 0, 0),
    (4, 0.0, 1, 1.0, 2, 1.0, 0, 0),
    (30, 0.8, 4, 1.0, 6, 1.0, 0, 0),
    (12, 0.7, 60, 0.0, 5, 1.0, 0, 0),
    (2, 1.0, 2, 1.0, 70, 0.0, 0, 0),
    (10, 1.0, 90, 0.0, 12, 1.0, 0, 0),
    (50, 0.9, 20, 0.8, 20, 1.0, 0, 0),
    (8, 0.0, 3, 1.0, 1, 0.0, 0, 0),
    # nothing, a short block, a long one or a link before, and each of them after: one word and eight, paragraphs and headings
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 1),
    (1, 0.0, 0, 0.0, 9, 0.0, 0, 1),
    (1, 0.0, 0, 0.0, 40, 0.0, 0, 0),
    (1, 0.0, 0, 0.0, 3, 1.0, 0, 0),
    (1, 0.0, 9, 0.0, 0, 0.0, 0, 1),
    (1, 0.0, 9, 0.0, 9, 0.0, 0, 1),
    (1, 0.0, 9, 0.0, 40, 0.0, 0, 1),
    (1, 0.0, 9, 0.0, 3, 1.0, 0, 1),
    (1, 0.0, 40, 0.0, 0, 0.0, 0, 1),
    (1, 0.0, 40, 0.0, 9, 0.0, 0, 1),
    (1, 0.0, 40, 0.0, 40, 0.0, 0, 1),
    (1, 0.0, 40, 0.0, 3, 1.0, 0, 1),
    (1, 0.0, 3, 1.0, 0, 0.0, 0, 0),
    (1, 0.0, 3, 1.0, 9, 0.0, 0, 0),
    (1, 0.0, 3, 1.0, 40, 0.0, 0, 1),
    (1, 0.0, 3, 1.0, 3, 1.0, 0, 0),
    (8, 0.0, 0, 0.0, 0, 0.0, 0, 1),
    (8, 0.0, 0, 0.0, 9, 0.0, 0, 1),
    (8, 0.0, 0, 0.0, 40, 0.0, 0, 1),
    (8, 0.0, 0, 0.0, 3, 1.0, 0, 1),
    (8, 0.0, 9, 0.0, 0, 0.0, 0, 1),
    (8, 0.0, 9, 0.0, 9, 0.0, 0, 1),
    (8, 0.0, 9, 0.0, 40, 0.0, 0, 1),
    (8, 0.0, 9, 0.0, 3, 1.0, 0, 1),
    (8, 0.0, 40, 0.0, 0, 0.0, 0, 1),
    (8, 0.0, 40, 0.0, 9, 0.0, 0, 1),
    (8, 0.0, 40, 0.0, 40, 0.0, 0, 1),
    (8, 0.0, 40, 0.0, 3, 1.0, 0, 1),
    (8, 0.0, 3, 1.0, 0, 0.0, 0, 1),
    (8, 0.0, 3, 1.0, 9, 0.0, 0, 0),
    (8, 0.0, 3, 1.0, 40, 0.0, 0, 1),
    (8, 0.0, 3, 1.0, 3, 1.0, 0, 0),
    (1, 0.0, 0, 0.0, 0, 0.0, 0.5, 1),
    (1, 0.0, 0, 0.0, 9, 0.0, 0.5, 1),
    (1, 0.0, 0, 0.0, 40, 0.0, 0.5, 1),
    (1, 0.0, 0, 0.0, 3, 1.0, 0.5, 0),
    (1, 0.0, 9, 0.0, 0, 0.0, 0.5, 1),
    (1, 0.0, 9, 0.0, 9, 0.0, 0.5, 1),
    (1, 0.0, 9, 0.0, 40, 0.0, 0.5, 1),
    (1, 0.0, 9, 0.0, 3, 1.0, 0.5, 0),
    (1, 0.0, 40, 0.0, 0, 0.0, 0.5, 1),
    (1, 0.0, 40, 0.0, 9, 0.0, 0.5, 1),
    (1, 0.0, 40, 0.0, 40, 0.0, 0.5, 1),
    (1, 0.0, 40, 0.0, 3, 1.0, 0.5, 0),
    (1, 0.0, 3, 1.0, 0, 0.0, 0.5, 1),
    (1, 0.0, 3, 1.0, 9, 0.0, 0.5, 1),
    (1, 0.0, 3, 1.0, 40, 0.0, 0.5, 1),
    (1, 0.0, 3, 1.0, 3, 1.0, 0.5, 0),
    (8, 0.0, 0, 0.0, 0, 0.0, 0.5, 1),
    (8, 0.0, 0, 0.0, 9, 0.0, 0.5, 1),
    (8, 0.0, 0, 0.0, 40, 0.0, 0.5, 1),
    (8, 0.0, 0, 0.0, 3, 1.0, 0.5, 0),
    (8, 0.0, 9, 0.0, 0, 0.0, 0.5, 1),
    (8, 0.0, 9, 0.0, 9, 0.0, 0.5, 1),
    (8, 0.0, 9, 0.0, 40, 0.0, 0.5, 1),
    (8, 0.0, 9, 0.0, 3, 1.0, 0.5, 0),
    (8, 0.0, 40, 0.0, 0, 0.0, 0.5, 1),
    (8, 0.0, 40, 0.0, 9, 0.0, 0.5, 1),
    (8, 0.0, 40, 0.0, 40, 0.0, 0.5, 1),
    (8, 0.0, 40, 0.0, 3, 1.0, 0.5, 0),
    (8, 0.0, 3, 1.0, 0, 0.0, 0.5, 1),
    (8, 0.0, 3, 1.0, 9, 0.0, 0.5, 1),
    (8, 0.0, 3, 1.0, 40, 0.0, 0.5, 1),
    (8, 0.0, 3, 1.0, 3, 1.0, 0.5, 0),
]
LABELLED = PAGE_BLOCKS + WRITTEN_BLOCKS


def grow(rows: list[tuple], depth: int = 12):
    """Decision tree by Gini impurity: (feature, limit, at most, above), or a class."""
    total, ones = len(rows), sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, total):
        return int(2 * ones > total)
    impurity = lambda part: len(part) * (p := sum(r[-1] for r in part) / len(part)) * (1 - p)
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            limit = (a + b) / 2
            parts = [r for r in rows if r[f] <= limit], [r for r in rows if r[f] > limit]
            found = (impurity(parts[0]) + impurity(parts[1]), f, limit, parts)
            if best is None or found[:3] < best[:3]:
                best = found
    if best is None:
        return int(2 * ones > total)
    return best[1], best[2], grow(best[3][0], depth - 1), grow(best[3][1], depth - 1)


def decide(tree, features: tuple) -> bool:
    """Features as in the labelled tables; a container of -1 is an aside."""
    if features[-1] < 0:
        return False
    while isinstance(tree, tuple):
        f, limit, low, high = tree
        tree = low if features[f] <= limit else high
    return bool(tree)


_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")


def named_aside(tag: str, name: str) -> set[str]:
    """The words of a class or id by which it makes an element an aside; of each of its tokens all parts must be known."""
    out = set()
    for token in name.lower().split():
        parts = set(_NAME.findall(token))
        words = parts & ASIDE_WORDS
        if words and parts <= ASIDE_WORDS | PLACE_WORDS:
            out |= words
    if tag in TEXT_TAGS:
        out -= KIND_WORDS
    if tag in CENTRE:
        out = out & CARD_WORDS if tag == "article" else set()
    return out


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, int, int, int, bool]] = []  # text, words, linked words, container, in a heading
        self.made: list[tuple[int, int]] = [(0, 0)]  # containers: the one around it, kind
        self.open: list[tuple[str, int]] = []  # tag, container its text lies in
        self.opened: dict[str, int] = {}  # how many elements of a name are open
        self.parts: list[str] = []
        self.linked = self.unseen = self.links = 0

    def _cut(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                at = self.open[-1][1] if self.open else 0
                self.found.append((text, text.count(" ") + 1, self.linked, at, any(t in HEADINGS for t, _ in self.open[-4:])))
            self.parts.clear()
        self.linked = 0

    def blocks(self) -> list[tuple[str, int, int, float]]:
        """text, words, linked words, kind of container. Without words in an article or main, an aside by its name, its role or as a
        form that holds most of the page's words is a wrapper, and what is around it counts."""
        inside = [0] * len(self.made)
        for _, words, _, at, _ in self.found:
            inside[at] += words
        centred = any(n and kind == 1 for n, (_, kind) in zip(inside, self.made))
        for k in range(len(self.made) - 1, 0, -1):
            inside[self.made[k][0]] += inside[k]
        kinds = [0.0]
        for n, (around, kind) in zip(inside[1:], self.made[1:]):
            wraps = kind == SOFT and not centred and 2 * n > inside[0]
            kinds.append(kinds[around] if wraps else max(kind, -1))
        return [(text, words, linked, kinds[at] or (0.5 if heading else 0)) for text, words, linked, at, heading in self.found]

    def _container(self, tag: str, attrs) -> int:
        if tag in ("html", "body"):
            return 0
        soft = False
        for name, value in attrs:
            if name == "hidden":
                return HARD
            if value and name in ("class", "id") and (words := named_aside(tag, value)):
                if words & THREAD_WORDS or tag in CENTRE:
                    return HARD
                soft = True
            elif value and name == "role" and value.lower() in ASIDE_ROLES:
                soft = True
        if tag in ASIDE:
            return SOFT if tag == "form" else HARD
        return SOFT if soft else 1 if tag in CENTRE else 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._cut()
            if tag in ENDS_P and self.open and any(t == "p" for t, _ in self.open[-3:]):
                self._close("p")
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag == "body":
            self.unseen = 0  # an unclosed head ends here
        at = self.open[-1][1] if self.open else 0
        if (attrs or tag in ASIDE or tag in CENTRE) and (kind := self._container(tag, attrs)):
            self.made.append((at, kind))
            at = len(self.made) - 1
        self.open.append((tag, at))
        self.opened[tag] = self.opened.get(tag, 0) + 1
        self.unseen += tag in UNSEEN
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str) -> None:
        """Close up to the last open element of that name. Each element is taken off once; an end without its start costs nothing."""
        last = None
        while self.opened.get(tag) and last != tag:
            last = self.open.pop()[0]
            self.opened[last] -= 1
            self.unseen -= last in UNSEEN
            self.links -= last == "a"
        self.unseen = max(0, self.unseen)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._cut()
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data):
        if self.unseen:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.split())

    def close(self):
        super().close()
        self._cut()


def page_blocks(html: str) -> list[tuple[str, int, int, float]]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    return parser.blocks()


def main_text(html: str | None, tree) -> str:
    blocks = page_blocks(html) if html else []
    size = [(words, min(1.0, linked / words)) for _, words, linked, _ in blocks]
    size = [(0, 0.0), *size, (0, 0.0)]
    return "\n".join(b[0] for k, b in enumerate(blocks, 1) if decide(tree, (*size[k], *size[k - 1], *size[k + 1], b[3])))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url and the main text of each page."""
    tree = grow(LABELLED)

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), tree) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
