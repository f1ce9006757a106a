"""Main text of web pages by the distribution of text over lines.

The markup is stripped so that every block element leaves one line.  A line weighs its text length, less what stands in
links; markup only changes weights.  Page furniture (elements and class names below) weighs nothing.  A class name of a
furniture word and others (``social-science``, ``related-work``) leaves the choice to the text: the element is furniture if most
of it stands in links or its lines are short on average (under ``SURGE``).  Where the page marks an article, its lines count
their links too; a line outside goes where articles hold half of the unlinked text or more, and else weighs what it has
beyond ``OUTSIDE`` characters.
Headings and paragraphs (``PROSE``) that are mostly not links, and lines of an article, weigh ``SURGE`` more.

The weights are summed over a sliding window of lines: the sum surges from zero where text starts and dives back to zero
where it ends.  A stretch in which the sum reaches ``SURGE`` (or the page's heaviest sum, if that is less) is running text.
From the first surge of such a stretch to the last dive all stretches are kept, short ones too, each with its lines of
weight zero (linked ones, say); so are linked paragraphs between stretches where no article is marked.  Furniture never is.

Defined results: null or empty html, and pages without running text, give an empty text; unclosed elements end with their
parent or the page; a tag whose quotes never close ends at its first ``>`` if no ``<`` comes before it, and else is text; after
``TRIES`` of those, quotes are not looked at in the rest of the page; repeated rows repeat their result.  Work is linear in the
page, whatever its markup.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements whose content is no markup, elements without an end, and elements that make a block.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr
ul""".split())
#: Page furniture, by element and by word of a class, id or role.
FURNITURE = {"nav", "footer", "aside", "form", "button", "menu", "head", "dialog", "search"}
FURNITURE_WORDS = set("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
disclaimer footer menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies share
sharing sidebar social sponsor sponsored subscribe toolbar widget""".split())
#: Of these, words that also name contents: joined with others than layout words they leave the choice to the text.
TOPIC_WORDS = set("""banner dialog disclaimer footer menu navigation notice notices related reply replies share sharing social toolbar
widget""".split())
LAYOUT_WORDS = set("""area article articles bar block body bottom box button buttons col column container content global group header
icons inner item items left link links list main media navbar outer page panel post posts primary right row secondary section site
small stories sub text title top wrap wrapper""".split())
#: Elements that hold running text.
PROSE = {"p", "pre", "blockquote", "dd", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6"}
WINDOW = 3
SURGE = 40
OUTSIDE = 200
TRIES = 16
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)([^<>]*+)>")
RAW_END = {tag: re.compile(rf"</{tag}\b", re.IGNORECASE) for tag in RAW}
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
SPACE = re.compile(r"\s+")


@dataclass
class Line:
    text: str
    linked: int  # characters inside links
    furniture: bool
    article: bool
    prose: bool


def furniture_by_name(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether class, id and role make an element furniture, and whether they leave that to its text."""
    sure = unsure = False
    for value in NAMES.findall(attributes):
        for name in value.lower().strip("\"'").split():
            words = set(re.findall(r"[a-z]+", name))
            if tag == "article":
                sure = sure or bool(words & {"comment", "comments", "reply"})
            elif words & (FURNITURE_WORDS - TOPIC_WORDS) or words & TOPIC_WORDS and words <= TOPIC_WORDS | LAYOUT_WORDS:
                sure = True
            elif words & TOPIC_WORDS:
                unsure = True
    return sure, unsure


@dataclass
class Open:
    """An open element; everything but the name includes its parents."""

    tag: str = ""
    furniture: bool = False
    unsure: int = 0  # the outermost element whose name leaves the choice to its text
    article: bool = False
    link: bool = False
    prose: bool = False


class Stack:
    """Open elements, with the places of each name, so that an end finds its start at once."""

    def __init__(self) -> None:
        self.elements = [Open()]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]
        self.unsure = 0

    @property
    def top(self) -> Open:
        return self.elements[-1]

    def push(self, tag: str, attributes: str) -> None:
        top = self.top
        furniture, unsure = top.furniture or tag in FURNITURE or tag == "header" and not top.article, top.unsure
        if attributes and not furniture and tag not in ("html", "body", "main"):
            furniture, asks = furniture_by_name(tag, attributes)
            if asks and not unsure:
                self.unsure += 1
                unsure = self.unsure
        article = top.article or tag in ("article", "main") and not furniture
        self.places.setdefault(tag, []).append(len(self.elements))
        if tag in BLOCK:
            self.blocks.append(len(self.elements))
        self.elements.append(Open(tag, furniture, unsure, article, top.link or tag == "a", top.prose or tag in PROSE))

    def pop_from(self, place: int) -> None:
        while len(self.elements) > place:
            tag = self.elements.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def close(self, tag: str) -> None:
        """An end without a start is left out, an inline end doesn't close blocks."""
        places = self.places.get(tag)
        if places and (tag in BLOCK or places[-1] > self.blocks[-1]):
            self.pop_from(places[-1])

    def close_sibling(self, tag: str) -> None:
        """The start of a paragraph or entry ends the one before, if that is near."""
        places = self.places.get(tag)
        if places and places[-1] >= len(self.elements) - 3:
            self.pop_from(places[-1])


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order, blanks left out."""
    found: list[Line] = []
    asked: dict[int, list[Line]] = {}
    parts: list[str] = []
    linked = 0
    stack = Stack()

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            top = stack.top
            found.append(Line(text, linked, top.furniture, top.article, top.prose))
            if top.unsure:
                asked.setdefault(top.unsure, []).append(found[-1])
        parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        piece = entities.unescape(piece)
        parts.append(piece)
        linked += len(piece) * stack.top.link

    at, n, last, tries = 0, len(page), page.rfind(">"), TRIES
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last:  # no markup is left
            add(page[at:])
            break
        if lt != at:
            add(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            at = page.find(">", lt) + 1
            continue
        m = TAG.match(page, lt) if tries else PLAIN_TAG.match(page, lt)
        if not m and tries and page[lt + 1 : lt + 3].strip("/")[:1].isalpha():
            tries -= 1
            m = PLAIN_TAG.match(page, lt)
        if not m:
            parts.append("<")
            at = lt + 1
            continue
        at, closing, tag = m.end(), m[1], m[2].lower()
        if tag in RAW and not closing:
            end = RAW_END[tag].search(page, at)
            gt = page.find(">", end.end()) if end else -1
            at = gt + 1 if gt >= 0 else n
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCK:
            flush()
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if closing:
            stack.close(tag)
            continue
        if tag in ("p", "li"):
            stack.close_sibling(tag)
        stack.push(tag, m[3])
    flush()
    for lines in asked.values():
        size = sum(len(x.text) for x in lines)
        if 2 * sum(x.linked for x in lines) > size or size < SURGE * len(lines):
            for x in lines:
                x.furniture = True
    return found


def weight(line: Line, outside: int | None) -> int:
    """The text length by which a line counts; ``outside``: what a line outside the marked articles must exceed, none where none is marked."""
    if line.furniture:
        return 0
    free = len(line.text) if line.article else max(0, len(line.text) - line.linked)
    if outside is not None and not line.article:
        return max(0, free - outside)
    return free + SURGE * (line.article or line.prose and 2 * free >= len(line.text))


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(surge, dive, heaviest sum): ranges of lines in which the sum over a sliding window never falls to zero."""
    out, total, start, peak = [], 0, 0, 0
    for i, w in enumerate(weights + [0] * window):
        before, total = total, total + w - (weights[i - window] if i >= window else 0)
        if total and not before:
            start, peak = i, 0
        peak = max(peak, total)
        if before and not total:
            out.append((start, i - window + 1, peak))
    return out


def main_text(page: str) -> str:
    lines = lines_of(page)
    marked = any(x.article for x in lines)
    free = [(x.article, len(x.text) if x.article else max(0, len(x.text) - x.linked)) for x in lines if not x.furniture]
    whole = 2 * sum(size for article, size in free if article) >= sum(size for _, size in free)
    outside = (len(page) if whole else OUTSIDE) if marked else None  # no line is longer than its page
    found = stretches([weight(x, outside) for x in lines])
    level = min(SURGE, max((peak for _, _, peak in found), default=0))
    running = [(a, b) for a, b, peak in found if peak >= level]
    if not running:
        return ""
    first, last = running[0][0], running[-1][1]
    held = {i for a, b, _ in found if first <= a < last for i in range(a, b)}
    kept = [x for i, x in enumerate(lines[first:last], first) if not x.furniture and (i in held or x.prose and not marked)]
    return "\n\n".join(x.text for x in kept if x.article or not marked or not whole)


def extract(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``df`` with the main text of each page."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: main_text(p or ""))

    return df.withColumn(text, run(F.col(html)))
