"""Repeated HTML cards to structs, with the standard-library parser."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

CARD_FIELDS = ("title", "href", "company", "city", "salary", "experience", "card_id")
CARDS_TYPE = ArrayType(StructType(
    [StructField(f, StringType()) for f in CARD_FIELDS] + [StructField("tags", ArrayType(StringType()))]))


@dataclass(frozen=True)
class Step:
    """One element of a selector: tag, a class it must have, text its link must hold."""

    tag: str
    cls: str = ""
    href: str = ""


Selector = tuple[Step, ...]  # descendants, outermost first


def cards(html: Column, card: Step, fields: Mapping[str, Sequence[Selector]], id_attribute: str = "", cut_references: bool = True) -> Column:
    """``array<struct>`` of the cards of a page.

    For every field the first selector with a hit wins; ``tags`` gathers all hits
    of its first selector.  A card without a title is no posting.  Like a browser, the
    parser reads ``&amp`` without its semicolon as a reference; with ``cut_references``
    false such text, for example of a title that was cut, stays as written.
    """
    spec = {name: [tuple((s.tag, s.cls, s.href) for s in sel) for sel in sels] for name, sels in fields.items()}
    card_step = (card.tag, card.cls, card.href)
    names = [f for f in CARD_FIELDS if f not in ("title", "href", "card_id")]

    # Everything the workers need is defined in here and travels by value.
    @F.pandas_udf(CARDS_TYPE)
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re
        from html import unescape
        from html.entities import html5
        from html.parser import HTMLParser
        # Pages of plain tags and text are cut by one pattern; any other (comments, raw text, broken tags) goes to the parser.
        attribute = r"""\s+([a-zA-Z][a-zA-Z0-9_:.-]*)(?:=("[^"]*"|'[^']*'|[^\s"'<>=`/&]+))?"""
        plain = r"""\s+[a-zA-Z][a-zA-Z0-9_:.-]*(?:="[^"]*"|='[^']*'|=[^\s"'<>=`/&]+)?"""
        token = re.compile(rf"<([a-zA-Z][a-zA-Z0-9]*)((?:{plain})*+)\s*>|</([a-zA-Z][a-zA-Z0-9]*)>|([^<]+)")
        attribute = re.compile(attribute)
        raw_text = re.compile(r"<(?:script|style|title|textarea|xmp|iframe|noembed|noframes|noscript|plaintext)", re.IGNORECASE)
        known = {}  # elements by their written tag
        by_tag = {}
        for name, sels in spec.items():
            for rank, sel in enumerate(sels):
                by_tag.setdefault(sel[-1][0], []).append((name, rank, sel))
        ampersand = re.compile(r"&(?:(#[0-9]+;|#[xX][0-9a-fA-F]+;)|([A-Za-z][A-Za-z0-9]*;))?")
        void = {"br", "img", "hr", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed"}

        def fits(step, element) -> bool:
            tag, cls, href = step
            return element[0] == tag and (not cls or cls in element[1]) and (not href or href in element[2].get("href", ""))

        class Reader(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.open, self.start, self.done, self.hits, self.live, self.attrs = [], None, [], {}, [], {}

            def handle_starttag(self, tag, attrs):
                values = {k: v or "" for k, v in attrs}
                self.enter((tag, set(values.get("class", "").split()), values))

            def plain(self, page) -> bool:
                """Read a page of plain tags and text; false, with nothing read, if it has anything else."""
                if raw_text.search(page):
                    return False
                pieces, at = [], 0
                for m in token.finditer(page):
                    if m.start() != at:
                        return False
                    pieces.append(m)
                    at = m.end()
                if at != len(page):
                    return False
                for m in pieces:
                    if m.lastindex == 4:
                        self.handle_data(unescape(m[4]) if "&" in m[4] else m[4])
                    elif m.lastindex == 3:
                        self.handle_endtag(m[3].lower())
                    else:
                        element = known.get(m[0])
                        if element is None:
                            pairs = [(k.lower(), v[1:-1] if v[:1] in ("'", '"') else v) for k, v in attribute.findall(m[2])]
                            values = {k: unescape(v) for k, v in pairs}
                            element = (m[1].lower(), set(values.get("class", "").split()), values)
                            if len(known) < 10_000:
                                known[m[0]] = element
                        self.enter(element)
                return True

            def enter(self, element):
                tag, _, values = element
                if self.start is None:
                    if fits(card_step, element):
                        self.start, self.hits, self.live, self.attrs = len(self.open), {}, [], values
                else:
                    for name, rank, sel in by_tag.get(tag, ()):
                        if fits(sel[-1], element) and (len(sel) == 1 or self.inside(sel[:-1], self.open[self.start:])):
                            hit = {"text": [], "href": values.get("href", ""), "depth": len(self.open)}
                            self.hits.setdefault((name, rank), []).append(hit)
                            if tag not in void:
                                self.live.append(hit)
                if tag not in void:
                    self.open.append(element)

            def inside(self, steps, above) -> bool:
                it = iter(above)
                return all(any(fits(s, e) for e in it) for s in steps)

            def handle_data(self, data):
                piece = data.strip()
                if piece:
                    for hit in self.live:
                        hit["text"].append(piece)

            def handle_endtag(self, tag):
                depth = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
                if depth is None:
                    return
                del self.open[depth:]
                self.live = [h for h in self.live if h["depth"] < depth]
                if self.start is not None and depth <= self.start:
                    self.finish()

            def finish(self):
                if self.start is not None:
                    self.done.append((self.hits, self.attrs))
                self.start, self.hits, self.live = None, {}, []

        def first(hits, name):
            for rank in range(len(spec.get(name, ()))):
                if (name, rank) in hits:
                    return hits[(name, rank)][0]
            return None

        def whole(m) -> str:
            return m[0] if m[1] or m[2] in html5 else "&amp;" + m[0][1:]

        def read(page):
            if not page:
                return []
            if not cut_references:
                page = ampersand.sub(whole, page)
            reader = Reader()
            if not reader.plain(page):
                reader.feed(page)
                reader.close()
            reader.finish()
            out = []
            for hits, attrs in reader.done:
                title = first(hits, "title")
                text = "".join(title["text"]) if title else ""
                if not text:
                    continue
                row = {"title": text, "href": title["href"], "card_id": attrs.get(id_attribute) if id_attribute else None}
                for name in names:
                    hit = first(hits, name)
                    row[name] = "".join(hit["text"]) if hit else None
                row["tags"] = [t for t in ("".join(h["text"]) for h in hits.get(("tags", 0), [])) if t]
                out.append(row)
            return out

        for batch in batches:
            yield batch.map(read)
    return extract(html)
