"""Title and main text of web pages.

Pages are read with the event parser of the standard library, whole pages at a
time inside Arrow batches; no tree is built.  A start tag opens a stretch of the text
when it is the first element of a wanted kind, and an end tag closes what lies above
its partner.  Text of scripts, style sheets and
templates is not text.

Paragraphs are one sweep over the page: text counts while any paragraph is open, once, however many are,
and where one begins or ends a blank stands.  So nested paragraphs, and those that nobody closes,
cost their own length.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .slices import by_bytes

# Where the main text is looked for, in this order.
CONTENT_SELECTORS = ("article", ".article-content", ".content", ".post-content",
                     ".entry-content", ".story-body", ".article-body", "main",
                     ".main-content")

# Elements that have no end tag.
VOID_ELEMENTS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split())

_SILENT = frozenset(("script", "style", "template"))

EXTRACT_SCHEMA = "page_id bigint, url string, title string, content string, error string"


class _PageReader(HTMLParser):
    """Text pieces of a page in one list; an element is a stretch of it.

    Work is linear in the page: a piece is stored once however many elements are open, elements of
    no interest are counted by tag only, and an end tag without a partner is found out by that count.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces = []
        self.open = []            # [(tag, wanted stretches)]
        self.depth = Counter()    # open elements by tag
        self.silent = 0
        self.spans = {}           # key -> [start, end) in the pieces
        self.paragraphs = []      # pieces inside of any, a blank at every edge of one
        self.og_title = None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "meta" and self.og_title is None and attrs.get("property") == "og:title":
            self.og_title = attrs.get("content") or ""
        if tag in VOID_ELEMENTS:
            return
        classes = (attrs.get("class") or "").split()
        spans = []
        for key in CONTENT_SELECTORS:
            if key not in self.spans and (key[1:] in classes if key[0] == "." else key == tag):
                spans.append(self.spans.setdefault(key, [len(self.pieces), None]))
        if tag == "title" and "title" not in self.spans:
            spans.append(self.spans.setdefault("title", [len(self.pieces), None]))
        if tag == "p":
            self.paragraphs.append(" ")
        self.open.append((tag, spans))
        self.depth[tag] += 1
        self.silent += tag in _SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_ELEMENTS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.depth[tag]:
            return
        while True:
            name, spans = self.open.pop()
            for span in spans:
                span[1] = len(self.pieces)
            self.depth[name] -= 1
            if name == "p":
                self.paragraphs.append(" ")
            self.silent -= name in _SILENT
            if name == tag:
                return

    def handle_data(self, data):
        if not self.silent:
            self.pieces.append(data)
            if self.depth["p"]:
                self.paragraphs.append(data)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self.handle_data(data[6:])

    def text(self, span):
        return "".join(self.pieces[span[0]:span[1]]) if span else ""

    def paragraph_text(self):
        """The text of all paragraphs, each piece once."""
        return "".join(self.paragraphs)


def read_page(html: str) -> tuple[str, str]:
    """``(title, content)`` of one page."""
    reader = _PageReader()
    reader.feed(html)
    reader.close()
    title = reader.text(reader.spans.get("title")).strip() or (reader.og_title or "").strip()
    chosen = next((s for s in CONTENT_SELECTORS if s in reader.spans), None)
    content = reader.text(reader.spans[chosen]) if chosen else ""
    if not content:
        content = reader.paragraph_text()
    return title, " ".join(content.split())


def extract_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html)`` to title and content; a bad page becomes an error row."""

    def run(batches):
        for batch in batches:
            # only a few pages at a time are Python objects
            at = 0
            for sources in by_bytes(batch.column(2)):
                part, rows = batch.slice(at, len(sources)), []
                at += len(sources)
                for html in sources.to_pylist():
                    title = content = error = None
                    try:
                        if html is None:
                            raise ValueError("page has no source")
                        title, content = read_page(html)
                    except Exception as problem:  # a page must not stop the table
                        error = f"page cannot be read: {problem}"
                    rows.append((title, content, error))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(1),
                     *[pa.array([row[i] for row in rows], pa.string()) for i in range(3)]],
                    names=["page_id", "url", "title", "content", "error"])

    return pages.select("page_id", "url", "html").mapInArrow(run, EXTRACT_SCHEMA)
