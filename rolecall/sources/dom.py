"""HTML pages as rows of elements: the one place where Python touches a page.

``parse`` turns each page into one row holding its elements and text pieces as
arrays in document order. Everything after it is native expressions: the
descendants of an element are a slice of ``nodes``, its text a slice of
``texts``, so page-local work needs neither a shuffle nor a self join.
"""

from __future__ import annotations

import functools
import html as html_lib
import itertools
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules

# Void elements never hold children; text below the raw ones is
# not part of the text around it.
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
RAW_TEXT_TAGS = frozenset("script style template rt rp".split())
HEADINGS = frozenset("h1 h2 h3 h4".split())

# Visibility levels: 0 everywhere, 1 not on boards, 2 never in main content.
BOARD, CONTENT, WHOLE = 0, 1, 2
# Kinds of text: plain, comment, raw (scripts and the like).
PLAIN, COMMENT, RAW = 0, 1, 2

#: Characters of pages that are worked on at once: their elements take some 20 times as much.
BATCH_CHARS = 1_000_000

#: Of every element: its place, the place of its last descendant, of its parent, and its depth; tag and
#: attributes; its slice of the texts; visibility; headings, children with text and characters of text inside.
#: ``label`` is the heading that names what begins here (see ``_Tree``). The ranks say how many visible
#: headings, elements named after a location and short lines begin up to here: those inside an
#: element are the slice from its own rank to that of its last descendant.
_FIELDS = {
    "pre": pa.int32(), "end": pa.int32(), "parent": pa.int32(), "depth": pa.int32(),
    "tag": pa.string(), "id": pa.string(), "classes": pa.string(), "href": pa.string(),
    "attrs": pa.map_(pa.string(), pa.string()),
    "t0": pa.int32(), "t1": pa.int32(), "noise": pa.int32(), "heads": pa.int32(), "kids": pa.int32(), "tlen": pa.int32(),
    "label": pa.int32(), "head_rank": pa.int32(), "place_rank": pa.int32(), "line_rank": pa.int32(),
}
_TEXT_FIELDS = {"s": pa.string(), "noise": pa.int32(), "kind": pa.int32()}
_INT = "pre: int, end: int, parent: int, depth: int"
SCHEMA = (
    f"nodes ARRAY<STRUCT<{_INT}, tag: string, id: string, classes: string, href: string, "
    "attrs: map<string, string>, t0: int, t1: int, noise: int, heads: int, kids: int, tlen: int, "
    "label: int, head_rank: int, place_rank: int, line_rank: int>>, "
    "texts ARRAY<STRUCT<s: string, noise: int, kind: int>>"
)
LABELS = frozenset("h1 h2 h3 h4 h5 h6".split())
LINE_TAGS = ("span", "p", "div", "li")
LINE_CHARS = 119
_PLACE = re.compile(rules.BOARD_LOCATION_CLASS, re.ASCII)
# Comments without text that follow each other, as rendering frameworks leave them.
_BLANK_COMMENTS = re.compile(r"(?:<!--\s*-->){1,1000}")


@functools.lru_cache(maxsize=4096)
def _named_place(names: str) -> bool:
    return _PLACE.search(names) is not None


class _Tree(HTMLParser):
    """Tokens to numbered elements, one list per field; nothing is implied, stray end tags are ignored.

    The heading that labels an element is the first one of the nearest thing with a heading that
    ended before it, among its own and its ancestors' elder siblings. So every open
    element keeps the first heading of its last closed child that has one, or what labels itself.
    """

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.columns: dict[str, list] = {f: [] for f in _FIELDS}
        self.texts: dict[str, list] = {f: [] for f in _TEXT_FIELDS}
        self.open: list[int] = []
        self.first: list[int] = []  # first heading at or inside each element, or -1
        self.labels: list[int] = []  # what labels the next child of each element
        self.raw = 0
        self.parts: list[str] = []
        self._start("[document]", {}, 0)

    def _start(self, tag, named, noise):
        c, pre = self.columns, len(self.first)
        up = self.open[-1] if self.open else -1
        label = self.labels[up] if self.open else -1
        row = (pre, 0, up, c["depth"][up] + 1 if self.open else 0, tag,
               named.get("id", ""), " ".join(named.get("class", "").split()), named.get("href"), list(named.items()),
               len(self.texts["s"]), 0, noise, 0, 0, 0, label, 0, 0, 0)
        for column, value in zip(c.values(), row, strict=True):
            column.append(value)
        self.first.append(pre if tag in LABELS else -1)
        self.labels.append(label)
        self.open.append(pre)

    def _flush(self, kind=PLAIN):
        if not self.parts:
            return
        text = "".join(self.parts).strip()
        self.parts.clear()
        if text:
            at = self.open[-1]
            noise = self.columns["noise"][at]
            kind = RAW if kind == PLAIN and self.raw else kind
            for column, value in zip(self.texts.values(), (text, noise, kind), strict=True):
                column.append(value)
            if kind == PLAIN and noise == 0:
                self.columns["tlen"][at] += len(text)

    def handle_starttag(self, tag, attrs, close=False):
        self._flush()
        named = {k: "" if v is None else v for k, v in attrs}
        noise = 2 if tag in rules.PAGE_NOISE_TAGS else 1 if tag in rules.BOARD_NOISE_TAGS else 0
        self._start(tag, named, max(noise, self.columns["noise"][self.open[-1]]))
        self.raw += tag in RAW_TEXT_TAGS
        if close or tag in VOID_TAGS:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, close=True)

    def handle_endtag(self, tag):
        self._flush()
        tags = self.columns["tag"]
        if tags[self.open[-1]] == tag:
            self._close()
        elif any(tags[i] == tag for i in reversed(self.open)):
            while self._close() != tag:
                pass

    def _close(self):
        at, c = self.open.pop(), self.columns
        tag = c["tag"][at]
        c["end"][at], c["t1"][at] = len(self.first) - 1, len(self.texts["s"])
        self.raw -= tag in RAW_TEXT_TAGS
        if self.open:
            up = self.open[-1]
            if self.first[at] >= 0:
                self.labels[up] = self.first[at]
                if self.first[up] < 0:
                    self.first[up] = self.first[at]
            if c["noise"][at] == 0:
                c["tlen"][up] += c["tlen"][at]
                c["kids"][up] += c["tlen"][at] > 0
                c["heads"][up] += c["heads"][at] + (tag in HEADINGS)
        return tag

    def handle_data(self, data):
        self.parts.append(data)

    def handle_entityref(self, name):
        self.parts.append(html5.get(name + ";", "&" + name))

    def handle_charref(self, name):
        self.parts.append(html_lib.unescape(f"&#{name};"))

    def handle_comment(self, data):
        self._flush()
        self.parts.append(data)
        self._flush(COMMENT)

    def parse_comment(self, i, report=1):
        """Blank comments only end the text ahead of them: a run of them is one step."""
        blank = _BLANK_COMMENTS.match(self.rawdata, i)
        if blank is None:
            return super().parse_comment(i, report)
        self._flush()
        return blank.end()

    def updatepos(self, i, j):
        """Nobody asks for the line of a token, so lines are not counted."""
        return j

    def parse_marked_section(self, i, report=1):
        """Other ``<![...`` than CDATA is a comment up to the next ``>``, as browsers take it."""
        cdata = self.rawdata.startswith("<![CDATA[", i)
        end = self.rawdata.find("]]>" if cdata else ">", i + 3)
        if end < 0:
            return -1
        if cdata:
            self.unknown_decl(self.rawdata[i + 3 : end])
        else:
            self.handle_comment(self.rawdata[i + 2 : end])
        return end + (3 if cdata else 1)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self._flush()
            self.parts.append(data[6:])
            self._flush()

    def finish(self):
        self._flush()
        while self.open:
            self._close()
        c, heads, places, lines = self.columns, 0, 0, 0
        seen = zip(c["tag"], c["noise"], c["classes"], c["id"], c["tlen"], strict=True)
        for at, (tag, noise, classes, ident, tlen) in enumerate(seen):
            if noise <= BOARD:
                heads += tag in HEADINGS
                places += bool(classes or ident) and _named_place(classes + ident)
                lines += tag in LINE_TAGS and 1 <= tlen <= LINE_CHARS
            c["head_rank"][at], c["place_rank"][at], c["line_rank"][at] = heads, places, lines


def _read(html: str | None) -> _Tree:
    page = _Tree()
    page.feed(html or "")
    page.close()
    page.finish()
    return page


def tree(html: str) -> tuple[list[dict], list[dict]]:
    """Elements and text pieces of one page."""
    page = _read(html)
    return tuple([dict(zip(c, row, strict=True)) for row in zip(*c.values(), strict=True)] for c in (page.columns, page.texts))


def _lists(pages: list[dict[str, list]], fields: dict[str, pa.DataType]) -> pa.ListArray:
    """Lists of structs, one for each page, built one field at a time."""
    ends = list(itertools.accumulate((len(next(iter(p.values()))) for p in pages), initial=0))
    columns = [pa.array(itertools.chain.from_iterable(p[f] for p in pages), kind) for f, kind in fields.items()]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, list(fields)))


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parse page by page, giving rows back in small batches to bound memory."""
    for batch in batches:
        at = batch.schema.get_field_index("html")
        rest = batch.select([n for n in batch.schema.names if n != "html"])
        html = batch.column(at)
        start, size, pages = 0, 0, []
        for row in range(batch.num_rows):
            text = html[row].as_py()
            pages.append(_read(text))
            size += len(text or "")
            if size >= BATCH_CHARS or row == batch.num_rows - 1:
                nodes = _lists([p.columns for p in pages], _FIELDS)
                texts = _lists([p.texts for p in pages], _TEXT_FIELDS)
                keys = rest.slice(start, len(pages))
                yield pa.RecordBatch.from_arrays(
                    [*keys.columns, nodes, texts], names=[*keys.schema.names, "nodes", "texts"]
                )
                start, size, pages = row + 1, 0, []


def parse(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``(*keys, nodes, texts)``, one row per page; ``html`` is left behind."""
    pages = pages.select(*keys, "html")
    kept = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.mapInArrow(_parse_batches, f"{kept}, {SCHEMA}")


def nodes(parsed: DataFrame) -> DataFrame:
    """One row per element, for queries that want elements as a table."""
    keys = [c for c in parsed.columns if c not in ("nodes", "texts")]
    return parsed.select(*keys, F.inline("nodes"))
