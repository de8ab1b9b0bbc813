"""Tables and fields of HTML pages by one pass over their tokens.

Tags are followed on a stack, not matched by patterns: tables may stand in cells of others, cells and rows may be
left open, spans push later cells aside, entities and comments are resolved, scripts and styles have no text. Pages come
to Python in Arrow batches; a page is parsed once whatever is asked of it.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import c

CELL = "array<struct<table: int, row: int, col: int, header: boolean, text: string>>"
ELEMENT = "array<struct<tag: string, text: string, link: string>>"
#: Elements whose text isn't shown.
HIDDEN = frozenset({"script", "style", "template", "noscript"})
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that begin a line of their own: they part words.
BLOCK = frozenset("address article aside blockquote br dd div dl dt footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
#: Which open elements a start tag closes, and what they must not be looked for beyond.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "p": ({"p"}, {"div", "article", "section", "td", "th", "li", "body"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}


def _clean(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class _Table:
    def __init__(self, number: int) -> None:
        self.number, self.row, self.cell = number, -1, None
        self.spans: dict[int, int] = {}  # column -> how many further rows a cell from above holds it

    def new_row(self) -> None:
        self.row += 1
        self.col, self.taken = 0, {k for k, n in self.spans.items() if n > 0}
        self.spans = {k: n - 1 for k, n in self.spans.items() if n > 0}


class PageParser(HTMLParser):
    """cells: (table, row, col, header, text) of all tables; elements: (tag, text, link) of the wanted tags, in order of their ends."""

    def __init__(self, wanted: frozenset[str] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.wanted, self.cells, self.elements = wanted, [], []
        self.tables: list[_Table] = []
        self.stack: list[tuple[str, list[str] | None, str | None]] = []
        self.hidden, self.count = 0, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = dict(attrs)
        if tag in BLOCK:
            self._text(" ")
        if tag == "table":
            self.tables.append(_Table(self.count))
            self.count += 1
        elif self.tables and tag in ("tr", "td", "th"):
            self._end_cell()
            table = self.tables[-1]
            if tag == "tr" or table.row < 0:
                table.new_row()
            if tag != "tr":
                self._begin_cell(table, tag == "th", at)
        if tag in CLOSES:
            closed, bound = CLOSES[tag]
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in closed:
                    self._end_from(k)
                    break
                if self.stack[k][0] in bound:
                    break
        if tag in HIDDEN:
            self.hidden += 1
        if tag not in VOID and tag not in ("tr", "td", "th"):
            self.stack.append((tag, [] if tag in self.wanted else None, at.get("href")))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._text(" ")
        if self.tables and tag in ("td", "th", "tr"):
            self._end_cell()
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._end_from(k)
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self._text(data)

    def close(self) -> None:
        super().close()
        self._end_from(0)

    def _text(self, data: str) -> None:
        if self.tables and self.tables[-1].cell:
            self.tables[-1].cell[-1].append(data)
        for _, parts, _ in self.stack:
            if parts is not None:
                parts.append(data)

    def _end_from(self, k: int) -> None:
        """Ends what has been open since place k of the stack, the innermost first."""
        while len(self.stack) > k:
            tag, parts, link = self.stack.pop()
            if tag == "table":
                self._end_cell()
                self.tables.pop()
            self.hidden -= tag in HIDDEN
            if parts is not None:
                self.elements.append((tag, _clean(parts), link))

    def _begin_cell(self, table: _Table, header: bool, at: dict) -> None:
        number = lambda name: max(1, min(1000, int(at[name]))) if (at.get(name) or "").strip().isdecimal() else 1
        while table.col in table.taken:
            table.col += 1
        wide, tall = number("colspan"), number("rowspan")
        for k in range(table.col, table.col + wide):
            if tall > 1:
                table.spans[k] = max(table.spans.get(k, 0), tall - 1)
        table.cell = (table.row, table.col, header, [])
        table.col += wide

    def _end_cell(self) -> None:
        table = self.tables[-1] if self.tables else None
        if table and table.cell:
            row, col, header, parts = table.cell
            self.cells.append((table.number, row, col, header, _clean(parts)))
            table.cell = None


def parsed(page: str, wanted: frozenset[str] = frozenset()) -> PageParser:
    parser = PageParser(wanted)
    parser.feed(page)
    parser.close()
    return parser


def pairs(cells: list[tuple]) -> dict[str, str]:
    """Of each row whose header cell a data cell follows: header -> data; of repeated headers the last."""
    found: dict[str, str] = {}
    ordered = sorted(cells)
    for a, b in zip(ordered, ordered[1:]):
        if a[:2] == b[:2] and a[3] and not b[3]:
            found[a[4]] = b[4]
    return found


def html_cells(html) -> Column:
    """The cells of all tables of a page, in order of their ends: table, row, col (from 0, spans counted), header, text.

    A cell's text is without that of tables within it. A missing page has no cells."""
    run = F.pandas_udf(lambda pages: pd.Series([parsed(p).cells if p else [] for p in pages]), CELL)
    return run(c(html))


def html_pairs(html) -> Column:
    """Header -> data of the rows of a page's tables as a map."""
    run = F.pandas_udf(lambda pages: pd.Series([pairs(parsed(p).cells) if p else {} for p in pages]), "map<string,string>")
    return run(c(html))


def html_elements(html, tags: list[str], resolve: bool = True) -> Column:
    """The elements of a page with one of the tags: tag, text (white space collapsed), link (its href), in order of their ends.

    Without resolve, character references stay as they are written, in texts and links."""
    wanted = frozenset(t.lower() for t in tags)
    # of an escaped ampersand the parser makes the ampersand that was written
    source = (lambda p: p) if resolve else (lambda p: p.replace("&", "&amp;"))
    run = F.pandas_udf(lambda pages: pd.Series([parsed(source(p), wanted).elements if p else [] for p in pages]), ELEMENT)
    return run(c(html))
