"""Visible text of HTML pages, laid out.

A tokenizer and a tree builder with implied end tags turn a page into a stream of elements that open and close; visibility
rules hide subtrees; a renderer keeps block spacing, list marks and indents, preformatted text, and table cells aligned in
columns. Everything works on an explicit stack, and the places of each open tag are kept beside it, so nesting may be as
deep as a page likes and time is in proportion to the page.

Text is never cut. Three bounds hold layout alone: a table whose padding would take more than PADDING characters is not
aligned, tables nested deeper than NESTED are blocks, and indents end at INDENT columns.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE_RAW = frozenset("title textarea".split())
PREFORMATTED = frozenset("pre listing xmp".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes audio video canvas datalist rp meta link base source track param area map annotation annotation-xml".split())
#: Elements of a drawing that show text.
DRAWN = frozenset("text foreignobject".split())
HEAD_ONLY = frozenset("base link meta title script style template noscript".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCKS = PARAGRAPHS | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li listing main menu nav optgroup option search section summary tr caption thead tbody tfoot xmp".split())
CLOSES_P = BLOCKS - frozenset("body html option optgroup tr caption thead tbody tfoot legend".split())
#: An element that opens ends open ones of these kinds, up to the nearest fence.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, set()),
    "a": ({"a"}, {"table", "td", "th", "p", "div", "li"}),
}
P_FENCE = frozenset("table td th button caption html object template body".split())
CELL_FENCE = frozenset("table td th caption".split())

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
BRACE = re.compile(r"[{}]")
SELECTOR = re.compile(r"[.#]?[\w-]+")
INTEGER = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]{1,9})(?![0-9])")
NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
BULLET = "- "
PADDING, NESTED, INDENT = 20_000_000, 50, 1000
MOST_SPAN, MOST_ROWS = 1000, 65_534


class Flow:
    """Lines of a block container: the page, or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.blank = 0, False
        self.indent: list[int] = []
        self.pad = self.mark = ""

    def deeper(self, by: int) -> None:
        by = min(by, INDENT - len(self.pad))
        self.indent.append(by)
        self.pad += " " * by

    def shallower(self) -> None:
        self.pad = self.pad[: len(self.pad) - self.indent.pop()]
        self.mark = ""

    def _start(self) -> None:
        if not self.line:
            if self.lines and self.gap > 1:
                self.lines.append("")
            self.gap = 0
            pad = self.pad
            if self.mark:
                pad = pad[: max(0, len(pad) - len(self.mark))] + self.mark
                self.mark = ""
            self.line.append(pad)
            self.blank = True

    def text(self, s: str) -> None:
        for i, part in enumerate(SPACE.split(s)):
            if i and self.line and not self.blank:
                self.line.append(" ")
                self.blank = True
            if part:
                self._start()
                self.line.append(part)
                self.blank = False

    def plain(self, s: str) -> None:
        """Preformatted text."""
        for i, part in enumerate(s.split("\n")):
            if i:
                self.newline()
            if part:
                self._start()
                self.line.append(part)
                self.blank = False

    def newline(self) -> None:
        if not self.line:
            self._start()
        self.end()

    def end(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line, self.blank = [], False

    def block(self, gap: int) -> None:
        self.end()
        self.gap = max(self.gap, gap)

    def result(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        while self.lines and not self.lines[0].strip():
            self.lines.pop(0)
        return self.lines


class Grid:
    """A table that is being read: the cells of a row by the column they start in."""

    def __init__(self) -> None:
        self.rows: list[dict[int, list[str]]] = []
        self.spans: list[list[int]] = []  # first column, column after the last, rows that it still covers
        self.here: list[list[int]] = []  # those that reach into this row, the rightmost first
        self.at = 0

    def row(self) -> None:
        self.rows.append({})
        self.spans = [[a, b, n - 1] for a, b, n in self.spans if n > 1]
        self.here = sorted(self.spans, reverse=True)
        self.at = 0

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        while self.here and self.here[-1][0] <= self.at:
            self.at = max(self.at, self.here.pop()[1])
        self.rows[-1][self.at] = lines
        if down > 1:
            self.spans.append([self.at, self.at + across, down])
        self.at += across

    def lines(self) -> Iterator[str]:
        width: dict[int, int] = {}
        for row in self.rows:
            for c, lines in row.items():
                width[c] = max(width.get(c, 0), max(map(len, lines), default=0))
        columns, reach = sorted(width), [0]
        for c in columns:
            reach.append(reach[-1] + width[c] + 2)
        high = [max(map(len, row.values()), default=0) for row in self.rows]
        used = [columns[: bisect_right(columns, max(row, default=-1))] for row in self.rows]
        if sum(h * reach[len(u)] for h, u in zip(high, used, strict=True)) > PADDING:
            width = dict.fromkeys(width, 0)
        for row, h, some in zip(self.rows, high, used, strict=True):
            for i in range(h):
                yield "  ".join((row[c][i] if c in row and i < len(row[c]) else "").ljust(width[c]) for c in some).rstrip()


def _integer(value: str | None, default: int) -> int:
    """The integer that a value starts with, by ASCII digits; the default without one, or with ten digits and more."""
    found = INTEGER.match(value or "")
    return int(found[1]) if found else default


def _span(value: str | None, most: int, zero: int = 1) -> int:
    n = _integer(value, 1)
    return zero if n == 0 else min(most, n) if n > 0 else 1


class Page:
    """Builds the elements of a page and renders them as they open and close."""

    def __init__(self) -> None:
        self.stack: list[tuple] = []  # tag, what it undoes
        self.places: dict[str, list[int]] = defaultdict(list)  # of each open tag in the stack
        self.flows, self.grids, self.lists = [Flow()], [], []  # a table that is a block has None for a grid
        self.hidden = self.pre = self.drawing = self.drawn = 0
        self.fresh = False  # just after <pre>, where a newline is none
        self.hide: set[str] = set()

    # the tree builder

    def start(self, tag: str, rest: str) -> None:
        if tag in ("html", "body") and any(t == tag for t, _ in self.stack[:3]):
            return
        if self.stack and self.stack[-1][0] == "head" and tag not in HEAD_ONLY:
            self.pop()
        if tag in CLOSES_P:
            self.close_until("p", P_FENCE)
        if tag in ENDS:
            self.end_open(*ENDS[tag])
        if tag in ("td", "th") and self.grids and self.last("tr") <= self.last("table"):
            self.push("tr", {})
        attributes = {}
        if rest.strip(" /\n\t"):
            for name, a, b, c in ATTRIBUTE.findall(rest):
                attributes.setdefault(name.lower(), html.unescape(a or b or c))
        if tag in VOID:
            self.single(tag, attributes)
        else:
            self.push(tag, attributes)

    def last(self, tag: str) -> int:
        """The place of the innermost open tag of this kind, or -1."""
        places = self.places.get(tag)
        return places[-1] if places else -1

    def end_open(self, kinds: set[str], fence: set[str]) -> None:
        """Closes the outermost of these kinds that is open within the innermost fence, and all that it holds."""
        least = max(map(self.last, fence), default=-1)
        depth = len(self.stack)
        for kind in kinds:
            places = self.places.get(kind)
            if places and places[-1] > least:
                depth = min(depth, places[bisect_right(places, least)])
        while len(self.stack) > depth:
            self.pop()

    def close_until(self, tag: str, fence: frozenset[str]) -> bool:
        """Closes the innermost tag of this kind, and all that it holds, unless a fence lies within it."""
        at = self.last(tag)
        if at < 0 or any(self.last(t) > at for t in fence):
            return False
        while len(self.stack) > at:
            self.pop()
        return True

    def end(self, tag: str) -> None:
        if tag == "br":
            self.single("br", {})
        elif tag == "p" and not self.close_until("p", P_FENCE):
            self.push("p", {})
            self.pop()
        elif tag != "p" and tag not in VOID and tag not in ("html", "body"):
            self.close_until(tag, frozenset({"table"}) if tag in ("tr", "thead", "tbody", "tfoot", *CELL_FENCE) and tag != "table" else frozenset() if tag == "table" else CELL_FENCE)

    # the renderer

    def push(self, tag: str, attributes: dict[str, str]) -> None:
        undo = []
        hidden = tag in HIDDEN or "hidden" in attributes or (tag == "dialog" and "open" not in attributes)
        hidden = hidden or bool(NO_DISPLAY.search(attributes.get("style", "")))
        if self.hide and not hidden:
            names = {tag, *(f".{c}" for c in attributes.get("class", "").split()), f"#{attributes.get('id', '')}"}
            hidden = bool(names & self.hide)
        if tag != "summary" and self.stack and self.stack[-1][0] == "details" and "closed" in self.stack[-1][1]:
            hidden = True
        if hidden:
            self.hidden += 1
            undo.append("hidden")
        elif not self.hidden:
            flow = self.flows[-1]
            if tag in BLOCKS and tag not in ("tr", "thead", "tbody", "tfoot"):
                flow.block(2 if tag in PARAGRAPHS and not (tag in ("ul", "ol") and self.lists) else 1)
                undo.append("block")
            if tag in PREFORMATTED:
                self.pre += 1
                self.fresh = tag != "xmp"
                undo.append("pre")
            elif tag in ("ul", "ol", "menu", "dir"):
                self.lists.append([tag == "ol", _integer(attributes.get("start"), 1) - 1])
                undo.append("list")
            elif tag == "li":
                mark = BULLET
                if self.lists and self.lists[-1][0]:
                    self.lists[-1][1] = _integer(attributes.get("value"), self.lists[-1][1] + 1)
                    mark = f"{self.lists[-1][1]}. "
                flow.deeper(len(mark))
                flow.mark = mark
                undo.append("indent")
            elif tag in ("dd", "blockquote"):
                flow.deeper(2)
                undo.append("indent")
            elif tag == "table":
                self.grids.append(Grid() if len(self.grids) < NESTED else None)
                undo.append("table")
            elif tag == "tr" and self.grids:
                self.grids[-1].row() if self.grids[-1] else flow.block(1)
            elif tag in ("td", "th") and self.grids and self.grids[-1]:
                self.flows.append(Flow())
                undo += ["cell", _span(attributes.get("colspan"), MOST_SPAN), _span(attributes.get("rowspan"), MOST_ROWS, MOST_ROWS)]
            elif tag in ("td", "th"):
                flow.text(" ")
            elif tag == "svg":
                self.drawing += 1
                undo.append("drawing")
            elif tag in DRAWN and self.drawing:
                self.drawn += 1
                flow.text(" ")
                undo.append("drawn")
            elif tag == "details" and "open" not in attributes:
                undo.append("closed")
            elif tag == "q":
                flow.text('"')
                undo.append("quote")
        self.places[tag].append(len(self.stack))
        self.stack.append((tag, undo))

    def pop(self) -> None:
        tag, undo = self.stack.pop()
        self.places[tag].pop()
        if "hidden" in undo:
            self.hidden -= 1
        if "quote" in undo:
            self.flows[-1].text('"')
        if "cell" in undo:
            at = undo.index("cell")
            cell = self.flows.pop()
            self.grids[-1].cell(cell.result(), undo[at + 1], undo[at + 2])
        if "table" in undo:
            flow, grid = self.flows[-1], self.grids.pop()
            for line in grid.lines() if grid else ():
                flow.plain(line)
                flow.end()
        if "drawing" in undo:
            self.drawing -= 1
        if "drawn" in undo:
            self.drawn -= 1
            self.flows[-1].text(" ")
        if "list" in undo:
            self.lists.pop()
        if "pre" in undo:
            self.pre -= 1
        if "indent" in undo:
            self.flows[-1].end()
            self.flows[-1].shallower()
        if "block" in undo:
            self.flows[-1].block(2 if tag in PARAGRAPHS and not (tag in ("ul", "ol") and self.lists) else 1)

    def single(self, tag: str, attributes: dict[str, str]) -> None:
        if self.hidden or "hidden" in attributes or NO_DISPLAY.search(attributes.get("style", "")):
            return
        if tag == "br":
            self.flows[-1].newline()
        elif tag == "hr":
            self.flows[-1].block(2)
        elif tag == "input" and attributes.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url"):
            self.flows[-1].text(attributes.get("value", ""))

    def characters(self, s: str, raw: bool = False) -> None:
        if self.hidden or (self.drawing and not self.drawn):
            return
        if s and not (self.stack and "closed" in self.stack[-1][1]):
            s = html.unescape(s) if "&" in s and not raw else s
            if self.pre:
                self.flows[-1].plain(s.removeprefix("\n") if self.fresh else s)
                self.fresh = False
            else:
                self.flows[-1].text(s)

    def styles(self, css: str) -> None:
        """Elements that a rule with one plain selector (tag, .class or #id) does not show; rules for print don't count."""
        outer, at = [], 0
        for brace in BRACE.finditer(css):
            if brace[0] == "{":
                outer.append((css[at : brace.start()], brace.end()))
            elif outer:
                selectors, begin = outer.pop()
                elsewhere = any(s.lstrip().startswith("@") and "print" in s and "screen" not in s for s, _ in outer)
                if not elsewhere and begin >= at and NO_DISPLAY.search(css, begin, brace.start()):
                    self.hide |= {s for s in (x.strip() for x in selectors.split(",")) if SELECTOR.fullmatch(s)}
            at = brace.end()

    def finish(self) -> str:
        while self.stack:
            self.pop()
        return "\n".join(self.flows[0].result())


def render(source: str) -> str:
    """Visible text of a page. Anything is a page: markup that never ends is dropped, stray ``<`` are text."""
    page, at, n = Page(), 0, len(source)
    while at < n:
        tag_at = source.find("<", at)
        if tag_at < 0:
            page.characters(source[at:])
            break
        if tag_at > at:
            page.characters(source[at:tag_at])
        follows = source[tag_at + 1 : tag_at + 2]
        if source.startswith("<!--", tag_at):
            end = source.find("-->", tag_at + 4)
            at = n if end < 0 else end + 3
        elif follows in ("!", "?"):
            end = source.find(">", tag_at)
            at = n if end < 0 else end + 1
        elif follows == "/" or (follows.isascii() and follows.isalpha()):
            m = TAG.match(source, tag_at)
            if not m:
                end = source.find(">", tag_at)
                at = n if end < 0 else end + 1
                continue
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                page.end(tag)
                continue
            page.start(tag, m[3])
            if tag in RAW or tag in ESCAPABLE_RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(source, at)
                inner = source[at : close.start() if close else n]
                if tag == "style":
                    page.styles(inner)
                elif tag in ("textarea", "xmp"):
                    page.characters(inner, raw=tag == "xmp")
                at = close.start() if close else n
        else:
            page.characters("<")
            at = tag_at + 1
    return page.finish()


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, text.

    A null or empty page gives the empty text. Fallbacks of object and the text of svg and math are shown. Repeated rows give a row each; other columns are ignored; an empty table
    gives an empty result. One pass without a shuffle.
    """

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield sources.map(render)

    return pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), text(whole(F.col(f"`{html_col}`"))).alias("text"))
