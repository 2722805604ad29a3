"""Operator 10: visible text of HTML pages with its layout.

A tokenizer finds tags, comments and text; a tree builder opens and closes elements with implied
tags (a paragraph ends before a block, list items, rows, cells, options and definition terms end
before the next, a closing tag closes what is open inside it, stray ones are ignored), and never
holds more than the open elements, so deep and long pages are safe. Visibility rules leave out what
browsers do not draw: head, script, style, template, noscript and the like, fallback content, an svg's
title, desc, defs and metadata, a formula's annotations, elements that are ``hidden`` or styled
``display:none``, dialogs without ``open``, and of details without ``open`` all but the first summary.
``visibility:hidden`` hides text but not the place of its cell, and ``visibility:visible`` inside it shows again.
What is only ``aria-hidden`` is seen.

Rendering keeps the order of the page: runs of white space collapse to a space, blocks start
lines, paragraphs and headings stand between blank lines, ``br`` breaks a line, list items get a marker
and the indent of their depth (numbers in ordered lists), preformatted text keeps its white space,
and tables are laid out with their columns aligned, parted by `` | ``: each cell is padded to the widest of its
column, ``colspan`` covers the columns and ``rowspan`` the rows that it says (to the end of the row group at most). Lines of
cells go on below after CELL_WIDTH characters, at a space where there is one; those of the last column, which
nothing follows, are left whole. A table inside a table is rendered inside its cell.

Result: page_id, text, n_chars, n_blocks (lines with text), n_cells, n_items.

Cases: null and empty html give an empty text. Unclosed elements end with the page; unclosed
comments and tags are taken as text ends there (comments) or dropped (tags). Rows are independent:
repeated rows give equal rows, null ids stay, extra columns are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hornspark.llm.common import int64, small_batches

#: Characters of a line in a cell that another column follows.
CELL_WIDTH = 60

#: Kinds of elements in the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist rp defs desc metadata annotation annotation-xml".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset".split())
BLOCK = PARAGRAPH | frozenset("address article aside body center details dialog dd div dt fieldset figcaption footer form header hgroup hr html legend li main menu nav option search section summary tr td th caption".split())
#: Elements that a start tag ends first, and the elements at which the search for them stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
_P_ENDS = BLOCK - {"td", "th", "tr", "caption", "body", "html", "option"}
_P_STOPS = frozenset({"td", "th", "caption", "button", "table", "object", "html"})

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HINT = re.compile(r"hidden|start|style|open|span", re.I)


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


def styles(text: str) -> dict[str, str]:
    """The declarations of a style attribute; the last of a name counts."""
    parts = (d.split(":", 1) for d in text.lower().split(";") if ":" in d)
    return {name.strip(): value.replace("!important", "").strip() for name, value in parts}


def span(text: str | None, most: int) -> int:
    """A colspan or rowspan; 1 where there is no number."""
    m = re.match(r"\s*\+?(\d{1,9})", text or "")
    return min(int(m[1]), most) if m else 1


def folded(line: str, width: int) -> Iterator[str]:
    """The line in pieces of at most ``width`` characters, cut at spaces where there are any."""
    while len(line) > width:
        at = line.rfind(" ", 1, width + 1)
        yield line[: at if at > 0 else width]
        line = line[at + 1 if at > 0 else width :]
    yield line


class Flow:
    """Lines of a block of text: the page, or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = False
        self.prefix = ""

    def text(self, s: str) -> None:
        parts = _SPACE.sub(" ", s)
        if not parts:
            return
        if parts[0] == " ":
            self.space = True
        core = parts.strip(" ")
        if not core:
            return
        if not self.line and self.gap and self.lines:
            self.lines.append("")
        if not self.line:
            self.gap = False
            if self.prefix:
                self.line.append(self.prefix)
                self.prefix = ""
        elif self.space and not self.line[-1].endswith(" "):
            self.line.append(" ")
        self.line.append(core)
        self.space = parts[-1] == " "

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def end_paragraph(self) -> None:
        self.end_line()
        self.gap = True

    def verbatim(self, s: str) -> None:
        first, *rest = s.split("\n")
        if first.strip():
            if not self.line and self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.line.append(first)
        for x in rest:
            if self.line or self.lines:
                self.lines.append("".join(self.line).rstrip())
            self.line = [x] if x.strip() else []

    def block(self, lines: list[str]) -> None:
        self.end_line()
        if lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.lines += lines
            self.gap = True

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Table:
    def __init__(self, outer: Flow):
        self.outer = outer
        self.rows: list[list[tuple[list[str], int, int]]] = []  # lines, columns and rows of each cell
        self.groups: list[int] = []
        self.group = 0
        self.caption: list[str] = []

    def new_row(self) -> None:
        self.rows.append([])
        self.groups.append(self.group)

    def placed(self) -> list[list[tuple[int, int, list[str]]]]:
        """The rows' cells as (first column, column after the last, lines); columns are those that some cell begins or ends at."""
        out, held = [], []  # held: columns that cells of earlier rows cover, and for how many rows
        for k, row in enumerate(self.rows):
            if k and self.groups[k] != self.groups[k - 1]:
                held = []
            taken, cells, x, i, later = sorted(held), [], 0, 0, []
            for lines, wide, tall in row:
                while i < len(taken) and taken[i][0] <= x:
                    x = max(x, taken[i][1])
                    i += 1
                end = min(x + wide, taken[i][0]) if i < len(taken) else x + wide
                cells.append((x, end, lines))
                if tall != 1:
                    later.append((x, end, tall - 1 if tall else len(self.rows)))
                x = end
            held = [(a, b, n - 1) for a, b, n in held if n > 1] + later
            out.append(cells)
        edges = {x: i for i, x in enumerate(sorted({0, *(x for row in out for a, b, _ in row for x in (a, b))}))}
        return [[(edges[a], edges[b], lines) for a, b, lines in row] for row in out]

    def render(self) -> list[str]:
        rows = self.placed()
        last = max((b for row in rows for _, b, _ in row), default=0)
        width = [0] * last
        fitted: dict[tuple[int, int], list[str]] = {}
        inner = sorted(((b - a, r, a, b, lines) for r, row in enumerate(rows) for a, b, lines in row if b < last), key=lambda c: c[:3])
        for n, r, a, b, lines in inner:  # narrow cells first
            room = sum(width[a:b]) + 3 * (n - 1)
            own = fitted[r, a] = [x for line in lines for x in folded(line, CELL_WIDTH if n == 1 else max(CELL_WIDTH, room))]
            width[b - 1] += max(0, max(map(len, own), default=0) - room)
        out = list(self.caption)
        for r, row in enumerate(rows):
            cells, x = [], 0  # (width, lines) from the left, blanks too
            for a, b, lines in row:
                cells += [(width[c], []) for c in range(x, a)]
                cells.append((sum(width[a:b]) + 3 * (b - a - 1) if b < last else 0, fitted.get((r, a), lines)))
                x = b
            for k in range(max((len(own) for _, own in cells), default=0)):
                out.append(" | ".join((own[k] if k < len(own) else "").ljust(w) for w, own in cells).rstrip())
        return [x for x in out if x.strip(" |")]


class Renderer:
    def __init__(self) -> None:
        self.flow = Flow()
        self.open: list[tuple[str, int, bool, object]] = []  # tag, what it adds to unseen, visibility before, what it opened
        self.names: dict[str, int] = {}
        self.unseen = 0
        self.visible = True
        self.summaries: list[list] = []  # per details without ``open``: its place among the open elements, and whether its summary was there
        self.lists: list[list] = []
        self.pre = 0
        self.cells = self.items = 0

    def render(self, source: str) -> list[str]:
        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                self.text(source[at:])
                break
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.close(tag)
            elif m[4]:
                self.start(tag, m[3])
                if tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                    stop = end.start() if end else n
                    self.text(source[at:stop])
                    at = stop
        while self.open:
            self.pop()
        return self.flow.done()

    def text(self, s: str) -> None:
        if self.unseen or not self.visible:
            return
        s = html.unescape(s) if "&" in s else s
        if self.pre:
            self.flow.verbatim(s)
        else:
            self.flow.text(s)

    def start(self, tag: str, rest: str) -> None:
        if tag in _P_ENDS and self.names.get("p"):
            self.end_within({"p"}, _P_STOPS)
        if tag in ENDS:
            self.end_within(*ENDS[tag])
        if self.names.get("head") and tag not in HIDDEN and tag not in ("meta", "link", "base"):
            self.end_within({"head"}, {"body"})
        attrs = attributes(rest) if _HINT.search(rest) else {}
        style = styles(attrs["style"]) if "style" in attrs else {}
        hides = tag in HIDDEN or "hidden" in attrs or style.get("display") == "none" or (tag == "dialog" and "open" not in attrs)
        before, adds = self.visible, int(hides)
        if tag == "summary" and self.summaries and self.summaries[-1] == [len(self.open) - 1, False]:
            self.summaries[-1][1] = True
            adds -= 1
        if style.get("visibility") in ("hidden", "collapse", "visible", "initial"):
            self.visible = style["visibility"] in ("visible", "initial")
        if tag in VOID:
            if not self.unseen and not hides and self.visible:
                if tag == "br":
                    self.flow.end_line()
                elif tag == "hr":
                    self.flow.end_paragraph()
            self.visible = before
            return
        made: object = None
        if self.unseen + adds <= 0:
            made = self.begin(tag, attrs)
        if tag == "details" and "open" not in attrs:
            self.summaries.append([len(self.open), False])
            adds += 1
        self.open.append((tag, adds, before, made))
        self.names[tag] = self.names.get(tag, 0) + 1
        self.unseen += adds

    def begin(self, tag: str, attrs: dict[str, str]) -> object:
        if tag == "table":
            self.flow.end_line()
            made = Table(self.flow)
            self.flow = Flow()  # text between cells comes before the table
            return made
        if tag in ("td", "th", "caption"):
            table = self.table()
            if table is not None:
                if tag != "caption" and not table.rows:
                    table.new_row()
                before, self.flow = self.flow, Flow()
                return before, max(1, span(attrs.get("colspan"), 1000)), span(attrs.get("rowspan"), 65534)
        if tag in ("tr", "thead", "tbody", "tfoot") and (table := self.table()) is not None:
            if tag == "tr":
                table.new_row()
            else:
                table.group += 1
            return None
        if tag in PARAGRAPH:
            nested = tag in ("ul", "ol") and self.lists
            self.flow.end_line() if nested else self.flow.end_paragraph()
        elif tag in BLOCK:
            self.flow.end_line()
        if tag in ("ul", "ol", "menu"):
            first = attrs.get("start", "1")
            self.lists.append([tag, int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1])
        elif tag == "li" and self.visible:
            self.items += 1
            depth = max(0, len(self.lists) - 1)
            mark = "- "
            if self.lists and self.lists[-1][0] == "ol":
                mark = f"{self.lists[-1][1]}. "
                self.lists[-1][1] += 1
            self.flow.prefix = "  " * depth + mark
        elif tag == "pre":
            self.pre += 1
        return True

    def table(self) -> Table | None:
        if not self.names.get("table"):
            return None
        return next((m for *_, m in reversed(self.open) if isinstance(m, Table)), None)

    def pop(self) -> None:
        tag, adds, self.visible, made = self.open.pop()
        self.names[tag] -= 1
        self.unseen -= adds
        if self.summaries and self.summaries[-1][0] == len(self.open):
            self.summaries.pop()
        if made is None:
            return
        if isinstance(made, Table):
            loose = self.flow.done()
            self.flow = made.outer
            self.flow.block([*loose, *made.render()])
            return
        if isinstance(made, tuple):
            lines, self.flow = self.flow.done(), made[0]
            table = self.table()
            if tag == "caption":
                table.caption += lines
            else:
                self.cells += 1
                table.rows[-1].append((lines, *made[1:]))
            return
        if tag in ("ul", "ol", "menu") and self.lists:
            self.lists.pop()
            self.flow.end_line() if self.lists else self.flow.end_paragraph()
        elif tag == "li":
            self.flow.end_line()
            self.flow.prefix = ""
        elif tag == "pre":
            self.pre -= 1
            self.flow.end_paragraph()
        elif tag in PARAGRAPH:
            self.flow.end_paragraph()
        elif tag in BLOCK:
            self.flow.end_line()

    def end_within(self, tags, stops) -> None:
        """Close all open elements named in ``tags``, out to the nearest of ``stops``."""
        if not any(self.names.get(t) for t in tags):
            return
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.open[k][0]
            if tag in stops:
                return
            if tag in tags:
                while len(self.open) > k:
                    self.pop()
                if not any(self.names.get(t) for t in tags):
                    return

    def close(self, tag: str) -> None:
        if tag == "p" and not self.names.get("p") and not self.unseen:
            self.flow.end_paragraph()
        if not self.names.get(tag):
            return
        inner = tag in ("td", "th", "tr", "table", "thead", "tbody", "tfoot", "body", "html")
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == tag:
                while len(self.open) > k:
                    self.pop()
                return
            if not inner and name in ("td", "th", "table"):
                return


def page_text(source: str | None) -> tuple[str, int, int, int]:
    """(text, lines with text, cells, items) of a page."""
    if not source:
        return "", 0, 0, 0
    r = Renderer()
    lines = r.render(source)
    return "\n".join(lines), sum(1 for x in lines if x), r.cells, r.items


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [page_text(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), int64([len(f[0]) for f in found]), *(int64([f[i] for f in found]) for i in (1, 2, 3))], ["page_id", "text", "n_chars", "n_blocks", "n_cells", "n_items"])


def layout_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    small_batches(spark)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(_extract, f"page_id {kind}, text string, n_chars long, n_blocks long, n_cells long, n_items long")
