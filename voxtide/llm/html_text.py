"""Layout-aware text of HTML: a tree with implied tags, visibility rules, and a renderer for blocks, lists and tables.

All visible text comes out, in reading order, as a browser would lay it out on a character grid: blocks are separated
by line breaks (paragraph-like ones by an empty line), list items are marked and indented, table cells are
aligned in columns, preformatted text keeps its white space. Hidden text (head, scripts, styles, templates, elements hidden by
attribute or inline style, closed details and dialogs, media and their fallbacks, what SVG defines without drawing it) does not.

A narrow pass: one page at a time, no shuffle. Time and memory follow the page's length: nesting is held to
``DEPTH`` levels (deeper elements become flat, their visible text stays), and a cell pads its column up to ``PAD`` characters.

Defined cases: a null page has null text, an empty one empty text; an empty table gives an empty result; broken markup never
raises: what is no tag is text; very long and hostile pages take time in proportion to their length; a null page_id is kept as
such; repeated rows get equal results; columns other than the two named are not read, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.llm.common import gives_back

DEPTH = 120
PAD = 80
SPAN = 1000
#: A cell beyond so many columns covers no rows below its own; a table that would need more blanks than this, and than eight times its text, isn't aligned.
COLUMNS, BLANKS = 256, 1 << 16

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head script style template title noembed noframes iframe datalist area base link meta param source track rp object audio video canvas".split())
#: What these draw nothing of by itself, or say twice.
FOREIGN = {"svg": frozenset("desc metadata defs symbol clippath mask pattern marker".split()), "math": frozenset(["annotation", "annotation-xml"])}
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure form fieldset menu xmp listing plaintext".split())
BLOCK = SPACED | frozenset("html body address article aside center dd details dialog dir div dt figcaption footer header hgroup hr legend li main nav option optgroup search section summary caption".split())
CLOSES_P = (BLOCK - frozenset("html body li dd dt option optgroup caption legend".split())) | frozenset(["hr"])
CELLS, ROWS, GROUPS = frozenset(["td", "th"]), frozenset(["tr"]), frozenset(["thead", "tbody", "tfoot"])
#: A start tag closes open elements of these names, unless an element of the scope comes first.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (CELLS | ROWS | frozenset(["caption", "colgroup"]), frozenset(["table"])),
    "td": (CELLS | frozenset(["caption", "colgroup"]), frozenset(["table", "tr"])),
    "th": (CELLS | frozenset(["caption", "colgroup"]), frozenset(["table", "tr"])),
    "thead": (CELLS | ROWS | GROUPS | frozenset(["caption", "colgroup"]), frozenset(["table"])),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
}
IMPLIED |= {"tbody": IMPLIED["thead"], "tfoot": IMPLIED["thead"], "body": (frozenset(["head"]), frozenset())}

# A quote opens a value only right after "=", as in the HTML standard's attribute states; an unclosed one is part of a name.
_VALUE = r"\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?"
_NAME = r"(?:=|[^\s/>=])[^\s/>=]*+"
_TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:{re.sub(r'[(](?=[^?])', '(?:', _VALUE)})?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_VALUE})?+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Element:
    __slots__ = ("children", "name", "raw")

    def __init__(self, name: str, raw: str = "") -> None:
        self.name, self.raw = name, raw
        self.children: list[Element | str] = []

    def get(self, attribute: str) -> str | None:
        for name, *values in _ATTRIBUTE.findall(self.raw) if self.raw else ():
            if name.lower() == attribute:
                return html.unescape(next(filter(None, values), ""))
        return None

    def number(self, attribute: str, default: int, least: int, most: int) -> int:
        found = re.match(r"\s*(-?\d{1,9})", self.get(attribute) or "")
        return min(most, max(least, int(found[1]))) if found else default

    def hidden(self) -> bool:
        if self.name in HIDDEN:
            return True
        low = self.raw.lower()
        if not self.raw or not ("hidden" in low or "style" in low or self.name in ("dialog", "input")):
            return self.name == "dialog"
        if self.get("hidden") is not None or _UNSEEN.search(self.get("style") or ""):
            return True
        return (self.name == "dialog" and self.get("open") is None) or (self.name == "input" and (self.get("type") or "").lower() == "hidden")


def parse(source: str) -> Element:
    """The document's tree. End tags without a start are dropped (``</p>`` is an empty paragraph, ``</br>`` a break)."""
    root = Element("#root")
    stack, at, size = [root], 0, len(source)
    deep: list[tuple[str, bool]] = []  # name of each open element past DEPTH, and whether it hides its text
    names_deep: Counter[str] = Counter()
    unseen = 0

    def leave() -> str:
        nonlocal unseen
        name, hides = deep.pop()
        names_deep[name] -= 1
        unseen -= hides
        return name

    def close(names: frozenset, scope: frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                top = i
                while top > 1 and stack[top - 1].name in names and names is not IMPLIED["li"][0]:
                    top -= 1
                del stack[top:]
                return
            if stack[i].name in scope:
                return

    while at < size:
        found = _TAG.search(source, at)
        start = found.start() if found else size
        if start > at and not unseen:
            stack[-1].children.append(html.unescape(source[at:start]) if "&" in source[at:start] else source[at:start])
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        name = found[2].lower()
        if found[1]:
            if names_deep[name]:
                while leave() != name:
                    pass
                continue
            if name in ("p", "br") and not unseen:
                if name == "br" or not any(e.name == "p" for e in stack):
                    stack[-1].children.append(Element(name))
                    continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    while deep:
                        leave()
                    break
                if stack[i].name in CELLS | {"table"} and name not in CELLS | ROWS | GROUPS | {"table"}:
                    break
            continue
        if deep:
            closed = IMPLIED[name][0] if name in IMPLIED else frozenset()
            while deep and (deep[-1][0] in closed or deep[-1][0] == "p" and name in CLOSES_P):
                leave()
        elif name in CLOSES_P:
            close(frozenset(["p"]), frozenset("td th table li dd dt button caption div section article".split()))
        if name in IMPLIED and not deep:
            close(*IMPLIED[name])
        drawn = any(name in unshown and (names_deep[e] or any(x.name == e for x in stack)) for e, unshown in FOREIGN.items())
        element = Element(name, f" hidden {found[3]}" if drawn else found[3])
        if not unseen:
            stack[-1].children.append(element)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            text = source[at : end.start() if end else size]
            element.children.append(html.unescape(text) if name in ("textarea", "title") else text)
            at = end.end() if end else size
        elif name == "plaintext":
            element.children.append(source[at:])
            break
        elif name not in VOID and not found[3].endswith("/") or name not in VOID and name in BLOCK:
            if len(stack) < DEPTH and not deep:
                stack.append(element)
            else:
                deep.append((name, element.hidden()))
                names_deep[name] += 1
                unseen += deep[-1][1]
    return root


class Flow:
    """Lines of text being laid out; ``want`` empty lines are owed before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space, self.want = False, 0

    def text(self, text: str) -> None:
        flat = _SPACE.sub(" ", text)
        if not flat:
            return
        if flat[0] == " ":
            self.space, flat = True, flat[1:]
        if not flat:
            return
        if self.now:
            if self.space:
                self.now.append(" ")
        else:
            self._pay()
        self.space = flat[-1] == " "
        self.now.append(flat[:-1] if self.space else flat)

    def _pay(self) -> None:
        if self.lines:
            self.lines += [""] * self.want
        self.want = 0

    def line(self) -> None:
        if self.now:
            self.lines.append("".join(self.now))
            self.now = []
        self.space = False

    def gap(self, lines: int) -> None:
        self.line()
        self.want = max(self.want, lines)

    def brk(self) -> None:
        if self.now:
            self.line()
        else:
            self.want += 1

    def block(self, lines: list[str]) -> None:
        self.line()
        if lines:
            self._pay()
            self.lines += lines


def lay_out(children: list[Element | str], pre: bool = False, depth: int = 0) -> list[str]:
    flow = Flow()
    _into(flow, children, pre, depth)
    flow.line()
    return flow.lines


def _into(flow: Flow, children: list[Element | str], pre: bool, depth: int) -> None:
    for child in children:
        if isinstance(child, str):
            if pre:
                head, *more = child.replace("\r\n", "\n").replace("\r", "\n").expandtabs(8).split("\n")
                for i, part in enumerate([head, *more]):
                    if i:
                        if not flow.now:
                            flow._pay()
                        flow.lines.append("".join(flow.now))
                        flow.now = []
                    if part:
                        if not flow.now:
                            flow._pay()
                        flow.now.append(part)
            else:
                flow.text(child)
        elif child.hidden():
            continue
        elif child.name in ("br", "wbr"):
            if child.name == "br":
                flow.brk()
        elif child.name == "hr":
            flow.gap(1)
        elif child.name == "input":
            if (child.get("type") or "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number"):
                flow.text(f" {child.get('value') or ''} ")
        elif child.name == "table":
            flow.gap(1)
            flow.block(_table(child, depth + 1))
            flow.gap(1)
        elif child.name in ("ul", "ol", "menu", "dir"):
            flow.gap(0 if depth else 1)
            flow.block(_list(child, depth + 1))
            flow.gap(0 if depth else 1)
        elif child.name in ("blockquote", "dd"):
            flow.gap(child.name == "blockquote")
            flow.block(["  " + x if x else x for x in lay_out(child.children, pre, depth)])
            flow.gap(child.name == "blockquote")
        elif child.name in ("pre", "xmp", "listing", "plaintext", "textarea"):
            flow.gap(1)
            lines = lay_out(child.children, True, depth)
            while lines and not lines[-1].strip():
                lines.pop()
            flow.block(lines[1:] if lines and not lines[0] else lines)
            flow.gap(1)
        elif child.name == "details" and child.get("open") is None:
            flow.gap(0)
            _into(flow, [c for c in child.children if isinstance(c, Element) and c.name == "summary"][:1], pre, depth)
            flow.gap(0)
        elif child.name in BLOCK:
            flow.gap(child.name in SPACED)
            _into(flow, child.children, pre, depth)
            flow.gap(child.name in SPACED)
        elif child.name in CELLS or child.name == "text":  # a cell outside any table, a text of a drawing
            flow.text(" ")
            _into(flow, child.children, pre, depth)
            flow.text(" ")
        else:
            _into(flow, child.children, pre, depth)


def _list(element: Element, depth: int) -> list[str]:
    lines: list[str] = []
    number = element.number("start", 1, -(10**9), 10**9) if element.name == "ol" else 0
    loose: list[Element | str] = []

    def flush() -> None:
        if loose:
            lines.extend("  " + x if x else x for x in lay_out(loose, False, depth))
            loose.clear()

    for child in element.children:
        if isinstance(child, Element) and child.name == "li":
            flush()
            if child.hidden():
                continue
            mark = "- "
            if element.name == "ol":
                number = child.number("value", number, -(10**9), 10**9)
                mark, number = f"{number}. ", number + 1
            inner = lay_out(child.children, False, depth)
            lines += [(mark if i == 0 else " " * len(mark)) + x if x or i == 0 else x for i, x in enumerate(inner)]
        else:
            loose.append(child)
    flush()
    return lines


def _table(table: Element, depth: int) -> list[str]:
    """Captions and stray content first, then the rows: head, bodies, foot."""
    parts: dict[str, list[list[Element]]] = {"thead": [], "tbody": [], "tfoot": []}
    outside: list[Element | str] = []

    def rows_of(parent: Element, into: list[list[Element]]) -> None:
        open_row: list[Element] | None = None
        for child in parent.children:
            if isinstance(child, str):
                if child.strip():
                    outside.append(child)
            elif child.name in GROUPS:
                open_row = None
                if not child.hidden():
                    rows_of(child, parts[child.name])
            elif child.name == "tr":
                open_row = None
                if not child.hidden():
                    cells = [c for c in child.children if isinstance(c, Element) and c.name in CELLS]
                    into.append(cells)
                    outside.extend(c for c in child.children if (c.strip() if isinstance(c, str) else c.name not in CELLS))
            elif child.name in CELLS:  # an implied row
                if open_row is None:
                    into.append(open_row := [])
                open_row.append(child)
            elif child.name not in ("col", "colgroup"):
                outside.append(child)

    rows_of(table, parts["tbody"])
    grid: list[list[tuple[int, int, bool, list[str]]]] = []
    taken: list[tuple[int, int, int]] = []  # (first column, the one after, row) that cells above cover up to a row, by column
    expires = 0
    for number, cells in enumerate(parts["thead"] + parts["tbody"] + parts["tfoot"]):
        row, column, below, past = [], 0, [], 0
        if taken and number >= expires:
            taken = [x for x in taken if x[2] > number]
            expires = min((x[2] for x in taken), default=0)
        for cell in cells:
            if cell.hidden():
                continue
            while past < len(taken) and taken[past][0] <= column:
                column, past = max(column, taken[past][1]), past + 1
            wide, tall = cell.number("colspan", 1, 1, SPAN), cell.number("rowspan", 1, 1, 65534)
            right = (cell.get("align") or "").lower() == "right" or "text-align:right" in (cell.get("style") or "").replace(" ", "").lower()
            row.append((column, wide, right, lay_out(cell.children, False, depth)))
            if tall > 1 and column + wide <= COLUMNS:
                below.append((column, column + wide, number + tall))
            column += wide
        if below:
            taken = sorted([*taken, *below])
            expires = min(x[2] for x in taken)
        grid.append(row)
    widths: dict[int, int] = {}
    for span_first in (True, False):
        for row in grid:
            for column, wide, _, lines in row:
                need = min(PAD, max(map(len, lines), default=0))
                if wide == 1 and span_first:
                    widths[column] = max(widths.get(column, 0), need)
                elif wide > 1 and not span_first:
                    have = sum(widths.get(c, 0) for c in range(column, column + wide)) + 2 * (wide - 1)
                    widths[column + wide - 1] = widths.get(column + wide - 1, 0) + max(0, need - have)
    used = sorted(c for c, w in widths.items() if w)
    left, x = {}, 0
    for c in used:
        left[c], x = x, x + widths[c] + 2
    out = lay_out(outside, False, depth)
    text = sum(len(line) for row in grid for *_, lines in row for line in lines)
    ends = [max((left.get(column, 0) for column, *_ in row), default=0) * max((len(lines) for *_, lines in row), default=0) for row in grid]
    if sum(ends) > max(BLANKS, 8 * text):  # mostly blanks: two of them part the cells
        left = {}
    for row in grid:
        for i in range(max((len(lines) for *_, lines in row), default=0)):
            line = ""
            for column, wide, right, lines in row:
                if i < len(lines) and lines[i]:
                    own = [c for c in range(column, column + wide) if c in left] if left else []
                    begin = left[own[0]] if own else len(line) + 2
                    room = left[own[-1]] + widths[own[-1]] - begin if own else 0
                    text = lines[i].rjust(room) if right else lines[i]
                    line = line.ljust(begin if len(line) <= begin else len(line) + 2) + text
            out.append(line.rstrip())
    return out


def render(source: str) -> str:
    lines = [x.rstrip(" ") for x in lay_out(parse(source).children)]
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                text = [None if x is None else render(x) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["page_id", "text"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(gives_back(run), "page_id long, text string")
