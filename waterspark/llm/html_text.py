"""Visible text of web pages by layout-aware rendering."""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waterspark.llm.shared import map_slices, text_of

SLICE_CHARS = 1_000_000
#: Tables within more tables than this are laid out as blocks.
TABLE_DEPTH = 12
#: Cells wider than this do not widen their column: they end the alignment of their row.
WIDEST = 120
#: A table whose aligned form is longer than so many times its visible signs and cells is
#: not aligned: its cells stand two spaces apart.
PADDED = 8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
RAW_TEXT = frozenset("title textarea".split())
# Searched in the page itself: lower-casing a page can change its length.
RAW_END = {tag: re.compile(f"(?ai)</{tag}") for tag in RAW | RAW_TEXT}
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes audio video canvas object datalist area base link meta param source track".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul caption xmp".split()
)
#: Blocks with an empty line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr menu dir fieldset xmp".split())
#: A start tag that ends an open paragraph.
ENDS_P = BLOCK - frozenset("body html li dd dt td th tr tbody thead tfoot caption legend option optgroup".split()) | frozenset(["li", "dd", "dt"])
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: Start tag -> open tags that it ends, and the tags beyond which they stay open.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
    "a": ({"a"}, {"table", "td", "th", "div", "li"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]*))?")
TAIL = re.compile(r"[\s/]*>?")
UNSEEN = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!important\s*)?(?:;|$)")
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []


class Tree:
    """Tree builder: end tags may be missing, surplus or crossed."""

    def __init__(self) -> None:
        self.root = Node("", {})
        self.open, self.count = [self.root], {}

    def pop_to(self, place: int) -> None:
        for node in self.open[place:]:
            self.count[node.tag] -= 1
        del self.open[place:]

    def close(self, tags: set[str] | frozenset[str], beyond: set[str] | frozenset[str]) -> None:
        """Close the outermost open one of ``tags`` that no tag of ``beyond`` holds back."""
        if not any(self.count.get(t) for t in tags):
            return
        found = None
        for place in range(len(self.open) - 1, 0, -1):
            tag = self.open[place].tag
            if tag in beyond:
                break
            if tag in tags:
                found = place
        if found:
            self.pop_to(found)

    def start(self, tag: str, attributes: dict[str, str], closed: bool) -> None:
        if tag in ENDS_P and self.count.get("p"):
            self.close({"p"}, {"table", "td", "th", "caption", "button", "object", "template"})
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.pop_to(len(self.open) - 1)
        if tag in IMPLIED:
            self.close(*IMPLIED[tag])
        elif tag in BLOCK and self.open[-1].tag == "head":
            self.pop_to(len(self.open) - 1)
        node = Node(tag, attributes)
        self.open[-1].children.append(node)
        if tag not in VOID and not closed:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag in ("br", "p") and not self.count.get(tag):
            self.start(tag, {}, True)
        elif self.count.get(tag):
            held = {"table"} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else set() if tag in ("table", "body", "html") else {"td", "th", "caption", "template"}
            crossed = False
            for place in range(len(self.open) - 1, 0, -1):
                if self.open[place].tag == tag:
                    if not crossed or tag in BLOCK:
                        self.pop_to(place)
                    elif tag in FORMATTING:  # the blocks opened inside stay open without it
                        self.count[tag] -= 1
                        del self.open[place]
                    break
                if self.open[place].tag in held:
                    break
                crossed = crossed or self.open[place].tag in BLOCK

    def text(self, raw: str) -> None:
        if raw:
            if self.open[-1].tag == "head" and raw.strip():
                self.pop_to(len(self.open) - 1)
            self.open[-1].children.append(raw)


def parse(page: str) -> Node:
    """The tree of a page. Comments, declarations and raw text elements end where browsers
    end them; a tag that the page's end cuts off is dropped. Linear in the page."""
    tree, at = Tree(), 0
    ends: dict[str, int] = {}
    while at < len(page):
        left = page.find("<", at)
        if left < 0:
            tree.text(html.unescape(page[at:]))
            break
        follow = page[left + 1 : left + 2]
        if follow == "/":
            name = NAME.match(page, left + 2)
        else:
            name = NAME.match(page, left + 1)
        if not name and follow not in ("!", "?", "/"):
            right = page.find("<", left + 1)  # a lone sign is text
            right = len(page) if right < 0 else right
            tree.text(html.unescape(page[at:right]))
            at = right
            continue
        tree.text(html.unescape(page[at:left]))
        if page.startswith("<!--", left):
            right = page.find("-->", left + 2)
            at = len(page) if right < 0 else right + 3
        elif not name:
            right = page.find(">", left)
            at = len(page) if right < 0 else right + 1
        else:
            tag, place, attributes = name.group().lower(), name.end(), {}
            while found := ATTRIBUTE.match(page, place):
                value = found.group(2) or ""
                if value[:1] in ("'", '"'):
                    value = value[1:-1] if value[-1] == value[0] and len(value) > 1 else value[1:]
                attributes.setdefault(found.group(1).lower(), html.unescape(value))
                place = found.end()
            closing = TAIL.match(page, place)
            at = closing.end()
            if not closing.group().endswith(">"):
                break
            if follow == "/":
                tree.end(tag)
                continue
            tree.start(tag, attributes, False)
            if tag in RAW or tag in RAW_TEXT:
                if ends.get(tag, 0) < at:  # where the element of this name ends next
                    found = RAW_END[tag].search(page, at)
                    ends[tag] = found.start() if found else len(page)
                body = page[at : ends[tag]]
                tree.text(html.unescape(body) if tag in RAW_TEXT else body)
                at = ends[tag]
            elif tag == "plaintext":
                tree.text(page[at:])
                break
    return tree.root


def unseen(node: Node) -> bool:
    a = node.attributes
    return (
        node.tag in HIDDEN
        or "hidden" in a
        or (node.tag == "input" and a.get("type", "").lower() not in ("submit", "button", "reset"))
        or (node.tag == "dialog" and "open" not in a)
        or ("style" in a and UNSEEN.search(a["style"]) is not None)
    )


def width(text: str) -> int:
    """Columns of a text: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Text being laid out: an open line, pending space, and the empty lines that the next
    text must leave before it."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.parts: list[str] = []
        self.space = self.gap = self.kept = False
        self.indent, self.marker = "", ""

    def put(self, text: str) -> None:
        if not self.parts:
            if self.gap and self.done:
                self.done.append("")
            self.gap = False
            self.parts.append(self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent)
            self.marker = ""
        elif self.space:
            self.parts.append(" ")
        self.space = False
        self.parts.append(text)

    def flow(self, text: str) -> None:
        words = SPACES.split(text)
        if len(words) == 1:
            if words[0]:
                self.put(words[0])
            return
        if words[0]:
            self.put(words[0])
        inner = [w for w in words[1:-1] if w]
        self.space = bool(self.parts) or self.space
        if inner:
            self.put(" ".join(inner))
            self.space = True
        if words[-1]:
            self.put(words[-1])

    def whole(self, text: str) -> None:
        """Preformatted text."""
        for n, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if n:
                self.feed()
            if line:
                self.space = False
                self.put(line)

    def feed(self) -> None:
        """A line break that counts even on an empty line."""
        if self.parts:
            self.done.append("".join(self.parts).rstrip(" "))
        elif self.done and not self.gap:
            self.done.append("")
        self.parts, self.space = [], False

    def block(self, spaced: bool) -> None:
        if self.parts:
            self.done.append("".join(self.parts).rstrip(" "))
            self.parts = []
        self.space = False
        self.gap = self.gap or spaced

    def text(self) -> str:
        self.block(False)
        while self.done and not self.done[-1]:
            self.done.pop()
        return "\n".join(self.done)


def rows_of(table: Node) -> list[list[tuple[Node, int]]]:
    """Cells of a table, each with the columns it spans; other content of the table is
    taken as rows of one cell."""
    rows, groups = [], [iter(table.children)]
    while groups:
        child = next(groups[-1], None)
        if child is None:
            groups.pop()
        elif isinstance(child, str):
            if child.strip():
                cell = Node("td", {})
                cell.children.append(child)
                rows.append([(cell, 1)])
        elif unseen(child) or child.tag in ("col", "colgroup"):
            continue
        elif child.tag in ("tbody", "thead", "tfoot"):
            groups.append(iter(child.children))
        elif child.tag == "tr":
            cells = []
            for cell in child.children:
                if isinstance(cell, str):
                    if not cell.strip():
                        continue
                    node = Node("td", {})
                    node.children.append(cell)
                    cell = node
                elif unseen(cell):
                    continue
                span = cell.attributes.get("colspan", "1").strip()
                cells.append((cell, min(max(int(span), 1), 1000) if span.isascii() and span.isdigit() and len(span) < 5 else 1))
            rows.append(cells)
        else:
            rows.append([(child, 1)])
    return rows


def lay_table(table: Node, depth: int) -> list[str]:
    """Lines of a table with its columns aligned, two spaces apart.

    Columns are as wide as their widest cell of at most ``WIDEST``. Padding is bounded by
    the table's visible signs and cells, whatever its spans and cell heights: beyond that bound the
    table keeps all its text, row by row, without alignment.
    """
    laid = [[(render(cell, depth + 1).split("\n"), span) for cell, span in row] for row in rows_of(table)]
    laid = [row for row in laid if any(line for lines, _ in row for line in lines)]
    widths: dict[int, int] = {}
    for row in laid:
        column = 0
        for lines, span in row:
            if span == 1 and len(row) > 1:
                widest = max(map(width, lines))
                widths[column] = max(widths.get(column, 0), widest if widest <= WIDEST else 0)
            column += span
    rooms, aligned, signs, cells = [], 0, 0, 0
    upto = [0]
    for c in range(max((sum(span for _, span in row) for row in laid), default=0)):
        upto.append(upto[-1] + widths.get(c, 0) + 2)
    for row in laid:
        column, own = 0, []
        for _, span in row:
            own.append(upto[column + span] - upto[column] - 2)
            column += span
        rooms.append(own)
        cells += len(row)
        aligned += (sum(own) + 2 * len(own)) * max(len(lines) for lines, _ in row)
        signs += sum(len(line) - line.count(" ") for lines, _ in row for line in lines)
    if aligned > PADDED * (signs + cells):
        return [line for row in laid for line in unaligned([lines for lines, _ in row])]
    out = []
    for row, own in zip(laid, rooms):
        for n in range(max(len(lines) for lines, _ in row)):
            parts = []
            for (lines, _), room in zip(row, own):
                line = lines[n] if n < len(lines) else ""
                parts.append(line + " " * max(0, room - width(line)))
            out.append("  ".join(parts).rstrip(" "))
    return out


def unaligned(cells: list[list[str]]) -> list[str]:
    """Lines of a row whose cells stand two spaces apart, empty ones left out. The work is
    that of the lines there are, not of cells times the highest one."""
    out: list[list[str]] = [[] for _ in range(max(map(len, cells)))]
    for lines in cells:
        for n, line in enumerate(lines):
            if line:
                out[n].append(line)
    return ["  ".join(parts) for parts in out]


def render(root: Node, depth: int = 0) -> str:
    """Visible text below a node: blocks on lines of their own, list items marked and
    indented, tables aligned. Works along a stack, so nesting has no limit."""
    lines = Lines()
    # (node, its next child, what to restore when it ends)
    stack: list[list] = [[root, iter(root.children), False, lines.indent, None]]
    while stack:
        node, children, kept, indent, number = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            lines.indent = indent
            if node is not root and node.tag in BLOCK:
                nested = node.tag in ("ul", "ol", "menu", "dir") and any(f[0].tag == "li" for f in stack[-1:])
                lines.block(node.tag in SPACED and not nested)
                lines.marker = ""
            continue
        if isinstance(child, str):
            lines.whole(child) if kept else lines.flow(child)
            continue
        if unseen(child):
            continue
        tag = child.tag
        if tag == "br":
            lines.feed()
            continue
        if tag == "wbr":
            continue
        if tag == "input":
            lines.flow(child.attributes.get("value", ""))
            continue
        held = lines.indent
        if tag in BLOCK:
            nested = tag in ("ul", "ol", "menu", "dir") and node.tag == "li"
            if not lines.marker or lines.parts or tag == "li":
                lines.block(tag in SPACED and not nested)
        if tag == "table" and depth < TABLE_DEPTH:
            for line in lay_table(child, depth):
                if line:
                    lines.put(line)
                lines.feed()
            lines.block(True)
            continue
        first = None
        if tag == "ol":
            start = child.attributes.get("start", "1").strip()
            first = [int(start) if re.fullmatch("-?[0-9]{1,9}", start) else 1]
        elif tag == "li":
            counter = number if node.tag == "ol" else None
            mark = "- " if counter is None else f"{counter[0]}. "
            if counter is not None:
                counter[0] += 1
            lines.indent, lines.marker = held + " " * len(mark), mark
        elif tag == "dd" or tag == "blockquote":
            lines.indent = held + "  "
        stack.append([child, iter(child.children), kept or tag in ("pre", "xmp", "textarea", "listing", "plaintext"), held, first])
    return lines.text()


def page_text(page: str) -> str:
    """Visible text of one page."""
    return render(parse(page))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of every row: all visible text of the whole page.

    A null or empty page has an empty text; repeated rows repeat; other columns do not
    matter; broken markup never fails; a text is of the order of its page's size, as tables
    that would need more padding are not aligned. Row by row in Arrow slices, without a shuffle.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(page_text, batch.column(1).to_pylist()), pa.string())], names=["page_id", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    slim = pages.select(F.col(id_col).alias("page_id"), text_of(html_col).alias("html"))
    return map_slices(slim, "html", SLICE_CHARS, f"page_id {kind}, text string", work)
