"""HTML to text as a browser would lay it out.

A tokenizer reads tags, text, comments and raw-text elements in one pass over the page; the tree builder
supplies the end tags that HTML lets authors leave out (a new ``<li>`` ends the last one, a block ends an
open ``<p>``, a row ends cells, ...) and ignores stray ones.  The renderer then walks the tree.  What is
displayed and visible, and whether white space counts, is decided from inline styles and the page's ``<style>`` rules
whose selectors are a tag, a class, an id, or a tag with one of these (others, and rules for print or inside ``@``
blocks, are not applied): undisplayed subtrees give nothing, visibility and white space are inherited, so a visible
part of a hidden one is shown.  White space else collapses except inside ``<pre>``; blocks stand on lines of their own
with a blank line around paragraphs and headings; list items get bullets or numbers (``start``, ``value`` and
``reversed`` count) and are indented by depth; a table's cells lie on a grid, over the rows and columns that they span,
padded to common column widths.  Text areas, drop-downs (the option that is chosen), the values of text boxes and buttons,
open dialogs and the text of drawings are visible, and so is what ``aria-hidden`` keeps from screen readers only.  Of closed
``<details>`` the summary shows.

Padding and indentation are bounded, the text is not: cells longer than ``MOST_PADDED`` don't widen their
column, indentation ends at ``MOST_INDENT``, rows that would take the page's padding beyond
``PADDING_FACTOR`` times its own length have their cells below each other instead, and so have all rows of tables that are nested
deeper than ``MOST_TABLES``; spans end at column ``MOST_COLUMNS``.

Defined results: a null or empty page, or one without visible text, gives an empty text.  Broken
markup never fails; a tag that is still open at the page's end is dropped, as browsers do.  Nesting
deeper than ``MAX_DEPTH`` is flattened: its text stays.  Columns of the input that are named as a result
is are replaced by it; all others are carried through, repeated rows and null ids too.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts, without

MAX_DEPTH = 200
MOST_PADDED, MOST_INDENT, PADDING_FACTOR, MOST_TABLES, MOST_COLUMNS = 40, 40, 16, 6, 100
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INVISIBLE = frozenset("head script style template noscript title meta link object iframe noembed noframes canvas audio video datalist".split())
#: Parts of drawings that are not drawn.
UNDRAWN = frozenset("desc metadata defs".split())
#: Kinds of input that show their value.
SHOWN_INPUT = frozenset("text search email url tel number submit button reset".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table ul tr caption thead tbody tfoot menu dialog xmp plaintext".split())
SPACED = frozenset("xmp plaintext p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure article section menu".split())
#: A start tag of the first ends an open element of the second, unless one of the third is nearer.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, set()),
}
#: End tags reach no further up than these.
SCOPE = frozenset({"table", "td", "th", "caption", "html"})

#: One attribute: its name, and what stands before an equals sign's value.
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(\s*=\s*)?")
BARE_VALUE = re.compile(r"[^\s>]*")
TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*")
TAG_END = re.compile(r"[\s/]*>")
SELECTOR = re.compile(r"([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?", re.IGNORECASE)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
SCREEN = re.compile(r"(?i)\b(?:all|screen)\b")
#: The style properties that decide what is shown.
DECIDING = frozenset({"display", "visibility", "white-space"})
#: How white space counts: collapsed, as it stands, or line ends only.
COLLAPSED, AS_IT_STANDS, LINES = range(3)
SPACE_MODES = {"normal": COLLAPSED, "nowrap": COLLAPSED, "pre": AS_IT_STANDS, "pre-wrap": AS_IT_STANDS, "break-spaces": AS_IT_STANDS, "pre-line": LINES}
WHOLE = re.compile(r"\s*([+-]?\d{1,9})")
NUMBERED = re.compile(r"&#(?:[xX]0*([0-9a-fA-F]+)|0*([0-9]+))")
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs = tag, attrs or {}
        self.children: list[Node | str] = []


def unescape(s: str) -> str:
    """Character references resolved; numbers that are too long for any character give U+FFFD."""
    if "&" not in s:
        return s
    if "&#" in s:
        s = NUMBERED.sub(lambda m: "\ufffd" if len(m[1] or m[2]) > 7 else m[0], s)
    return html.unescape(s)


def read_attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes (the first of a name counts) and the place after the tag; -1 if the tag doesn't end."""
    attrs: dict[str, str] = {}
    while True:
        if m := TAG_END.match(page, at):
            return attrs, m.end()
        m = ATTRIBUTE.match(page, at)
        if m is None:
            return attrs, -1
        at, value = m.end(), ""
        if m[2]:
            quote = page[at : at + 1]
            if quote in ("'", '"') and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    return attrs, -1
                value, at = page[at + 1 : end], end + 1
            else:
                m_value = BARE_VALUE.match(page, at)
                value, at = m_value[0], m_value.end()
        attrs.setdefault(m[1].lower(), unescape(value))


def declarations(style: str) -> dict[str, str]:
    """The deciding properties of a style text; the last of a name counts."""
    out = {}
    for part in style.lower().split(";"):
        name, colon, value = part.partition(":")
        if colon and (name := name.strip()) in DECIDING:
            out[name] = value.replace("!important", "").strip()
    return out


class Rules:
    """Style rules by what they select; of those that fit, ids win over classes, these over tags, and what is later over what is earlier."""

    def __init__(self, sheets: list[str]) -> None:
        self.known: dict[tuple, dict[str, tuple]] = {}
        order = 0
        for sheet in sheets:
            sheet, at = COMMENT.sub("", sheet), 0
            while (opened := sheet.find("{", at)) >= 0:
                head = sheet[at:opened].rsplit(";", 1)[-1].strip()
                if head.startswith("@"):  # its block may hold blocks
                    depth, at = 1, opened + 1
                    while depth and at < len(sheet):
                        m = re.compile("[{}]").search(sheet, at)
                        depth, at = (depth + (1 if m[0] == "{" else -1), m.end()) if m else (0, len(sheet))
                    continue
                closed = sheet.find("}", opened)
                closed = closed if closed >= 0 else len(sheet)
                found = declarations(sheet[opened + 1 : closed])
                at = closed + 1
                for selector in head.split(",") if found else []:
                    m = SELECTOR.fullmatch(selector.strip())
                    if not m or not m[0]:
                        continue
                    order += 1
                    rank = (100 if m[2] == "#" else 10 if m[2] else 0) + bool(m[1]), order
                    own = self.known.setdefault(((m[1] or "").lower(), m[2] or "", m[3] or ""), {})
                    for name, value in found.items():
                        own[name] = max(own.get(name, ((0, 0), "")), (rank, value))

    def style(self, node: "Node") -> dict[str, str]:
        attrs = node.attrs
        if not self.known:
            return declarations(attrs["style"]) if "style" in attrs else {}
        best: dict[str, tuple] = {}
        marks = [("", "")] + [(".", c) for c in set(attrs.get("class", "").split())] + ([("#", attrs["id"])] if "id" in attrs else [])
        for mark in marks:
            for tag in (node.tag, ""):
                for name, found in self.known.get((tag, *mark), {}).items():
                    best[name] = max(best.get(name, ((0, 0), "")), found)
        return {n: v for n, (_, v) in best.items()} | (declarations(attrs["style"]) if "style" in attrs else {})


def build_tree(page: str) -> tuple[Node, str, list[str]]:
    """The tree, the text of the first title, and the style sheets."""
    root, title = Node("html"), None
    sheets: list[str] = []
    stack = [root]
    at, n = 0, len(page)
    ends: dict[str, re.Pattern] = {}
    while at < n:
        if page[at] != "<":
            end = page.find("<", at)
            end = end if end >= 0 else n
            stack[-1].children.append(unescape(page[at:end]))
            at = end
            continue
        closing = page.startswith("/", at + 1)
        name = TAG_NAME.match(page, at + 1 + closing)
        if name is None:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2)
                at = end + 3 if end >= 0 else n
            elif closing or page.startswith(("!", "?"), at + 1):
                end = page.find(">", at + 1)
                at = end + 1 if end >= 0 else n
            else:
                stack[-1].children.append("<")
                at += 1
            continue
        tag = name[0].lower()
        attrs, at = read_attributes(page, name.end())
        if at < 0:
            break
        if closing:
            close_tag(stack, tag)
            continue
        if tag == "html":
            continue
        imply_ends(stack, tag)
        node = Node(tag, attrs)
        if tag in UNDRAWN and any(x.tag == "svg" for x in stack):
            node.attrs = {"hidden": ""}
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            stop = None
            if tag != "plaintext":
                if tag not in ends:
                    ends[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE)
                stop = ends[tag].search(page, at)
            inner = page[at : stop.start() if stop else n]
            inner = unescape(inner) if tag in ("textarea", "title") else inner
            node.children.append(inner)
            if tag == "style" and SCREEN.search(node.attrs.get("media") or "all"):
                sheets.append(inner)
            if tag == "title" and title is None and all(x.tag != "svg" for x in stack):
                title = SPACE.sub(" ", inner).strip()
            at = stop.end() if stop else n
            continue
        if len(stack) < MAX_DEPTH:
            stack.append(node)
    return root, title or "", sheets


def imply_ends(stack: list[Node], tag: str) -> None:
    if tag in BLOCK and tag not in ("html", "body", "tr", "caption", "thead", "tbody", "tfoot"):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                del stack[i:]
                break
            if stack[i].tag in BLOCK or stack[i].tag in SCOPE:
                break
    if tag in IMPLIED:
        ends, until = IMPLIED[tag]
        cut = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in until:
                break
            if stack[i].tag in ends:
                cut = i
        if cut is not None:
            del stack[cut:]


def close_tag(stack: list[Node], tag: str) -> None:
    if tag == "br":
        stack[-1].children.append(Node("br"))
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in SCOPE and tag not in ("table", "tr", "thead", "tbody", "tfoot", "body", "html"):
            return


class Renderer:
    """Lines of text; blank lines between blocks are at most one."""

    def __init__(self, padding: list[int], rules: Rules, tables: int = 0) -> None:
        self.padding = padding  # blanks that the page's tables may still take: one number, shared by all its renderers
        self.rules, self.tables = rules, tables
        self.lines: list[str] = []
        self.current: list[str] = []
        self.space = False  # a collapsed space waits
        self.gap = False  # a blank line waits
        self.indent = ""
        self.marker = ""

    def text(self, s: str, mode: int) -> None:
        if mode != COLLAPSED:
            head, *rest = s.replace("\r\n", "\n").split("\n")
            one = self.put if mode == AS_IT_STANDS else lambda line: self.text(line, COLLAPSED)
            one(head)
            for line in rest:
                self.end_line(keep=True)
                one(line)
            return
        words = SPACE.split(s)
        for i, w in enumerate(words):
            if i:
                self.space = self.space or bool(self.current)
            if w:
                self.put((" " if self.space and self.current else "") + w)
                self.space = False

    def put(self, s: str) -> None:
        if not s:
            return
        if not self.current:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.current.append(self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent)
            self.marker = ""
        self.current.append(s)

    def end_line(self, keep: bool = False) -> None:
        if self.current:
            self.lines.append("".join(self.current).rstrip())
            self.current = []
        elif keep and self.lines and not self.gap:
            self.lines.append("")
        self.space = False

    def block_edge(self, spaced: bool) -> None:
        self.end_line()
        self.gap = self.gap or spaced

    def result(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def undisplayed(node: Node, style: dict[str, str]) -> bool:
    if node.tag in INVISIBLE or node.tag == "dialog" and "open" not in node.attrs:
        return True
    display = style.get("display", "")
    return display == "none" or "hidden" in node.attrs and not display


def shown_options(select: Node, rules: Rules) -> list[Node]:
    """All options of a list box; of a drop-down the chosen one, else the first."""
    options, todo = [], list(reversed(select.children))
    while todo:
        child = todo.pop()
        if isinstance(child, Node) and not undisplayed(child, rules.style(child)):
            if child.tag == "option":
                options.append(child)
            else:
                todo += reversed(child.children)
    size = WHOLE.match(select.attrs.get("size", ""))
    if "multiple" in select.attrs or size and int(size[1]) > 1 or not options:
        return options
    return [o for o in options if "selected" in o.attrs][-1:] or options[:1]


def whole_number(node: Node, name: str, default: int) -> int:
    m = WHOLE.match(node.attrs.get(name, ""))
    return int(m[1]) if m else default


def walk(node: Node, out: Renderer, mode: int, seen: bool, depth: int) -> None:
    """Render what a node holds; ``seen``: whether its own text is visible."""
    number, step = None, 1
    if node.tag == "ol":
        backwards = "reversed" in node.attrs
        number, step = whole_number(node, "start", sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if backwards else 1), -1 if backwards else 1
    summary = node.tag == "details" and "open" not in node.attrs  # of a closed one only this is shown
    for child in node.children:
        if isinstance(child, str):
            if seen and not summary:
                out.text(child, mode)
            continue
        tag = child.tag
        if summary and tag != "summary":
            continue
        style = out.rules.style(child)
        if undisplayed(child, style):
            continue
        inner_seen = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""), seen)
        own_mode = AS_IT_STANDS if tag in ("pre", "xmp", "plaintext", "textarea") else mode
        inner_mode = SPACE_MODES.get(style.get("white-space", ""), own_mode)
        if tag == "br":
            if out.current:
                out.end_line()
            else:
                out.end_line(keep=True)
        elif tag == "hr":
            out.block_edge(True)
        elif tag == "input":
            if inner_seen and child.attrs.get("type", "text").lower() in SHOWN_INPUT:
                out.text(child.attrs.get("value", ""), COLLAPSED)
        elif tag == "select":
            for option in shown_options(child, out.rules) if inner_seen else []:
                if "multiple" in child.attrs or "size" in child.attrs:
                    out.block_edge(False)
                walk(option, out, COLLAPSED, inner_seen, depth + 1)
        elif tag == "table" and out.tables < MOST_TABLES:
            out.block_edge(True)
            for line in table_lines(child, out, inner_mode, inner_seen, depth):
                out.put(line)
                out.end_line()
            out.block_edge(True)
        elif tag == "li":
            out.block_edge(False)
            mark = "* "
            if node.tag == "ol":
                number = whole_number(child, "value", number)
                mark = f"{number}. "
                number += step
            old = out.indent
            out.indent, out.marker = (old + " " * len(mark))[:MOST_INDENT], mark
            walk(child, out, inner_mode, inner_seen, depth + 1)
            out.block_edge(False)
            out.indent, out.marker = old, ""
        elif tag in BLOCK or tag in ("td", "th"):  # cells stand here if their table is nested too deep
            nested = tag in ("ul", "ol", "menu") and node.tag in ("li", "ul", "ol", "menu")
            spaced = tag in SPACED and not nested
            if tag in ("td", "th") and node.tag != "tr":
                walk(child, out, inner_mode, inner_seen, depth + 1)
                continue
            out.block_edge(spaced)
            old = out.indent
            if tag in ("dd", "blockquote"):
                out.indent = (old + "  ")[:MOST_INDENT]
            walk(child, out, inner_mode, inner_seen, depth + 1)
            out.block_edge(spaced)
            out.indent = old
        else:
            walk(child, out, inner_mode, inner_seen, depth + 1)
        if summary:
            return


def rows_of(node: Node, rules: Rules, mode: int, seen: bool) -> Iterator[tuple[Node, int, bool]]:
    """Rows of a table in order, and whatever else stands in it (captions, stray text) as rows of one cell; with what they inherit."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                stray = Node("tr")
                stray.children.append(cell := Node("td"))
                cell.children.append(child)
                yield stray, mode, seen
            continue
        style = rules.style(child)
        if undisplayed(child, style):
            continue
        inner = SPACE_MODES.get(style.get("white-space", ""), mode), {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""), seen)
        if child.tag == "tr":
            yield child, *inner
        elif child.tag in ("thead", "tbody", "tfoot"):
            yield from rows_of(child, rules, *inner)
        else:
            row = Node("tr")
            row.children.append(child)
            yield row, mode, seen


def cells_of(row: Node, out: Renderer, mode: int, seen: bool, depth: int) -> Iterator[tuple[list[str], int, int]]:
    """Lines of each cell, and the columns and rows that it spans."""
    for child in row.children:
        if isinstance(child, str):
            if not child.strip():
                continue
            cell, style = Node("td"), {}
            cell.children.append(child)
        else:
            style = out.rules.style(child)
            if undisplayed(child, style):
                continue
            cell = child
        inner = Renderer(out.padding, out.rules, out.tables + 1)
        if cell.tag in ("td", "th", "caption"):
            walk(cell, inner, SPACE_MODES.get(style.get("white-space", ""), mode), {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""), seen), depth + 1)
        else:
            walk(wrapped(cell), inner, mode, seen, depth + 1)
        spans = (whole_number(cell, n, 1) for n in ("colspan", "rowspan")) if cell.tag in ("td", "th") else (1, 1)
        yield inner.result().split("\n"), *(max(1, x) for x in spans)


def table_lines(table: Node, out: Renderer, mode: int, seen: bool, depth: int) -> list[str]:
    """A table's rows as lines: each cell at its column of the grid, next to what earlier rows' cells still cover."""
    grid: list[list[tuple[int, int, list[str]]]] = []  # (column, columns, lines) of each row's cells
    taken: list[int] = []  # of each column the rows that are still covered
    for row, row_mode, row_seen in rows_of(table, out.rules, mode, seen):
        cells, at = [], 0
        cover = [max(0, n - 1) for n in taken]
        for lines, wide, high in cells_of(row, out, row_mode, row_seen, depth):
            while at < len(taken) and taken[at]:
                at += 1
            wide = max(1, min(wide, MOST_COLUMNS - at))
            cells.append((at, wide, lines))
            if high > 1 and at < MOST_COLUMNS:
                cover += [0] * (at + wide - len(cover))
                cover[at : at + wide] = [high - 1] * wide
            at += wide
        taken = cover
        if any(any(lines) for _, _, lines in cells):
            grid.append(cells)
    widths: list[int] = []
    for cells in grid:
        if len(cells) > 1 or cells[0][0]:  # a lone cell spans the table
            for at, wide, lines in cells:
                widths += [0] * (at + 1 - len(widths))
                if wide == 1:
                    widths[at] = max(widths[at], max((len(x) for x in lines if len(x) <= MOST_PADDED), default=0))
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + w + 2)
    lines = []
    for cells in grid:
        height = max(len(c) for _, _, c in cells)
        alone = len(cells) == 1 and not cells[0][0]
        blanks = 0 if alone else height * starts[min(cells[-1][0], len(starts) - 1)] + height * 2 * len(cells)
        if blanks > out.padding[0]:
            lines += [line for _, _, c in cells for line in c if line]
            continue
        out.padding[0] -= blanks
        for k in range(height):
            parts, reached = [], 0
            for i, (at, _, c) in enumerate(cells):
                gap = max(starts[min(at, len(starts) - 1)] - reached, 2 if i else 0)
                text = c[k] if k < len(c) else ""
                parts.append(" " * gap + text)
                reached += gap + len(text)
            lines.append("".join(parts).rstrip())
    return lines


def wrapped(node: Node) -> Node:
    cell = Node("td")
    cell.children.append(node)
    return cell


def render(page: str | None) -> str:
    """All visible text of a page."""
    return render_page(page)[0]


def render_page(page: str | None) -> tuple[str, str]:
    """All visible text of a page, and its title."""
    if not page:
        return "", ""
    tree, title, sheets = build_tree(page)
    out = Renderer([PADDING_FACTOR * len(page)], Rules(sheets))
    walk(tree, out, COLLAPSED, True, 0)
    return out.result(), title


def extract(pages: DataFrame, column: str = "html", text: str = "text", title: str = "title") -> DataFrame:
    """``pages`` without the markup, with the visible text and the title as two more columns."""
    source = pages.select(F.col(column), *[F.col(f"`{c}`") for c in without(pages, column, text, title).columns])
    rest = source.schema.fields[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, batch_column):
            got = [render_page(page) for page in texts(batch, batch_column)]
            found = [pa.array([g[i] for g in got], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *found], [*[f.name for f in rest], text, title])

    batch_column = source.columns[0]
    return source.mapInArrow(run, T.StructType([*rest, T.StructField(text, T.StringType()), T.StructField(title, T.StringType())]))


def page_texts(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """(page_id, title, text, n_chars, n_lines): one row for each of ``pages``."""
    done = extract(pages.select(F.col(key).cast("long").alias("page_id"), F.col(column).alias("html")))
    lines = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    return done.select("page_id", "title", "text", F.length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))
