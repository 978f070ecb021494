"""Text of HTML pages as a reader sees it.

A tree is built from the tags, with the end tags that HTML implies; then it is
laid out: hidden elements are left out, blocks stand apart, list items have
markers and indentation, and the cells of a table are aligned in columns.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from arrearly.llm.common import appended

# Element classes of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p",
    "pre", "section", "summary", "table", "ul", "caption",
}
# Blocks with an empty line around them.
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "table", "ul", "ol", "dl", "figure", "menu", "dir"}
INVISIBLE = {
    "head", "script", "style", "template", "noscript", "iframe", "noembed", "noframes", "title",
    "meta", "link", "base", "datalist", "audio", "video", "canvas", "object", "svg", "math",
}
CLOSES_P = BLOCK - {"body", "html", "caption", "dd", "dt", "legend", "li", "summary"}
# A start tag ends an open element of these kinds, unless a boundary lies between.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
_SCOPE = {"table", "td", "th", "caption", "html", "object", "template"}
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDDEN_STYLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: Lines of cells are wrapped at this width, so that columns stay aligned and output linear.
WIDEST = 60
#: Spans are as long as the standard lets them be; places below a cell that spans rows are
#: kept free in so many columns.
COLUMNS, ROWS = 1000, 65534
#: Elements below this depth stand in their ancestor at this depth: they end, hide and
#: break lines as ever, but do not imply the ends of one another.
DEEPEST = 512


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    if "=" not in text and not text.strip(" /\n\t"):
        return {}
    return {
        m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)
    }


def tree(html: str) -> Node:
    """The element tree; every text has one, whatever its tags are like."""
    root = Node("html")
    stack = [root]
    deep = _Deep()
    at = 0

    def text(piece: str) -> None:
        if not piece or deep.hidden:
            return
        if stack[-1].tag == "head" and piece.strip():
            stack.pop()
        stack[-1].children.append(unescape(piece) if "&" in piece else piece)

    def close(tags: set[str], boundary: set[str]) -> None:
        """Ends the outermost open element of ``tags`` inside the boundary."""
        cut = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in boundary:
                break
            if stack[i].tag in tags:
                cut = i
        if cut:
            del stack[cut:]

    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        text(html[at:lt])
        m = _TOKEN.match(html, lt)
        if m is None:
            text("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                if not deep.hidden:
                    stack[-1].children.append(Node("br"))
            elif deep.closed(tag):
                if tag in BLOCK and not deep.hidden:
                    stack[-1].children.append(Node("div"))
            elif tag not in ("html", "body"):
                close_at = next(
                    (
                        i
                        for i in range(len(stack) - 1, 0, -1)
                        if stack[i].tag == tag or (stack[i].tag in _SCOPE and tag not in _SCOPE)
                    ),
                    0,
                )
                if close_at and stack[close_at].tag == tag:
                    del stack[close_at:]
                    deep.clear()
            continue
        if tag == "html" or (tag == "body" and any(n.tag == "body" for n in stack)):
            continue
        if not deep.tags:
            if tag in IMPLIED_ENDS:
                close(*IMPLIED_ENDS[tag])
            if tag in CLOSES_P:
                close({"p"}, _SCOPE)
        if stack[-1].tag == "head" and tag not in INVISIBLE:
            stack.pop()
        node = Node(tag, _attributes(m[3]))
        if not deep.hidden:
            stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(html, at)
            stop = end.start() if end else len(html)
            if tag in ("textarea", "title", "xmp"):
                node.children.append(html[at:stop] if tag == "xmp" else unescape(html[at:stop]))
            at = html.find(">", stop) + 1 if end and html.find(">", stop) >= 0 else len(html)
        elif tag not in VOID and len(stack) < DEEPEST:
            stack.append(node)
        elif tag not in VOID:
            deep.opened(tag, _hidden(node))
    return root


class _Deep:
    """The open elements below the greatest depth: their tags, and whether one is hidden."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.tags: list[str] = []
        self.number: Counter[str] = Counter()
        self.hidden_at = 0  # elements from the first hidden one on; 0 if none is

    @property
    def hidden(self) -> bool:
        return self.hidden_at > 0

    def opened(self, tag: str, hidden: bool) -> None:
        self.tags.append(tag)
        self.number[tag] += 1
        if hidden and not self.hidden_at:
            self.hidden_at = len(self.tags)

    def closed(self, tag: str) -> bool:
        """Whether the end tag belongs here; it ends what is open inside, too."""
        if not self.number[tag]:
            return False
        while (last := self.tags.pop()) != tag:
            self.number[last] -= 1
        self.number[tag] -= 1
        if len(self.tags) < self.hidden_at:
            self.hidden_at = 0
        return True


def _hidden(node: Node) -> bool:
    a = node.attributes
    if node.tag in INVISIBLE or "hidden" in a or (node.tag == "dialog" and "open" not in a):
        return True
    return "style" in a and bool(_HIDDEN_STYLE.search(a["style"]))


class _Page:
    """Lines of text; the breaks between blocks are held back until text follows."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks, self.space, self.indent, self.marker = 0, False, 0, ""

    def block(self, lines: int) -> None:
        self.breaks, self.space = max(self.breaks, lines), False

    def _start(self) -> None:
        if self.breaks and self.parts:
            self.parts.append("\n" * self.breaks)
        if self.breaks or not self.parts:
            pad = " " * self.indent
            if self.marker:
                pad = pad[: max(0, len(pad) - len(self.marker))] + self.marker
                self.marker = ""
            self.parts.append(pad)
        elif self.space:
            self.parts.append(" ")
        self.breaks, self.space = 0, False

    def words(self, text: str) -> None:
        flat = _SPACE.sub(" ", text)
        if flat[:1] == " ":
            self.space = True
        body = flat.strip(" ")
        if body:
            self._start()
            self.parts.append(body)
            self.space = flat[-1] == " "

    def lines(self, text: str) -> None:
        for i, line in enumerate(text.split("\n")):
            if i:
                self.breaks += 1
            if line.strip():
                self._start()
                self.parts.append(line.rstrip())
        self.space = False

    def text(self) -> str:
        return "".join(self.parts).strip("\n")


class _Table:
    """Cells by the column where they begin, as row and column spans place them."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, str]]] = []
        self.taken: list[int] = []  # by column, the row that is free again
        self.next = 0

    def row(self) -> None:
        self.rows.append([])
        self.next = 0

    def cell(self, text: str, across: int, down: int) -> None:
        if not self.rows:
            self.row()
        at, row = self.next, len(self.rows) - 1
        while at < len(self.taken) and self.taken[at] > row:
            at += 1
        self.rows[-1].append((at, text))
        self.next = at + across
        if down > 1 and at < COLUMNS:
            end = min(self.next, COLUMNS)
            self.taken += [0] * (end - len(self.taken))
            for i in range(at, end):
                self.taken[i] = max(self.taken[i], row + down)

    def section(self) -> None:
        """Cells do not reach beyond the group of rows that they are in."""
        self.taken.clear()


def _span(node: Node, name: str, most: int) -> int:
    value = node.attributes.get(name, "1").strip()
    if not (value.isascii() and value.isdecimal()):
        return 1
    n = most if len(value) > 6 else min(int(value), most)
    return n or (most if name == "rowspan" else 1)  # 0: all rows that follow


def _wrapped(text: str) -> list[str]:
    """The lines of a cell; long ones are broken between words, never inside one."""
    out = []
    for line in text.split("\n"):
        if len(line) <= WIDEST:
            out.append(line)
            continue
        part, size = [], 0
        for word in line.split(" "):
            if part and size + len(word) > WIDEST:
                out.append(" ".join(part))
                part, size = [], 0
            part.append(word)
            size += len(word) + 1
        out.append(" ".join(part))
    return out


def _grid(table: _Table) -> str:
    """Rows of text with aligned columns, two spaces apart; columns in which no cell begins
    take no room. A cell over several columns stands in its first one."""
    rows = [[(at, _wrapped(text)) for at, text in row if text] for row in table.rows]
    width: dict[int, int] = {}
    for row in rows:
        for at, lines in row:
            width[at] = max(width.get(at, 0), min(WIDEST, max(map(len, lines))))
    start, offset = {}, 0
    for c in sorted(width):
        start[c] = offset
        offset += width[c] + 2 if width[c] else 0
    out = []
    for row in rows:
        for k in range(max((len(lines) for _, lines in row), default=0)):
            line = ""
            for at, lines in row:
                if k < len(lines) and lines[k]:
                    gap = "  " if line and len(line) + 2 > start[at] else ""
                    line = (line + gap).ljust(start[at]) + lines[k]
            out.append(line.rstrip())
    return "\n".join(out)


def render(root: Node) -> str:
    """The visible text of a tree, without recursion, so depth does not matter."""
    pages = [_Page()]
    lists: list[list] = []  # [tag, next number]
    tables: list[_Table] = []
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    pre = 0
    while todo:
        node, leaving = todo.pop()
        page = pages[-1]
        if isinstance(node, str):
            (page.lines if pre else page.words)(node)
            continue
        tag = node.tag
        if not leaving:
            if _hidden(node):
                continue
            if tag == "br":
                page.breaks, page.space = page.breaks + 1, False
                continue
            if tag == "input":
                if node.attributes.get("type", "").lower() in ("submit", "button", "reset"):
                    page.words(" " + node.attributes.get("value", "") + " ")
                continue
            if tag in BLOCK:
                nested = tag in ("ul", "ol", "menu", "dir") and lists
                page.block(2 if tag in SPACED and not nested else 1)
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.attributes.get("start", "")
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                page.marker = f"{kind[1]}. " if kind[0] == "ol" else "- "
                page.indent += max(2, len(page.marker))
                node.attributes["indent"] = str(max(2, len(page.marker)))
                kind[1] += 1
            elif tag in ("blockquote", "dd"):
                page.indent += 2
            elif tag == "table":
                tables.append(_Table())
            elif tag == "tr" and tables:
                tables[-1].row()
            elif tag in ("td", "th") and tables:
                pages.append(_Page())
            elif tag in ("option", "button", "select", "textarea"):
                page.space = True
            pre += tag in ("pre", "textarea", "xmp")
            todo.append((node, True))
            closed = tag == "details" and "open" not in node.attributes
            todo += [
                (c, False)
                for c in reversed(node.children)
                if not closed or (isinstance(c, Node) and c.tag == "summary")
            ]
            continue
        pre -= tag in ("pre", "textarea", "xmp")
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag == "li":
            page.indent -= int(node.attributes["indent"])
            page.marker = ""
        elif tag in ("blockquote", "dd"):
            page.indent -= 2
        elif tag in ("td", "th") and tables:
            cell = pages.pop().text()
            tables[-1].cell(cell, _span(node, "colspan", COLUMNS), _span(node, "rowspan", ROWS))
            continue
        elif tag in ("thead", "tbody", "tfoot") and tables:
            tables[-1].section()
        elif tag == "table":
            grid = _grid(tables.pop())
            if grid:
                page.lines(grid)
        elif tag in ("option", "button", "select", "textarea"):
            page.space = True
        if tag in BLOCK:
            nested = tag in ("ul", "ol", "menu", "dir") and lists
            page.block(2 if tag in SPACED and not nested else 1)
    return pages[0].text()


def html_text(html: str | None) -> str | None:
    return None if html is None else render(tree(html))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``: the visible text of ``html``.

    NULL gives NULL; an empty page, or one without visible text, gives ''. Any
    text is a page, however broken. Rows never meet; a column named ``text`` is
    replaced.
    """
    column = pages.drop("text").columns.index(html)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([html_text(x.as_py()) for x in batch.column(column)], pa.string())]

    return appended(pages, "text string", compute)
