"""Layout-aware text of web pages: a tree builder with implied tags, then a renderer.

The builder closes and opens the elements that HTML lets authors leave out and skips what is never
shown (scripts, styles, comments, hidden elements). The renderer emits all visible text: blocks on
lines of their own with the spacing of their kind, list items with marks and indents, preformatted
text as it is, and table cells in aligned columns. Both are loops, so no nesting is too deep.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tsreg.llm.common import map_arrow, texts_of

# fixed values: names of HTML elements by their role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
NEVER_SHOWN = frozenset(
    "area base basefont datalist embed head iframe link meta noembed noframes noscript object param "
    "rp script source style template title track audio video canvas svg math".split()
)
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
SPACED = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol menu dl blockquote pre xmp figure table fieldset hr".split()
)
BLOCK = SPACED | frozenset(
    "address article aside body caption center dd details dialog dir div dt figcaption footer form "
    "header hgroup html legend li main nav option optgroup search section summary tbody td tfoot th "
    "thead tr".split()
)
# a start tag of these ends an open paragraph
ENDS_P = (BLOCK - frozenset("body caption html option optgroup tbody td tfoot th thead tr".split())) | {"hr"}
# start tag: elements it ends, and where the search for them stops
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"optgroup"}, {"select"}),
}
BARRIER = frozenset("td th caption table button object template html".split())
LISTS = frozenset("ul ol menu dir".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(
    r"""[\s/]*(?:([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?|=)"""
)
BLANKS = re.compile(r"[ \t\n\r\f]+")
WIDEST = 200  # cells up to this width make their column as wide; behind a wider one its row goes on below
LINE = 4096  # columns that begin further to the right go on below, too
GAP = "  "


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(text: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on, and the place after the tag's end.

    A quoted value that is never closed doesn't swallow the page: its tag ends at the next ``>``.
    """
    found: dict[str, str] = {}
    while True:
        match = ATTRIBUTE.match(text, at)
        if match is None or match.end() == at:
            end = text.find(">", at)
            return found, len(text) if end < 0 else end + 1
        name, *values = match.groups()
        if name:
            value = next((v for v in values if v is not None), "")
            found.setdefault(name.lower(), html.unescape(value))
        at = match.end()


class Builder:
    """Stack of open elements; text and elements are added to the innermost.

    ``places`` has the stack's places of each tag, so that no search walks down the stack.
    """

    def __init__(self):
        self.root = Node("html", {})
        self.open: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self._push(self.root)

    def _push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        if node.tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(node)

    def _pop(self) -> None:
        tag = self.open.pop().tag
        self.places[tag].pop()
        if tag in BLOCK:
            self.blocks.pop()

    def _innermost(self, tags) -> int:
        places = self.places
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def text(self, text: str) -> None:
        if self.open[-1].tag == "head" and text.strip():
            self._pop()  # visible text ends the head
        self.open[-1].children.append(text)

    def _end(self, wanted: set[str], stop: set[str] | frozenset[str], blocks: bool = False) -> None:
        """Close the innermost element of ``wanted``, unless one of ``stop`` (or a block) comes first."""
        place = self._innermost(wanted)
        if place == 0 or place < self._innermost(stop) or (blocks and self.blocks and place < self.blocks[-1]):
            return
        while len(self.open) > place:
            self._pop()

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in ("html", "body"):
            if tag == "body":
                self._end({"head"}, set())
            # what the tag says of visibility holds for the page
            self.root.attributes = attributes | self.root.attributes
            return
        if tag == "head":
            if len(self.open) > 1:
                return
        elif self.open[-1].tag == "head" and tag not in HEAD_ONLY:
            self._pop()
        if tag in ENDS_P:
            self._end({"p"}, BARRIER)
        if tag in IMPLIED_ENDS:
            ended, stop = IMPLIED_ENDS[tag]
            if tag in ("tr", "tbody", "thead", "tfoot"):
                for inner in ({"td", "th"}, {"tr"}) if tag != "tr" else ({"td", "th"},):
                    self._end(inner, {"table"})
            self._end(ended, stop)
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self.start("tr", {})
        node = Node(tag, attributes)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self._push(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
            return
        if tag in ("html", "body"):
            return
        stop: frozenset[str] = frozenset()
        if tag not in ("table", "template", "object"):
            stop = BARRIER - {tag}
        if tag == "li":
            stop = stop | LISTS
        # an inline end tag doesn't reach across blocks
        self._end({tag}, stop, blocks=tag not in BLOCK and tag not in NEVER_SHOWN)


def parse(page: str) -> Node:
    """Tree of a page, however malformed."""
    builder, at, n = Builder(), 0, len(page)
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            tag = n
        if tag > at:
            builder.text(html.unescape(page[at:tag]))
        at = tag
        if at >= n:
            break
        following = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            if page.startswith(("<!-->", "<!--->"), at):
                end = page.find(">", at) - 2
            else:
                end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
        elif following in ("!", "?") or (following == "/" and not NAME.match(page, at + 2)):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
        elif following == "/":
            name = NAME.match(page, at + 2)
            _, at = _attributes(page, name.end())
            builder.end(name[0].lower())
        elif name := NAME.match(page, at + 1):
            attributes, at = _attributes(page, name.end())
            tag = name[0].lower()
            builder.start(tag, attributes)
            if tag in RAW:
                found = RAW_END[tag].search(page, at)
                end = found.start() if found else n
                raw = page[at:end]
                builder.text(html.unescape(raw) if tag in ("textarea", "title") else raw)
                builder.end(tag)
                _, at = _attributes(page, min(n, end + 2 + len(tag)))
            elif tag == "plaintext":
                builder.text(page[at:])
                at = n
        else:
            builder.text("<")
            at += 1
    return builder.root


class Look(NamedTuple):
    """Inherited by what an element holds."""

    visible: bool = True
    kept: bool = False  # white space is kept


def _look(node: Node, above: Look) -> Look | None:
    """How an element's content is shown; None if the element takes no part in the layout."""
    given = node.attributes
    if node.tag in NEVER_SHOWN or "hidden" in given:
        return None
    if node.tag == "input" and given.get("type", "").lower() in ("hidden", "checkbox", "radio", "file", "password"):
        return None
    if node.tag == "dialog" and "open" not in given:
        return None
    visible, kept = above
    for declaration in given.get("style", "").lower().split(";"):
        name, _, value = declaration.partition(":")
        name, value = name.strip(), value.replace("!important", "").strip()
        if name == "display" and value == "none":
            return None
        if name == "visibility":
            visible = value not in ("hidden", "collapse")
        if name == "white-space":
            kept = value.startswith("pre")
    return Look(visible, kept or node.tag in ("pre", "xmp", "plaintext", "textarea"))


class Page:
    """Lines of text under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the line, none empty
        self.inked = False  # whether the line shows anything
        self.blank = False  # a blank is due before the next word
        self.space = 0  # 1: next text on a new line, 2: after an empty line
        self.indents: list[str] = []
        self.mark = ""  # of a list item that has no text yet

    def block(self, space: int) -> None:
        self.newline(force=False)
        self.space = max(self.space, space)

    def newline(self, force: bool = True) -> None:
        if self.parts or force:
            self.lines.append("".join(self.parts).rstrip())
        self.parts, self.inked, self.blank = [], False, False

    def _add(self, text: str) -> None:
        if text:
            self.parts.append(text)
            self.inked = self.inked or not text.isspace()

    def _begin(self) -> None:
        if self.parts:
            return
        if self.space == 2 and self.lines and self.lines[-1]:
            self.lines.append("")
        self.space = 0
        indent = "".join(self.indents)
        self._add(indent[: len(indent) - len(self.mark)] + self.mark if self.mark else indent)
        self.mark = ""
        self.blank = False

    def flow(self, text: str) -> None:
        words = BLANKS.split(text)
        if len(words) > 1 and not words[0]:
            self.blank = True
        for k, word in enumerate(words):
            if word:
                if not self.inked:
                    self._begin()
                elif k or self.blank:
                    self._add(" ")
                self._add(word)
                self.blank = False
        if len(words) > 1 and not words[-1]:
            self.blank = True

    def keep(self, text: str) -> None:
        for k, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if k:
                self.newline()
            if line:
                self._begin()
                self._add(line.expandtabs(8))

    def whole(self, lines: list[str]) -> None:
        """Lines that stand as they are, under the current indent."""
        for line in lines:
            if line:
                self._begin()
                self._add(line)
            self.newline()

    def finished(self) -> list[str]:
        self.newline(force=False)
        shown = [k for k, line in enumerate(self.lines) if line]
        return self.lines[shown[0] : shown[-1] + 1] if shown else []


def _number(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*-?[0-9]{1,6}\s*", text) else default


class Table:
    """Cells of a table; rows and columns that a cell spans are left to it."""

    def __init__(self):
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.taken: dict[int, int] = {}  # column -> rows it is still taken for
        self.column = 0

    def row(self) -> None:
        self.rows.append([])
        self.column = 0
        self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1}

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        while self.column in self.taken:
            self.column += 1
        self.rows[-1].append((self.column, lines))
        across = min(max(across, 1), 1000)
        if down > 1:
            self.taken |= {self.column + k: down for k in range(across)}
        self.column += across

    def text(self) -> list[str]:
        widths: dict[int, int] = {}
        for row in self.rows:
            for column, lines in row:
                fitting = [len(line) for line in lines if len(line) <= WIDEST]
                widths[column] = max([widths.get(column, 0), *fitting])
        columns = sorted(widths)
        starts, at = {}, 0
        for column in columns:
            if at + widths[column] > LINE:
                at = 0
            starts[column] = at
            at += widths[column] + len(GAP) * (widths[column] > 0)
        out = []
        for row in self.rows:
            for k in range(max((len(lines) for _, lines in row), default=0)):
                parts, width = [], 0
                for column, lines in row:
                    if k < len(lines) and lines[k]:
                        if parts and width + len(GAP) > starts[column]:
                            # what stands before is too wide: the row goes on below, in its column
                            out.append("".join(parts))
                            parts, width = [], 0
                        parts += [" " * (starts[column] - width), lines[k]]
                        width = starts[column] + len(lines[k])
                out.append("".join(parts))
        return out


def render(root: Node) -> str:
    """Visible text of a tree."""
    pages, tables, lists = [Page()], [], []
    todo: list[tuple] = [("in", root, Look())]
    while todo:
        step, node, look = todo.pop()
        page = pages[-1]
        if step == "out":
            _leave(node, pages, tables, lists)
            continue
        if isinstance(node, str):
            if look.visible:
                page.keep(node) if look.kept else page.flow(node)
            continue
        tag, inside = node.tag, _look(node, look)
        if inside is None:
            continue
        if tag == "br":
            page.newline(force=bool(page.parts) or page.space == 0)
            continue
        if tag == "input":
            if inside.visible:
                page.flow(f" {node.attributes.get('value', '')} ")
            continue
        if tag == "wbr" or tag == "img":
            continue
        children = node.children
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        _enter(node, pages, tables, lists)
        todo.append(("out", node, look))
        todo += [("in", child, inside) for child in reversed(children)]
    return "\n".join(pages[0].finished())


def _spacing(node: Node, lists: list) -> int:
    if node.tag in LISTS and lists:
        return 1  # a list inside a list
    return 2 if node.tag in SPACED else 1


def _enter(node: Node, pages: list[Page], tables: list[Table], lists: list) -> None:
    tag, page = node.tag, pages[-1]
    if tag in ("td", "th"):
        pages.append(Page())
        return
    if tag in BLOCK:
        page.block(_spacing(node, lists))
    if tag in LISTS:
        lists.append(_number(node.attributes.get("start"), 1) if tag == "ol" else None)
        page.indents.append("")
    elif tag == "li":
        mark = "- "
        if lists and lists[-1] is not None:
            lists[-1] = _number(node.attributes.get("value"), lists[-1])
            mark = f"{lists[-1]}. "
            lists[-1] += 1
        page.indents.append(" " * len(mark))
        page.mark = mark
    elif tag in ("dd", "blockquote"):
        page.indents.append("    ")
    elif tag == "table":
        tables.append(Table())
    elif tag == "tr" and tables:
        tables[-1].row()


def _leave(node: Node, pages: list[Page], tables: list[Table], lists: list) -> None:
    tag = node.tag
    if tag in ("td", "th"):
        lines = pages.pop().finished()
        if tables:
            tables[-1].cell(
                lines, _number(node.attributes.get("colspan"), 1), _number(node.attributes.get("rowspan"), 1)
            )
        else:
            pages[-1].block(1)
            pages[-1].whole(lines)
        return
    page = pages[-1]
    if tag == "table":
        page.newline(force=False)
        page.whole(tables.pop().text())
    if tag in BLOCK:
        page.newline(force=False)
    if tag in LISTS:
        lists.pop()
        page.indents.pop()
    elif tag in ("li", "dd", "blockquote"):
        page.indents.pop()
        page.mark = ""
    if tag in BLOCK:
        page.block(_spacing(node, lists))


def text_of(page: str) -> str:
    """Visible text of an HTML page."""
    return render(parse(page))


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``text`` and ``n_lines`` of every row of ``pages`` (``page_id``, ``html``).

    Null or empty pages, and pages that show nothing, have an empty text of no lines. Repeated rows
    come back as often as they come; null ids stay null; other columns are ignored; an empty table gives
    none. A long or deeply nested page takes time in proportion to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(page.decode("utf-8", "replace")) for page in texts_of(batch.column(1))]
            lines = [text.count("\n") + 1 if text else 0 for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64())],
                names=["page_id", "text", "n_lines"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_arrow(pages.select("page_id", "html"), run, f"page_id {kind}, text string, n_lines bigint")
