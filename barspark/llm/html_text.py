"""HTML to text as a browser lays it out.

``build`` makes a tree from whatever markup there is: html, head and body, table rows and list items are implied where they
are left out, paragraphs end where a block begins, and text that has no place in a table goes before it. ``render`` walks
the tree and writes all visible text: blocks are set apart, list items are marked and indented, the cells of a table stand
in aligned columns, preformatted text keeps its blanks. Neither recurses, so depth is no limit: elements nest as deep as
they are written, and open ones are looked up by name. Only layout has bounds (``INDENT``, ``NESTED``), text has none.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import ROW, keyed

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
IN_HEAD = frozenset("title meta link style script base noscript template".split())
#: Elements whose content a browser doesn't show.
UNSEEN = frozenset("head script style title template noscript datalist iframe noembed noframes audio video canvas object".split())
#: Blocks, with the number of line ends before and after them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table hr fieldset".split())
PLAIN = frozenset("html body div article section nav header footer main aside address form li dt dd figcaption details summary dialog legend center option "
                  "optgroup select textarea caption tr menu dir search hgroup".split())
BLOCKS = SPACED | PLAIN
ENDS_P = BLOCKS - frozenset("html body option optgroup select textarea caption tr legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TABLE_PARTS = frozenset("table thead tbody tfoot tr".split())
TABLE_TAGS = TABLE_PARTS | frozenset("td th caption colgroup col".split())
#: A new element ends open ones of the first, up to one of the second.
IMPLIED_ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset("select datalist".split())),
}
#: Where a part of a table may stand; everything that is open within ends.
ROOM = {"td": TABLE_PARTS, "th": TABLE_PARTS, "tr": TABLE_PARTS - {"tr"}, **dict.fromkeys("thead tbody tfoot caption colgroup col".split(), frozenset(["table"]))}
#: Lines are indented by this many characters at most, and tables within this many others are written a row a line without
#: columns: else the blanks and the copies of lines alone would grow with the square of a page.
INDENT, NESTED = 1024, 170
#: Longer lines of a cell are wrapped at blanks within its column; a longer word has a line without cells to its right.
WIDEST = 60
#: As HTML has it, a cell spans so many columns and rows at most.
COLUMNS, ROWS = 1000, 65534

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TELLING = re.compile(r"\b(?:hidden|style|open|start|value|colspan|rowspan|type|reversed)\b", re.I)
GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(s: str) -> dict[str, str]:
    if not TELLING.search(s):
        return {}
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(s):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", tag, rest), ("end", tag, "") in order; comments and declarations are left out."""
    at, n = 0, len(html)
    last = {c: html.rfind(c) for c in "\"'>"}
    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt >= last[">"] and not html.startswith("<!--", lt):
            yield "text", unescape(html[at:]), ""
            return
        if lt > at:
            yield "text", unescape(html[at:lt]), ""
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 2 if html.startswith("<!-->", lt) else lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = NAME.match(html, lt + 1)
        if not m:
            if html[lt + 1:lt + 2] in ("!", "?", "/"):
                at = html.find(">", lt) + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        gt = html.find(">", lt)
        inside = html[m.end():gt]
        if (inside.count('"') % 2 and last['"'] > gt) or (inside.count("'") % 2 and last["'"] > gt):
            whole = QUOTED.match(html, m.end())
            gt = whole.end() - 1 if whole else gt
            inside = html[m.end():gt]
        at, name = gt + 1, m[0].lower()
        if name[0] == "/":
            yield "end", name[1:], ""
            continue
        yield "start", name, inside
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            stop = end.start() if end else n
            if stop > at:
                yield "text", unescape(html[at:stop]) if name in ("textarea", "title") else html[at:stop], ""
            yield "end", name, ""
            at = html.find(">", stop) + 1 if end and html.find(">", stop) >= 0 else n


class Stack(list):
    """Open elements, with the places of those of each name, so that no look-up walks over the others."""

    def __init__(self, nodes: list[Node]):
        super().__init__(nodes)
        self.places: dict[str, list[int]] = {}
        for i, x in enumerate(nodes):
            self.places.setdefault(x.tag, []).append(i)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self))
        self.append(node)

    def cut(self, n: int) -> None:
        """Ends all but the first ``n``."""
        while len(self) > n:
            self.places[self.pop().tag].pop()

    def last(self, tags: Iterable[str]) -> int:
        """Place of the newest of these names; -1 if none is open."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def first_after(self, tags: Iterable[str], i: int) -> int:
        """Place of the oldest of these names above place ``i``; the height if there is none."""
        return min((p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, i)) < len(p)), default=len(self))


def build(html: str) -> Node:
    root = Node("html", {})
    head, body = Node("head", {}), Node("body", {})
    root.children = [head, body]
    stack, in_head = Stack([root, head]), True

    def enter_body() -> None:
        nonlocal in_head, stack
        if in_head:
            in_head = False
            stack = Stack([root, body])

    def close(ends: frozenset, until: frozenset) -> None:
        if stack.last(ends) > 1:
            stack.cut(stack.first_after(ends, max(1, stack.last(until))))

    def place(child: Node | str, tag: str) -> None:
        """Under the current node; what may not stand between a table's parts goes before the table."""
        if stack[-1].tag in TABLE_PARTS and tag not in TABLE_TAGS and not (isinstance(child, str) and not BLANKS.sub("", child)):
            i = stack.last(["table"])
            siblings = stack[i - 1].children
            siblings.insert(next(k for k in range(len(siblings) - 1, -1, -1) if siblings[k] is stack[i]), child)
        else:
            stack[-1].children.append(child)

    for kind, value, rest in tokens(html):
        if kind == "text":
            if in_head and len(stack) == 2:
                if not BLANKS.sub("", value):
                    continue
                enter_body()
            if stack[-1].tag == "pre" and not stack[-1].children:
                value = value.removeprefix("\n")
            place(value, "#text")
        elif kind == "start":
            if value in ("html", "head", "body"):
                if value == "body":
                    enter_body()
                    body.attrs.update(_attributes(rest))
                continue
            if in_head and len(stack) == 2 and value not in IN_HEAD:
                enter_body()
            if value in ENDS_P:
                close(frozenset(["p"]), frozenset("td th caption table button".split()))
            if value in HEADINGS and stack[-1].tag in HEADINGS:
                stack.cut(len(stack) - 1)
            if value in IMPLIED_ENDS:
                close(*IMPLIED_ENDS[value])
            if value in ROOM:
                if stack.last(["table"]) < 0:
                    continue  # a part of no table is as if it weren't there
                stack.cut(stack.last(ROOM[value]) + 1)
            if value in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                row = Node("tr", {})
                stack[-1].children.append(row)
                stack.push(row)
            node = Node(value, _attributes(rest))
            place(node, value)
            if value not in VOID:
                stack.push(node)
        else:
            if value == "br":
                place(Node("br", {}), "br")
            elif value == "p" and stack.last(["p"]) < 0:
                enter_body()
                place(Node("p", {}), "p")
            elif value == "head":
                enter_body()
            elif value not in ("html", "body"):
                walls = () if value == "table" else ("table",) if value in TABLE_TAGS else ("td", "th", "caption")
                i = stack.last(HEADINGS if value in HEADINGS else (value,))
                if i > 1 and i >= stack.last(walls):
                    stack.cut(i)
    return root


def visible(node: Node, parent: Node | None = None) -> bool:
    if node.tag in UNSEEN or "hidden" in node.attrs or GONE.search(node.attrs.get("style", "")):
        return False
    if node.tag == "dialog" and "open" not in node.attrs:
        return False
    if parent is not None and parent.tag == "details" and "open" not in parent.attrs and node.tag != "summary":
        return False
    return True


class Page:
    """Lines being written: blanks collapse, and line ends asked for come before the next text only."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.ends, self.space, self.fresh, self.mark = 0, False, True, ""
        self.indents: list[int] = []
        self.indent = 0

    def indented(self, by: int) -> None:
        self.indents.append(by)
        self.indent += by

    def outdented(self) -> None:
        self.indent -= self.indents.pop()

    def block(self, ends: int) -> None:
        self.space = False
        if self.parts:
            self.ends = max(self.ends, ends)

    def _begin(self) -> None:
        if self.ends:
            self.parts.append("\n" * self.ends)
            self.fresh, self.ends = True, 0
        if self.fresh:
            lead = " " * min(INDENT, self.indent)
            if self.mark:
                lead = lead[: len(lead) - len(self.mark)] + self.mark
                self.mark = ""
            self.parts.append(lead)
            self.fresh, self.space = False, False
        elif self.space:
            self.parts.append(" ")
            self.space = False

    def text(self, s: str) -> None:
        words = [w for w in BLANKS.split(s) if w]
        if s and s[0] in " \t\n\r\f":
            self.space = True
        if words:
            self._begin()
            self.parts.append(" ".join(words))
            self.space = s[-1] in " \t\n\r\f"

    def lines(self, rows: list[str]) -> None:
        """As they are."""
        for i, r in enumerate(rows):
            if r:
                self._begin()
                self.parts.append(r)
            if i < len(rows) - 1:
                self.line_end()

    def line_end(self) -> None:
        self.space = False
        if self.parts:
            self.ends += 1

    def whole(self) -> str:
        return "".join(self.parts)


def _wrapped(cell: list[str]) -> list[str]:
    """A cell's lines, none over WIDEST but for a word that is longer or a line that has columns or an indent of its own."""
    out = []
    for line in cell:
        if len(line) <= WIDEST or "  " in line:
            out.append(line)
            continue
        taken = 0
        for word in line.split(" "):
            if taken and taken + 1 + len(word) <= WIDEST:
                out[-1] += " " + word
                taken += 1 + len(word)
            else:
                out.append(word)
                taken = len(word)
    return out


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []  # lines of the cell, columns, rows
        self.caption = ""

    def placed(self) -> Iterator[list[tuple[int, int, list[str]]]]:
        """The rows as (column, columns, lines) of their cells, to the right of cells that span rows from above."""
        below: dict[int, int] = {}  # rows that a column is still taken for
        for row in self.rows:
            at, out, taken = 0, [], {}
            for cell, span, deep in row:
                while below.get(at, 0) > 0:
                    at += 1
                out.append((at, span, cell))
                if deep > 1:
                    taken.update((k, deep) for k in range(at, at + span))
                at += span
            below = {k: n - 1 for k, n in (below | taken).items() if n > 1}
            yield out

    def lines(self) -> list[str]:
        rows = [[(at, span, _wrapped(cell)) for at, span, cell in row] for row in self.placed()]
        widths: dict[int, int] = {}
        for row in rows:
            for at, span, cell in row:
                if span == 1:
                    widths[at] = max(widths.get(at, 0), *(min(WIDEST, len(x)) for x in cell))
        edges = [0]
        for k in range(max((at + span for row in rows for at, span, _ in row), default=0)):
            edges.append(edges[-1] + widths.get(k, 0) + 2)
        out = [self.caption] if self.caption else []
        for row in rows:
            if not any("".join(c) for *_, c in row):
                continue
            left = [(at, span, iter(c), len(c)) for at, span, c in row]
            while any(n for *_, n in left):
                line = ""
                for i, (at, span, lines, n) in enumerate(left):
                    if not n:
                        continue
                    line = line.ljust(edges[at]) + next(lines)
                    left[i] = (at, span, lines, n - 1)
                    if len(line) > edges[at + span] - 2:
                        if span == 1:
                            break  # too long for its column: the cells after it go on below
                        line += "  "  # over several columns it pushes its neighbour
                out.append(line.rstrip())
        return out


def _number(s: str, default: int) -> int:
    return int(s) if re.fullmatch(r"-?[0-9]{1,6}", s.strip()) else default


def render(root: Node) -> str:
    pages, tables, lists, pre, flat = [Page()], [], [], 0, 0
    todo: list[tuple[Node | str, Node | None, bool]] = [(root, None, False)]
    while todo:
        node, parent, leaving = todo.pop()
        page = pages[-1]
        if isinstance(node, str):
            if parent is not None and parent.tag == "details" and "open" not in parent.attrs:
                continue
            if pre:
                page.lines(node.replace("\r\n", "\n").split("\n"))
            else:
                page.text(node)
            continue
        tag, ends = node.tag, 2 if node.tag in SPACED and not (node.tag in ("ul", "ol") and lists) else 1
        if flat and tag in ("td", "th"):
            page.text(" ")
        elif flat and tag in TABLE_PARTS | {"caption"} and leaving:
            flat -= tag == "table"
            page.block(ends)
        elif leaving:
            if tag in ("td", "th", "caption"):
                text = pages.pop().whole()
                if tag == "caption":
                    tables[-1].caption = text
                else:
                    deep = _number(node.attrs.get("rowspan", ""), 1)
                    tables[-1].rows[-1].append((text.split("\n"), max(1, min(COLUMNS, _number(node.attrs.get("colspan", ""), 1))),
                                                ROWS if deep == 0 else max(1, min(ROWS, deep))))
            elif tag == "table":
                page.lines(tables.pop().lines())
                page.block(2)
            elif tag in BLOCKS:
                pre -= tag == "pre"
                if tag == "li":
                    if page.mark:  # an empty item shows its mark only
                        page._begin()
                    page.outdented()
                elif tag in ("ul", "ol", "menu", "dir"):
                    lists.pop()
                    ends = 1 if lists or tag not in SPACED else 2
                elif tag in ("blockquote", "dd"):
                    page.outdented()
                page.block(ends)
        if leaving or not visible(node, parent):
            continue
        if flat and tag in TABLE_PARTS | {"td", "th", "caption"} or tag == "table" and len(tables) == NESTED:
            flat += tag == "table"
            if tag in BLOCKS:
                page.block(ends)
        elif tag in ("td", "th", "caption"):
            pages.append(Page())
        elif tag == "tr":
            tables[-1].rows.append([])
        elif tag == "br":
            page.line_end()
            continue
        elif tag == "hr":
            page.block(2)
            page.lines(["---"])
            page.block(2)
            continue
        elif tag == "table":
            page.block(2)
            tables.append(Table())
        elif tag in BLOCKS:
            page.block(ends)
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag, _number(node.attrs.get("start", ""), 1)])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    k = _number(node.attrs.get("value", ""), lists[-1][1])
                    mark, lists[-1][1] = f"{k}. ", k + 1
                if page.mark:  # a list that is the first thing in an item begins on the next line
                    page._begin()
                    page.block(1)
                page.indented(len(mark))
                page.mark = mark
            elif tag in ("blockquote", "dd"):
                page.indented(2)
            pre += tag == "pre"
        todo.append((node, parent, True))
        todo.extend((c, node, False) for c in reversed(node.children))
    return pages[0].whole()


def text_of(html: str) -> str:
    return "\n".join(x.rstrip(" ") for x in render(build(html)).split("\n"))


def extract(pages: DataFrame, html: str = "html", page_id: str = "page_id", row: str | None = None) -> DataFrame:
    """One row per input row: ``__row``, page_id, text. A null or empty page, and one that shows nothing, has an empty text.

    Repeated rows are rendered each for itself. No rows give no rows. Other columns are not read.
    """

    @F.pandas_udf("string")
    def rendered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([text_of(h) if isinstance(h, str) else "" for h in batch], dtype=object)

    rows = keyed(pages, page_id, row).select(ROW, F.col(page_id).alias("page_id"), F.col(html).cast("string").alias("html"))
    return rows.select(ROW, "page_id", rendered("html").alias("text"))
