"""Visible text of HTML pages, laid out in lines.

A tokenizer feeds a tree builder, which opens and closes the elements that authors leave
out (body, table sections and rows, paragraphs, list items, cells). Rendering walks the tree:
elements that are not shown are skipped, blocks begin on lines of their own with blank
lines between paragraphs, list items get their marks, and table cells stand in columns.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import packed


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


#: fixed values: element names by their role in HTML
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style xmp iframe noembed noframes")
ESCAPABLE = _set("title textarea")
HEAD = _set("title meta link base style script template noscript basefont bgsound")
UNSHOWN = _set("head script style template iframe noembed noframes object audio video canvas datalist rp title meta link")
SPACED = _set("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure fieldset hr")
BLOCK = SPACED | _set(
    "html body address article aside center details dialog dd dir div dt figcaption footer form header hgroup li "
    "legend listing main nav optgroup option search section summary caption thead tbody tfoot tr td th plaintext xmp"
)
#: starting one of these ends an open paragraph
ENDS_P = (SPACED | _set(
    "address article aside center details dialog dir div dd dt fieldset figcaption footer form header hgroup li listing "
    "main nav search section summary plaintext"
)) - {"table"}
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
#: an element that is ended by the start of another, and what keeps the search for it inside
ENDED_BY = {
    "li": ("li", _set("ul ol menu dir")), "dt": ("dt dd", _set("dl")), "dd": ("dt dd", _set("dl")),
    "option": ("option", _set("select datalist optgroup")), "optgroup": ("option optgroup", _set("select datalist")),
    "rt": ("rt rp rb rtc", _set("ruby")), "rp": ("rt rp rb rtc", _set("ruby")),
    "tr": ("tr td th caption colgroup", _set("table")), "td": ("td th caption colgroup", _set("tr table")),
    "th": ("td th caption colgroup", _set("tr table")),
    "thead": ("thead tbody tfoot tr td th caption colgroup", _set("table")),
    "tbody": ("thead tbody tfoot tr td th caption colgroup", _set("table")),
    "tfoot": ("thead tbody tfoot tr td th caption colgroup", _set("table")),
    "caption": ("thead tbody tfoot tr td th caption colgroup", _set("table")),
    "colgroup": ("thead tbody tfoot tr td th caption colgroup", _set("table")),
}
TABLE_PARTS = _set("table thead tbody tfoot tr")
SCOPE = _set("table td th caption html template button object")

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
TAG_END = re.compile(r"[\s/]*>")
RULE_START = re.compile(r"[^{};]*([{};]|$)")
BRACE = re.compile(r"[{}]")
SIMPLE = re.compile(r"([a-z][\w-]*|\*)?((?:[.#][\w-]+)*)", re.I)
DECLARED = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?", re.I)
WIDTH = re.compile(r"(min|max)-width\s*:\s*(\d*\.?\d+)(px|r?em)?", re.I)
#: width in pixels of the screen that media queries ask for
SCREEN = 1280
#: cells are padded up to this width; longer ones reach out of their column, uncut
WIDEST, NESTED_TABLES = 60, 20
#: elements nested deeper become siblings, as in browsers
DEEPEST = 512


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None = None
    children: list = field(default_factory=list)


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", data, {}), ("start", name, attributes) and ("end", name, {}), comments left out."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], {}
            return
        m = TAG.match(page, lt)
        if m is None:
            nxt = page[lt + 1 : lt + 2]
            if nxt and nxt in "!?/":
                if lt > at:
                    yield "text", page[at:lt], {}
                end = page.find("-->" if page.startswith("<!--", lt) else ">", lt + 1)
                at = n if end < 0 else end + (3 if page.startswith("-->", end) else 1)
            else:
                yield "text", page[at : lt + 1], {}
                at = lt + 1
            continue
        if lt > at:
            yield "text", page[at:lt], {}
        attrs: dict[str, str] = {}
        at = m.end()
        while True:
            end = TAG_END.match(page, at)
            if end is not None:
                at = end.end()
                break
            a = ATTRIBUTE.match(page, at)
            if a is None:
                close = page.find(">", at)
                at = n if close < 0 else close + 1
                break
            attrs.setdefault(a[1].lower(), a[2] if a[2] is not None else a[3] if a[3] is not None else a[4] or "")
            at = a.end()
        name = m[2].lower()
        if m[1]:
            yield "end", name, {}
            continue
        yield "start", name, attrs
        if name in RAW or name in ESCAPABLE:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            stop = close.start() if close else n
            yield "raw" if name in RAW else "text", page[at:stop], {}
            if close:
                gt = page.find(">", stop)
                at = n if gt < 0 else gt + 1
                yield "end", name, {}
            else:
                at = n


class Builder:
    def __init__(self) -> None:
        self.root = Node("html", {})
        self.body: Node | None = None
        self.stack = [self.root]
        self.styles: list[str] = []

    def open(self, tag: str, attrs: dict[str, str]) -> Node:
        if len(self.stack) > DEEPEST:
            self.stack.pop()
        node = Node(tag, attrs, self.stack[-1])
        self.stack[-1].children.append(node)
        self.stack.append(node)
        return node

    def in_scope(self, tag: str, border: frozenset[str]) -> bool:
        for node in reversed(self.stack):
            if node.tag == tag:
                return True
            if node.tag in border:
                return False
        return False

    def close(self, tags: tuple[str, ...] | frozenset[str]) -> None:
        """Pops up to and including the nearest of the tags."""
        while len(self.stack) > 1:
            if self.stack.pop().tag in tags:
                return

    def need_body(self) -> None:
        if self.body is None:
            del self.stack[1:]
            self.body = self.open("body", {})
        elif len(self.stack) == 1:
            self.stack.append(self.body)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html":
            for k, v in attrs.items():
                self.root.attrs.setdefault(k, v)
            return
        if tag == "head":
            if self.body is None and len(self.stack) == 1:
                self.open("head", attrs)
            return
        if tag == "body":
            if self.body is None:
                self.need_body()
            self.body.attrs.update({k: v for k, v in attrs.items() if k not in self.body.attrs})
            return
        if self.body is None and tag in HEAD:
            if len(self.stack) == 1:
                self.open("head", {})
        elif self.body is None and not any(x.tag in ("template", "noscript") for x in self.stack):
            self.need_body()
        elif len(self.stack) == 1:
            self.need_body()
        if tag in ENDS_P and self.in_scope("p", SCOPE):
            self.close(("p",))
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.stack.pop()
        if self.stack[-1].tag == "colgroup" and tag not in ("col", "template"):
            self.stack.pop()
        if tag in ENDED_BY:
            enders, border = ENDED_BY[tag]
            self.end_open(enders.split(), border)
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            if self.stack[-1].tag == "table":
                self.open("tbody", {})
            self.open("tr", {})
        elif tag == "tr" and self.stack[-1].tag == "table":
            self.open("tbody", {})
        inside = self.stack[-1].tag in TABLE_PARTS
        if inside and tag not in ENDED_BY and tag not in ("col", "form", "input", "script", "style", "template"):
            self.foster(tag, attrs)
            return
        self.open(tag, attrs)
        # a form between the parts of a table is an empty element
        if tag in VOID or (inside and tag == "form"):
            self.stack.pop()

    def end_open(self, enders: list[str], border: frozenset[str]) -> None:
        """Ends every open element of the names, innermost first, within the border."""
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[depth].tag
            if tag in border:
                return
            if tag in enders:
                del self.stack[depth:]

    def foster(self, tag: str, attrs: dict[str, str]) -> None:
        """Content of a table outside of cells is placed before the table."""
        parent, at = self._before_table()
        new = Node(tag, attrs, parent)
        parent.children.insert(at, new)
        if tag not in VOID:
            self.stack.append(new)

    def _before_table(self) -> tuple[Node, int]:
        table = next((x for x in reversed(self.stack) if x.tag == "table"), None)
        if table is None:  # rows without a table
            return self.stack[-1], len(self.stack[-1].children)
        siblings = table.parent.children
        at = next(k for k in range(len(siblings) - 1, -1, -1) if siblings[k] is table)
        return table.parent, at

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        elif tag == "p" and not self.in_scope("p", SCOPE):
            self.start("p", {})
            self.close(("p",))
        elif tag in HEADINGS:
            if any(self.in_scope(h, SCOPE) for h in HEADINGS):
                self.close(HEADINGS)
        elif tag in ("html", "body"):
            pass
        elif tag == "head":
            if self.body is None:
                del self.stack[1:]
        else:
            border = frozenset({"table"}) if tag in ENDED_BY or tag == "tr" else SCOPE - {tag}
            if tag == "table":
                border = frozenset()
            if self.in_scope(tag, border):
                self.close((tag,))

    def text(self, data: str, raw: bool = False) -> None:
        top = self.stack[-1]
        if raw:
            if top.tag == "style" and for_screen(top.attrs.get("media", "")):
                self.styles.append(data)
            top.children.append(data)
            return
        if self.body is None and top.tag in ("html", "head"):
            if not data.strip():
                return
            self.need_body()
        elif len(self.stack) == 1:
            self.need_body()
        data = html.unescape(data) if "&" in data else data
        if self.stack[-1].tag == "colgroup" and data.strip():
            self.stack.pop()
        top = self.stack[-1]
        if top.tag in TABLE_PARTS:
            if data.strip():
                parent, at = self._before_table()
                parent.children.insert(at, data)
            return
        top.children.append(data)


def for_screen(media: str) -> bool:
    """Whether a list of media queries holds on a screen of ``SCREEN`` pixels; unknown features hold."""
    found = False
    for query in media.lower().split(","):
        words = query.split()
        negated = words[:1] == ["not"]
        kind = next((w for w in words if w not in ("not", "only")), "all")
        holds = kind.startswith("(") or kind in ("all", "screen")
        for side, value, unit in WIDTH.findall(query):
            pixels = float(value) * (16 if unit.endswith("em") else 1)
            holds = holds and (SCREEN >= pixels if side == "min" else SCREEN <= pixels)
        found = found or holds != negated
    return found


def screen_rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules of a sheet that hold on a screen, in order."""
    todo = [re.sub(r"/\*.*?\*/|<!--|-->", "", sheet, flags=re.S)]
    while todo:
        css, at = todo.pop(), 0
        while at < len(css):
            m = RULE_START.match(css, at)
            head, at = css[m.start() : m.start(1)].strip(), m.end()
            if m[1] != "{":
                continue
            depth, stop = 1, len(css)
            for b in BRACE.finditer(css, at):
                depth += 1 if b[0] == "{" else -1
                if depth == 0:
                    stop = b.start()
                    break
            body, at = css[at:stop], stop + 1
            if not head.startswith("@"):
                yield head, body
                continue
            name, _, condition = head[1:].replace("(", " (", 1).partition(" ")
            if (name.lower() == "media" and for_screen(condition)) or name.lower() in ("supports", "layer"):
                # the rules inside come before the rest of the sheet
                todo += [css[at:], body]
                break


def declared(body: str) -> list[tuple[str, str, bool]]:
    """(display or visibility, value, whether important) of the declarations."""
    return [(p.lower(), v.lower(), bool(important)) for p, v, important in DECLARED.findall(body)]


def hiding_rules(styles: list[str]) -> list[tuple[str, frozenset[str], frozenset[str], list[tuple[str, str, bool]]]]:
    """(tag, classes, ids, declarations) of the simple selectors that change whether elements are shown."""
    out = []
    for sheet in styles:
        for selectors, body in screen_rules(sheet):
            found = declared(body)
            if not found:
                continue
            for s in selectors.split(","):
                m = SIMPLE.fullmatch(s.strip())
                if m and m.group():
                    marks = re.findall(r"[.#][\w-]+", m[2])
                    out.append((
                        "" if m[1] in (None, "*") else m[1].lower(), frozenset(x[1:] for x in marks if x[0] == "."),
                        frozenset(x[1:] for x in marks if x[0] == "#"), found,
                    ))
    return out


class Layout:
    """Collects lines; text of a paragraph is held until the line ends."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.words: list[str] = []
        self.indents: list[str] = []
        self.mark: str | None = None
        self.gap = False

    def flow(self, text: str) -> None:
        self.words.append(text)

    def line(self) -> None:
        """Ends the line, if it has anything."""
        if not self.words:
            return
        text = "\n".join(re.sub(r"[ \t\r\n\f]+", " ", x).strip(" ") for x in "".join(self.words).split("\0"))
        self.words = []
        # a break at the end of a block adds no line
        text = text.removesuffix("\n")
        if text.strip("\n"):
            self.put(text.replace("\xa0", " ").split("\n"))

    def put(self, lines: list[str]) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        indent = "".join(self.indents)
        for k, x in enumerate(lines):
            lead = indent
            if self.mark is not None and k == 0:
                lead = indent[: len(indent) - len(self.mark)] + self.mark
                self.mark = None
            self.lines.append((lead + x).rstrip())

    def space(self) -> None:
        """A blank line before what comes next."""
        self.line()
        self.gap = True


class Renderer:
    def __init__(self, styles: list[str]) -> None:
        self.rules = hiding_rules(styles)

    def shown(self, node: Node, visible: bool) -> tuple[bool, bool]:
        """(whether the element has a box, whether its own text is visible)."""
        tag, attrs = node.tag, node.attrs
        if tag in UNSHOWN or (tag == "input" and attrs.get("type", "").lower() == "hidden"):
            return False, visible
        if node.parent is not None and node.parent.tag == "details" and "open" not in node.parent.attrs and tag != "summary":
            return False, visible
        # the strongest declaration decides, of equal ones the last
        best: dict[str, tuple[tuple, str]] = {}
        matching = []
        if self.rules:
            classes, own = frozenset(attrs.get("class", "").split()), {attrs.get("id", "")}
            matching = [((0, len(i), len(c), t != ""), d) for t, c, i, d in self.rules if t in ("", tag) and c <= classes and i <= own]
        style = attrs.get("style", "")
        if style:
            matching.append(((1, 0, 0, False), declared(style)))
        for weight, declarations in matching:
            for name, value, important in declarations:
                strength = (important, *weight)
                if name not in best or strength >= best[name][0]:
                    best[name] = (strength, value)
        closed = "hidden" in attrs or (tag == "dialog" and "open" not in attrs)
        if best["display"][1] == "none" if "display" in best else closed:
            return False, visible
        value = best["visibility"][1] if "visibility" in best else ""
        return True, value == "visible" if value in ("visible", "hidden", "collapse") else visible

    def render(self, top: Node, tables: int = 0, visible: bool = True) -> list[str]:
        """Lines of an element's content; the walk keeps its own stack, so nesting may be deep."""
        out = Layout()
        todo: list = [("children", top, visible, False)]
        while todo:
            kind, node, seen, pre = todo.pop()
            if kind == "children":
                closed = node.tag == "details" and "open" not in node.attrs
                for child in reversed(node.children):
                    if isinstance(child, str):
                        if seen and not closed:
                            todo.append(("text", child, seen, pre))
                    else:
                        todo.append(("open", child, seen, pre))
            elif kind == "text":
                if pre:
                    parts = node.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                    keep = [p.replace("\t", "        ").replace(" ", "\xa0") for p in parts]
                    out.flow("\0".join(keep))
                else:
                    out.flow(node)
            elif kind == "open":
                self.element(node, seen, pre, out, todo, tables)
            else:
                self.leave(node, out)
        out.line()
        return out.lines

    def element(self, node: Node, visible: bool, pre: bool, out: Layout, todo: list, tables: int) -> None:
        box, visible = self.shown(node, visible)
        if not box:
            return
        tag = node.tag
        if tag == "br":
            out.flow("\0")
            return
        if tag == "hr":
            out.space()
            if visible:
                out.put(["----"])
            out.gap = True
            return
        if tag == "wbr" or tag in VOID:
            return
        if tag == "table" and tables < NESTED_TABLES:
            out.space()
            lines = self.table(node, visible, tables + 1)
            if lines:
                out.put(lines)
            out.gap = True
            return
        if tag in SPACED and not (tag in ("ul", "ol", "menu", "dl") and self._in_list(node)):
            out.space()
        elif tag in BLOCK:
            out.line()
        if tag == "li":
            mark = self.mark(node)
            out.indents.append(" " * len(mark))
            out.mark = mark
        elif tag in ("blockquote", "dd"):
            out.indents.append("  ")
        pre = pre or tag in ("pre", "textarea", "listing", "xmp", "plaintext")
        todo.append(("close", node, visible, pre))
        todo.append(("children", node, visible, pre))

    @staticmethod
    def _in_list(node: Node) -> bool:
        return node.parent is not None and node.parent.tag in ("li", "dd")

    def leave(self, node: Node, out: Layout) -> None:
        tag = node.tag
        if tag in SPACED and not (tag in ("ul", "ol", "menu", "dl") and self._in_list(node)):
            out.space()
        elif tag in BLOCK:
            out.line()
        if tag == "li":
            if out.mark is not None:
                out.mark = None
            out.indents.pop()
        elif tag in ("blockquote", "dd"):
            out.indents.pop()

    @staticmethod
    def mark(node: Node) -> str:
        parent = node.parent
        if parent is None or parent.tag != "ol":
            return "- "
        # numbers are given once for all items of a list
        if "\0numbers" not in parent.attrs:
            parent.attrs["\0numbers"] = ""
            number = _int(parent.attrs.get("start"), 1)
            for child in parent.children:
                if isinstance(child, Node) and child.tag == "li":
                    number = _int(child.attrs.get("value"), number)
                    child.attrs["\0number"] = str(number)
                    number += 1
        return f"{node.attrs.get(chr(0) + 'number', '1')}. "

    def table(self, table: Node, visible: bool, depth: int) -> list[str]:
        """Captions above the rows; columns as wide as their widest cell of one column, up to WIDEST."""
        lines: list[str] = []
        rows: list[list[tuple[Node, bool]]] = []
        for part, seen in self._parts(table, visible):
            if part.tag == "caption":
                lines += self.render(part, depth, seen)
            elif part.tag == "tr":
                rows.append([x for c, s in self._parts(part, seen) for x in self._cell(c, s)])
            else:
                rows += [[x] for x in self._cell(part, seen)]
        grid: list[list[tuple[int, int, list[str]]]] = []
        held: dict[int, int] = {}
        for row in rows:
            placed, column, later = [], 0, {}
            for cell, seen in row:
                while held.get(column, 0) > 0:
                    column += 1
                span = min(1000, max(1, _int(cell.attrs.get("colspan"), 1)))
                down = min(len(rows), max(1, _int(cell.attrs.get("rowspan"), 1)))
                placed.append((column, span, self.render(cell, depth, seen)))
                later.update({c: down for c in range(column, column + span)})
                column += span
            held = {c: max(held.get(c, 0), later.get(c, 0)) - 1 for c in {*held, *later}}
            held = {c: v for c, v in held.items() if v > 0}
            grid.append(placed)
        width: dict[int, int] = {}
        for placed in grid:
            for column, span, cell in placed:
                if span == 1:
                    width[column] = max(width.get(column, 0), min(WIDEST, max(map(len, cell), default=0)))
        starts, at = {}, 0
        for column in range(max((c + s for row in grid for c, s, _ in row), default=0) + 1):
            starts[column] = at
            if column in width:
                at += width[column] + (2 if width[column] else 0)
        for placed in grid:
            height = max((len(cell) for *_, cell in placed), default=0)
            for k in range(height):
                text = ""
                for column, _, cell in placed:
                    if k < len(cell) and cell[k]:
                        text = text.ljust(starts[column]) if len(text) <= starts[column] else text + "  "
                        if text and not text.endswith(" "):
                            text += "  "
                        text += cell[k]
                lines.append(text.rstrip())
        while lines and not lines[-1]:
            lines.pop()
        return lines

    def _cell(self, node: Node, visible: bool) -> list[tuple[Node, bool]]:
        """The cell, or one around anything else that has text."""
        if node.tag in ("td", "th"):
            return [(node, visible)]
        todo = [node]
        while todo:
            for child in todo.pop().children:
                if isinstance(child, Node):
                    todo.append(child)
                elif child.strip():
                    return [(Node("td", {}, None, [node]), visible)]
        return []

    def _parts(self, node: Node, visible: bool) -> Iterator[tuple[Node, bool]]:
        """Shown rows, captions or cells below an element, sections taken apart."""
        for child in node.children:
            if isinstance(child, Node):
                box, seen = self.shown(child, visible)
                if box and child.tag in ("thead", "tbody", "tfoot"):
                    yield from self._parts(child, seen)
                elif box:
                    yield child, seen


def _int(value: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return int(m[1]) if m else default


def html_to_text(page: str) -> str:
    builder = Builder()
    for kind, data, attrs in tokens(page):
        if kind == "start":
            builder.start(data, attrs)
        elif kind == "end":
            builder.end(data)
        else:
            builder.text(data, kind == "raw")
    if builder.body is None:
        return ""
    renderer = Renderer(builder.styles)
    box, visible = renderer.shown(builder.body, renderer.shown(builder.root, True)[1])
    return "\n".join(renderer.render(builder.body, 0, visible)) if box and "hidden" not in builder.root.attrs else ""


def visible_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text): the laid-out visible text of every page, whole.

    A null page gives null, an empty one or one without visible text an empty text. Every
    row is taken by itself, so repeated rows give equal rows.
    """
    rows = packed(pages, id_col, html_col).select("id", F.col("text").cast("string").alias("text"))

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = [None if t is None else html_to_text(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["id", "text"])

    return rows.mapInArrow(read, f"id {rows.schema['id'].dataType.simpleString()}, text string")
