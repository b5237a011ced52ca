"""Text of HTML pages as a page shows it: a tree builder with implied tags, visibility rules, and a layout in lines.

Tree: start tags close what they imply (a paragraph by a block, an item by an item, a cell by a cell, the head by what
doesn't belong there), end tags close what is open in their scope, stray content of a table goes before the table, and
elements nested deeper than ``MAX_DEPTH`` become siblings, but not between a table and its cells. Comments, declarations and raw text are read as in HTML.

Visibility: elements that browsers never show; ``hidden``; ``display: none`` and ``visibility`` in style attributes and
in style sheets of the page (rules on a tag, a class, an id, or a tag with one of these, and of at-rules those of layers
and of media that hold for a screen of ``SCREEN``); closed dialogs and the closed part of details; hidden inputs. All other text is emitted, navigation and footers included.

Layout: white space collapses but in preformatted text; blocks begin a line, and those with margins are set off by an
empty line; items have bullets or numbers and are indented; the cells of a table stand in columns padded to the widest
cell, up to ``max_width``. A row with a wider cell of several lines is written cell after cell. No-break spaces become
spaces.

A null page gives a null text, a page without visible text the empty one. Rows with null or repeated page_id are
rendered like others. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 100
#: Widest column that cells are padded to, if not said otherwise, and largest span that is honoured.
MAX_WIDTH, MAX_SPAN = 80, 1000
#: Pixels of the screen that pages are taken to be shown on, and of an em.
SCREEN, EM = {"width": 1280.0, "height": 800.0}, 16

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']?))*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s]+))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_CSS_MARK = re.compile(r"\\.|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[{};]", re.S)
_WIDTH_TEST = re.compile(r"\(\s*(min-|max-)?(?:device-)?(width|height)\s*:\s*([\d.]+)(px|em|rem)?\s*\)\Z")
_RANGE_TEST = re.compile(r"\(\s*(?:([\d.]+)(px|em|rem)?\s*([<>]=?)\s*)?(width|height)(?:\s*([<>]=?)\s*([\d.]+)(px|em|rem)?)?\s*\)\Z")
_SIMPLE = re.compile(r"([a-z][a-z0-9-]*)?(?:([.#])([\w-]+))?\Z", re.I)
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes".split())
_RCDATA = frozenset("title textarea".split())
_NEVER_SHOWN = frozenset("area audio base basefont canvas col colgroup datalist frameset head iframe link meta noembed noframes object param rp script source style template title track video".split())
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
_MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre xmp listing ul ol dl menu dir table figure fieldset hr".split())
_BLOCK = _MARGIN | frozenset("address article aside body center dd details dialog div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary caption".split())
#: Start tags before which an open paragraph ends.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p pre search section summary table ul xmp".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SECTIONS = frozenset("tbody thead tfoot".split())
_TABLE_PARTS = _SECTIONS | frozenset("table tr".split())
_IN_TABLE = _TABLE_PARTS | frozenset("td th caption colgroup col script style template".split())
#: Elements that end tags inside them, but those of parts of a table, and that start tags inside them don't reach beyond.
_FRAME = frozenset("td th caption template".split())
_BARRIER = frozenset("applet caption html table td th marquee object template button".split())

_KINDS = ("p", "li", "d", "option", "optgroup", "table", "section", "row", "cell")
_KIND_OF = {"p": "p", "li": "li", "dd": "d", "dt": "d", "option": "option", "optgroup": "optgroup", "table": "table", "tbody": "section", "thead": "section", "tfoot": "section", "tr": "row", "td": "cell", "th": "cell"}
_AT = {kind: k for k, kind in enumerate(_KINDS)}


class Node:
    __slots__ = ("tag", "attributes", "children", "before")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []
        self.before: list[Node | str] = []  # stray content of a table

    def get(self) -> dict[str, str]:
        found: dict[str, str] = {}
        if self.attributes:
            for name, value in _ATTRIBUTE.findall(self.attributes):
                value = value[1:-1] if value[:1] in "\"'" and len(value) > 1 and value[-1] == value[0] else value
                found.setdefault(name.lower(), unescape(value))
        return found


class TreeBuilder:
    """Open elements, each with the places of the nearest open elements that its content can close."""

    def __init__(self):
        self.root = Node("html")
        self.open: list[tuple[Node, tuple[int, ...]]] = [(self.root, (-1,) * len(_KINDS))]
        self.count: Counter[str] = Counter(["html"])
        self.frames: list[Counter[str]] = [Counter()]  # what is open in each open cell, innermost last
        self.styles: list[str] = []

    def _cut(self, size: int) -> None:
        """Closes elements until ``size`` are open."""
        for node, _ in reversed(self.open[size:]):
            self.count[node.tag] -= 1
            if node.tag in _FRAME:
                self.frames.pop()
            else:
                self.frames[-1][node.tag] -= 1
        del self.open[size:]

    def _close(self, kind: str) -> None:
        at = self.open[-1][1][_AT[kind]]
        if at > 0:
            self._cut(at)

    def _add(self, child: Node | str) -> None:
        top = min(len(self.open), MAX_DEPTH) - 1
        while top < len(self.open) - 1 and self.open[top][0].tag in _TABLE_PARTS:  # these show but parts of tables
            top += 1
        node = self.open[-1][0] if isinstance(child, str) else self.open[top][0]
        if node.tag in _TABLE_PARTS and not (child.isspace() if isinstance(child, str) else child.tag in _IN_TABLE):
            table = self.open[-1][1][_AT["table"]]
            if table >= 0:
                self.open[table][0].before.append(child)
                return
        node.children.append(child)

    def text(self, text: str) -> None:
        if self.open[-1][0].tag == "head" and not text.isspace():
            self._cut(len(self.open) - 1)
        self._add(text)

    def _push(self, node: Node) -> None:
        self._add(node)
        if node.tag in _VOID:
            return
        places = list(self.open[-1][1])
        tag = node.tag
        if tag in _BARRIER:
            for kind in ("p", "li", "d", "option", "optgroup"):
                places[_AT[kind]] = -1
        if tag in ("ul", "ol", "menu"):
            places[_AT["li"]] = -1
        elif tag == "dl":
            places[_AT["d"]] = -1
        elif tag == "select":
            places[_AT["option"]] = places[_AT["optgroup"]] = -1
        elif tag == "table":
            places[_AT["section"]] = places[_AT["row"]] = places[_AT["cell"]] = -1
        elif tag == "template":
            places = [-1] * len(_KINDS)
        if kind := _KIND_OF.get(tag):
            places[_AT[kind]] = len(self.open)
        self.open.append((node, tuple(places)))
        self.count[tag] += 1
        if tag in _FRAME:
            self.frames.append(Counter())
        else:
            self.frames[-1][tag] += 1

    def start(self, tag: str, attributes: str) -> Node | None:
        if tag in ("html", "body") and self.count[tag]:
            return None
        if self.open[-1][0].tag == "head" and tag not in _IN_HEAD:
            self._cut(len(self.open) - 1)
        if tag in _ENDS_P:
            self._close("p")
        if tag in _HEADINGS and self.open[-1][0].tag in _HEADINGS:
            self._cut(len(self.open) - 1)
        elif tag == "li":
            self._close("li")
        elif tag in ("dd", "dt"):
            self._close("d")
        elif tag == "option":
            self._close("option")
        elif tag == "optgroup":
            self._close("option")
            self._close("optgroup")
        elif tag in _IN_TABLE and self.open[-1][1][_AT["table"]] >= 0 and tag not in ("table", "script", "style", "template"):
            self._table_part(tag)
        elif tag == "table" and self.open[-1][0].tag in _TABLE_PARTS:
            self._close("table")
        node = Node(tag, attributes)
        self._push(node)
        return node

    def _table_part(self, tag: str) -> None:
        """Closes the cell, row or section that a part of a table ends, and opens what it implies."""
        if tag in ("td", "th"):
            self._close("cell")
            if self.open[-1][1][_AT["row"]] < 0:
                self._cut_to_table("section")
                self._push(Node("tr"))
            else:
                self._cut(self.open[-1][1][_AT["row"]] + 1)
        elif tag == "tr":
            self._close("row")
            self._cut_to_table("section")
        else:
            self._close("section")
            self._close("row")
            self._cut_to_table("table")

    def _cut_to_table(self, kind: str) -> None:
        places = self.open[-1][1]
        at = places[_AT[kind]] if places[_AT[kind]] >= 0 else places[_AT["table"]]
        self._cut(at + 1)

    def end(self, tag: str) -> None:
        if tag == "br":
            self._push(Node("br"))
        elif tag == "p" and self.open[-1][1][_AT["p"]] < 0:
            self._add(Node("p"))
        elif tag not in ("html", "body"):
            tags = _HEADINGS if tag in _HEADINGS else (tag,)
            reached = self.count if tag in _IN_TABLE else self.frames[-1]
            if any(reached[t] for t in tags):
                at = len(self.open) - 1
                while self.open[at][0].tag not in tags:
                    at -= 1
                self._cut(at)


def parse(html: str) -> tuple[Node, list[str]]:
    """The tree of a page, and its style sheets."""
    tree, at, n = TreeBuilder(), 0, len(html)
    while at < n:
        stop = html.find("<", at)
        if stop < 0:
            stop = n
        if stop > at:
            tree.text(unescape(html[at:stop]) if "&" in html[at:stop] else html[at:stop])
        if stop >= n:
            break
        found = _TAG.match(html, stop)
        if found:
            at = found.end()
            tag = found[2].lower()
            if found[1]:
                tree.end(tag)
                continue
            node = tree.start(tag, found[3])
            if tag in _RAW or tag in _RCDATA:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                raw = html[at : close.start() if close else n]
                at = close.start() if close else n
                if node is not None:
                    if tag == "style" and ("media" not in found[3].lower() or _holds(node.get().get("media", ""))):
                        tree.styles.append(raw)
                    node.children.append(unescape(raw) if tag in _RCDATA else raw)
            elif tag == "plaintext":
                tree.text(html[at:])
                break
            continue
        after = html[stop + 1 : stop + 2]
        if html.startswith("<!--", stop):
            close = re.compile(r"--!?>").search(html, stop + 2)
            at = close.end() if close else n
        elif after in ("!", "?") or html.startswith("</", stop) and html[stop + 2 : stop + 3].strip():
            close = html.find(">", stop)
            if after == "/" and html[stop + 2 : stop + 3].isalpha() and html[stop + 2 : stop + 3].isascii():
                break  # a tag that the page ends in is none
            at = close + 1 if close >= 0 else n
        elif after.isalpha() and after.isascii():
            break
        else:
            tree.text("<")
            at = stop + 1
    return tree.root, tree.styles


# --- visibility ------------------------------------------------------------------------------------------------------


def _declared(css: str) -> dict[str, str]:
    """display and visibility as a list of declarations sets them."""
    found = {}
    for part in css.lower().split(";"):
        name, _, value = part.partition(":")
        if (name := name.strip()) in ("display", "visibility"):
            found[name] = value.replace("!important", "").strip()
    return found


def _media_test(test: str) -> bool | None:
    """Whether a media type or feature holds for the screen; None if it isn't known."""
    if test in ("all", "screen"):
        return True
    if test in ("print", "speech", "aural", "braille", "embossed", "handheld", "projection", "tty", "tv"):
        return False
    pixels = lambda n, unit: float(n) * (EM if unit in ("em", "rem") else 1)
    try:
        if m := _WIDTH_TEST.match(test):
            has, asked = SCREEN[m[2]], pixels(m[3], m[4])
            return has >= asked if m[1] == "min-" else has <= asked if m[1] else has == asked
        if (m := _RANGE_TEST.match(test)) and (m[1] or m[6]):
            has, compare = SCREEN[m[4]], {"<": float.__lt__, "<=": float.__le__, ">": float.__gt__, ">=": float.__ge__}
            return (not m[1] or compare[m[3]](pixels(m[1], m[2]), has)) and (not m[6] or compare[m[5]](has, pixels(m[6], m[7])))
    except ValueError:
        return None
    if m := re.match(r"\(\s*orientation\s*:\s*(landscape|portrait)\s*\)\Z", test):
        return m[1] == "landscape"
    return None


def _holds(media: str) -> bool:
    """Whether a list of media queries holds for the screen. Queries that can't be told don't."""
    queries = [" ".join(q.lower().split()) for q in media.split(",")]
    if queries == [""]:
        return True
    for query in queries:
        negated = query.startswith("not ")
        query = query[4:] if negated else query.removeprefix("only ")
        tests = [_media_test(t) for t in query.split(" and ")]
        value = False if False in tests else None if None in tests else True
        if value is not None and value != negated:
            return True
    return False


def _rules(sheet: str):
    """(selectors, declarations) of the rules of a sheet that hold on a screen. Of at-rules, those of layers and of media
    that hold are gone into; other blocks, and rules within rules, are left out."""
    stack: list[tuple[bool, str | None, list[str]]] = [(True, None, [])]  # holds, selectors (None: a list of rules), declarations
    begin, spoiled = 0, False  # spoiled: what stands before the next block makes it no rule
    for mark in _CSS_MARK.finditer(sheet):
        if mark[0] not in ("{", "}", ";"):
            continue
        holds, selectors, declarations = stack[-1]
        before = sheet[begin : mark.start()]
        if mark[0] == "{":
            prelude = before.strip()
            name = re.match(r"@[\w-]*", prelude)
            if selectors is not None or spoiled:
                stack.append((False, "", []))
            elif not name:
                stack.append((holds, prelude, []))
            elif name[0].lower() == "@media":
                stack.append((holds and _holds(prelude[len(name[0]) :]), None, []))
            else:
                stack.append((holds, None, []) if name[0].lower() == "@layer" else (False, "", []))
            spoiled = False
        elif mark[0] == ";":
            if selectors is not None:
                declarations.append(before)
            else:
                spoiled |= not before.lstrip().startswith("@")
        else:
            spoiled = len(stack) == 1
            if not spoiled:
                stack.pop()
                if holds and selectors:
                    yield selectors, ";".join([*declarations, before])
        begin = mark.end()
    holds, selectors, declarations = stack[-1]
    if holds and selectors:  # the sheet ends in it
        yield selectors, ";".join([*declarations, sheet[begin:]])


class Styles:
    """Rules of a page's style sheets that hide or show; those with other selectors than simple ones are left out."""

    def __init__(self, sheets: list[str]):
        self.rules: dict[tuple[str, str, str], dict[str, str]] = {}
        for sheet in sheets:
            if "display" not in sheet.lower() and "visibility" not in sheet.lower():
                continue
            for selectors, css in _rules(_CSS_COMMENT.sub(" ", sheet)):
                if declared := _declared(css):
                    for selector in selectors.split(","):
                        if (m := _SIMPLE.match(selector.strip())) and m[0]:
                            self.rules.setdefault(((m[1] or "").lower(), m[2] or "", m[3] or ""), {}).update(declared)

    def of(self, node: Node, attributes: dict[str, str]) -> dict[str, str]:
        """Declarations that hold for an element: of its tag, its classes, its id, then its own."""
        found: dict[str, str] = {}
        if self.rules:
            classes, name = attributes.get("class", "").split(), attributes.get("id", "").strip()
            for key in ((node.tag, "", ""), *((t, ".", c) for c in classes for t in ("", node.tag)), *((t, "#", name) for t in ("", node.tag))):
                found.update(self.rules.get(key, {}))
        if "style" in attributes:
            found.update(_declared(attributes["style"]))
        return found


# --- layout ----------------------------------------------------------------------------------------------------------


def _width(line: str) -> int:
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


def _int(text: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return int(m[1]) if m else default


class _Lines(list):
    """Lines of a block, and whether its margins set off what stands above and below."""

    top = bottom = False


class _Flow:
    """Lines of a block: inline text is gathered, blocks are appended."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.spaced = True  # the inline text ends with a space, or hasn't begun
        self.gap = False  # what comes next is set off by an empty line
        self.top = False  # so is what the first line is

    def text(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.inline.append(first)
            for line in rest:
                self.flush(True)
                self.inline.append(line)
            self.spaced = not self.inline or self.inline[-1][-1:] in ("", " ")
            return
        text = _SPACE.sub(" ", text)
        if self.spaced and text[:1] == " ":
            text = text[1:]
        if text:
            self.inline.append(text)
            self.spaced = text[-1] == " "

    def flush(self, empty: bool = False) -> None:
        line = "".join(self.inline).rstrip(" ")
        self.inline, self.spaced = [], True
        if line or empty:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append(line)

    def block(self, lines: list[str], margin: bool) -> None:
        """Margins of a block's first and last blocks are its own too."""
        self.flush()
        if not lines:
            self.gap |= margin and bool(self.lines)
            return
        top, bottom = (lines.top, lines.bottom) if isinstance(lines, _Lines) else (False, False)
        if not self.lines:
            self.top = margin or top
        elif margin or top or self.gap:
            self.lines.append("")
        self.lines += lines
        self.gap = margin or bottom

    def done(self) -> "_Lines":
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        found = _Lines(self.lines)
        found.top, found.bottom = self.top, self.gap
        return found


class _Renderer:
    def __init__(self, styles: Styles, max_width: float):
        self.styles, self.max_width = styles, max_width

    def block(self, children: list, shown: bool, pre: bool = False, depth: int = 0) -> list[str]:
        flow = _Flow()
        for child in children:
            self.node(child, flow, shown, pre, depth)
        return flow.done()

    def _seen(self, node: Node, shown: bool) -> tuple[bool | None, dict[str, str]]:
        """Whether the element's own text is visible (None: nothing in it is), and its attributes."""
        if node.tag in _NEVER_SHOWN:
            return None, {}
        attributes = node.get()
        if "hidden" in attributes or node.tag == "dialog" and "open" not in attributes:
            return None, attributes
        if attributes or self.styles.rules:
            style = self.styles.of(node, attributes)
            if style.get("display") == "none":
                return None, attributes
            if (v := style.get("visibility")) in ("hidden", "collapse"):
                shown = False
            elif v == "visible":
                shown = True
        return shown, attributes

    def node(self, node: Node | str, flow: _Flow, shown: bool, pre: bool, depth: int) -> None:
        if isinstance(node, str):
            if shown:
                flow.text(node, pre)
            return
        seen, attributes = self._seen(node, shown)
        tag = node.tag
        if seen is None:
            return
        if tag == "br":
            flow.flush(True)
        elif tag == "hr":
            flow.block([], True)
        elif tag == "input":
            if seen and attributes.get("type", "text").lower() not in ("hidden", "checkbox", "radio", "file", "password", "image", "color", "range"):
                flow.text(attributes.get("value", ""), False)
        elif tag in ("ul", "ol", "menu", "dir"):
            flow.block(self._list(node, attributes, seen, pre, depth), depth == 0)
        elif tag == "table":
            for child in node.before:
                self.node(child, flow, seen, pre, depth)
            flow.block(self._table(node, seen, pre), True)
        elif tag in ("td", "th"):  # outside a table
            flow.text(" ", False)
            self._inside(node, flow, seen, pre, depth)
            flow.text(" ", False)
        elif tag in ("dd", "blockquote", "optgroup") or tag == "option":
            lines = self.block(node.children, seen, pre, depth)
            if tag == "optgroup" and attributes.get("label"):
                lines = [attributes["label"], *("  " + x if x else "" for x in lines)]
            elif tag in ("dd", "blockquote"):
                lines = ["  " + x if x else "" for x in lines]
            flow.block(lines, tag == "blockquote")
        elif tag in ("pre", "xmp", "listing", "textarea"):
            children = node.children
            if children and isinstance(children[0], str) and children[0][:1] == "\n":
                children = [children[0][1:], *children[1:]]
            flow.block(self.block(children, seen, True, depth), tag != "textarea")
        elif tag == "details" and "open" not in attributes:
            first = next((c for c in node.children if isinstance(c, Node) and c.tag == "summary"), None)
            flow.block(self.block([first] if first else [], seen, pre, depth), False)
        elif tag in _BLOCK or tag in ("tr", "tbody", "thead", "tfoot"):
            flow.block(self.block(node.children, seen, pre, depth), tag in _MARGIN)
        else:
            self._inside(node, flow, seen, pre, depth)

    def _inside(self, node: Node, flow: _Flow, shown: bool, pre: bool, depth: int) -> None:
        for child in node.children:
            self.node(child, flow, shown, pre, depth)

    def _list(self, node: Node, attributes: dict[str, str], shown: bool, pre: bool, depth: int) -> list[str]:
        flow, numbered = _Flow(), node.tag == "ol"
        back = -1 if "reversed" in attributes else 1
        items = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if back < 0 else 1
        number = _int(attributes.get("start"), items)
        for child in node.children:
            if not isinstance(child, Node) or child.tag != "li":
                self.node(child, flow, shown, pre, depth + 1)
                continue
            seen, own = self._seen(child, shown)
            if seen is None:
                continue
            number = _int(own.get("value"), number) if numbered else number
            lines = self.block(child.children, seen, pre, depth + 1)
            marker = f"{number}. " if numbered else "- "
            number += back
            if lines:
                indent = " " * len(marker)
                flow.block([marker + lines[0], *(indent + x if x else "" for x in lines[1:])], False)
        return flow.done()

    def _rows(self, node: Node, shown: bool, out: list, captions: list) -> None:
        """Rows of a table in the order they are shown in: heads, bodies, feet."""
        groups: dict[str, list] = {"thead": [], "": [], "tfoot": []}
        for child in node.children:
            if not isinstance(child, Node):
                continue
            seen, _ = self._seen(child, shown)
            if seen is None:
                continue
            if child.tag == "caption":
                captions.append((child, seen))
            elif child.tag == "tr":
                groups[""].append((child, seen))
            elif child.tag in _SECTIONS:
                rows = [(c, s[0]) for c in child.children if isinstance(c, Node) and c.tag == "tr" and (s := self._seen(c, seen))[0] is not None]
                groups[child.tag if child.tag != "tbody" else ""] += rows
        out += groups["thead"] + groups[""] + groups["tfoot"]

    def _table(self, node: Node, shown: bool, pre: bool) -> list[str]:
        rows: list[tuple[Node, bool]] = []
        captions: list[tuple[Node, bool]] = []
        self._rows(node, shown, rows, captions)
        flow = _Flow()
        for caption, seen in captions:
            flow.block(self.block(caption.children, seen, pre), False)
        grid: list[list[tuple[int, int, list[str]]]] = []  # of each row: column, span, lines
        below: dict[int, int] = {}  # column -> rows that a cell above still reaches into
        widths: dict[int, int] = {}
        for row, row_shown in rows:
            cells, column, reach = [], 0, {}
            for cell in row.children:
                if not isinstance(cell, Node) or cell.tag not in ("td", "th"):
                    continue
                seen, attributes = self._seen(cell, row_shown)
                if seen is None:
                    continue
                while below.get(column, 0) > 0:
                    column += 1
                span = min(max(1, _int(attributes.get("colspan"), 1)), MAX_SPAN)
                down = min(max(1, _int(attributes.get("rowspan"), 1)), MAX_SPAN)
                lines = self.block(cell.children, seen, pre)
                if down > 1:
                    reach.update(dict.fromkeys(range(column, column + span), down))
                if span == 1 and len(lines) < 2 and lines and (width := _width(lines[0])) <= self.max_width:
                    widths[column] = max(widths.get(column, 0), width)
                cells.append((column, span, lines))
                column += span
            below = {c: d - 1 for c, d in (below | reach).items() if d > 1}
            grid.append(cells)
        for cells in grid:
            flow.block(self._row(cells, widths), False)
        return flow.done()

    def _row(self, cells: list[tuple[int, int, list[str]]], widths: dict[int, int]) -> list[str]:
        height = max((len(lines) for _, _, lines in cells), default=0)
        if height > 1 and any(_width(x) > self.max_width for _, _, lines in cells for x in lines):
            return [x for _, _, lines in cells for x in lines]
        out = []
        own = {c: max((_width(x) for x in lines), default=0) for c, span, lines in cells if span == 1}
        for k in range(height):
            line, filled, at = [], 0, 0  # filled: width so far; at: where the next column begins
            column = 0
            for c, span, lines in cells:
                while column < c:
                    at += widths[column] + 2 if column in widths else 0
                    column += 1
                text = lines[k] if k < len(lines) else ""
                if text:
                    pad = max(at - filled, 2 if line else 0)
                    line.append(" " * pad + text)
                    filled += pad + _width(text)
                for column in range(c, c + span):
                    width = max(widths.get(column, 0), own.get(c, 0) if span == 1 and height > 1 else 0)
                    at += width + 2 if width else 0
                column = c + span
            out.append("".join(line).rstrip(" "))
        return out


def visible_text(html: str | None, max_width: int | None = MAX_WIDTH) -> str | None:
    """The text that a page shows, in lines. Without a max_width columns are as wide as their widest cell, whatever that
    makes of the table's size."""
    if html is None:
        return None
    root, sheets = parse(html)
    styles = Styles(sheets)
    return "\n".join(_Renderer(styles, float("inf") if max_width is None else max_width).block([root], True)).replace("\xa0", " ")


def extract_text(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", max_width: int | None = MAX_WIDTH) -> DataFrame:
    """(page_id, text) of each row of pages (page_id, html)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([visible_text(x, max_width) for x in batch.column(1).to_pylist()], pa.string())], names=[id_column, "text"])

    return pages.select(F.col(id_column).cast("long").alias(id_column), html_column).mapInArrow(run, f"{id_column} long, text string")
