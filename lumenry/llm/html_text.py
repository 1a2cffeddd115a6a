"""Operator 4: visible text of HTML pages, laid out as the page lays it out.

A tree is built with the implied end tags of HTML; hidden subtrees are left out; blocks,
lists, preformatted text and table cells then decide where lines begin, what they are
indented by and how columns are padded. Nothing recurses, so depth is no limit.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

# Element sets of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
UNSEEN = frozenset("script style title template noscript noembed noframes iframe object audio video canvas datalist head rp desc metadata defs symbol clippath mask marker annotation annotation-xml".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure fieldset".split())
BLOCK = PARAGRAPH | frozenset(
    "address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li listing main menu nav optgroup option plaintext search section summary tbody td tfoot th thead tr xmp".split()
)
CLOSES_P = (BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup".split())) | {"hr"}
ROWS = frozenset(("thead", "tbody", "tfoot"))
CELLS = frozenset(("td", "th", "caption"))
# What an element closes as it begins, and what such closing doesn't reach beyond.
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir")) | CELLS | {"table"}),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",)) | CELLS | {"table"}),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",)) | CELLS | {"table"}),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (CELLS, frozenset(("table",))),
    "th": (CELLS, frozenset(("table",))),
    "caption": (CELLS | {"tr"} | ROWS, frozenset(("table",))),
    "tr": (CELLS | {"tr"}, frozenset(("table",))),
    **{k: (CELLS | {"tr"} | ROWS, frozenset(("table",))) for k in ROWS},
    "body": (frozenset(("head",)), frozenset()),
}
_P, _TABLE = frozenset(("p",)), frozenset(("table",))
P_SCOPE = CELLS | frozenset(("table", "button", "object", "template", "html"))

# A tag as the states of the tokenizer read it: names, and values that are quoted, open to the end, or bare (these may hold quotes).
_PART = r"[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?+"
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:" + _PART + r")*+)(?:>|\Z)|<(?:/[^>]*+(?:>|\Z))?", re.S
)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?+")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_DECLARATION = re.compile(r"(display|visibility)\s*:\s*([\w-]+)[^;]*?(!\s*important)?\s*(?:;|\Z)", re.I)
_HOLDS = re.compile(r"@(?:layer\b.*|media\s+(?:only\s+)?(?:all|screen)(?:\s*,.*)?)\s*\Z", re.I | re.S)
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*)?([.#][\w-]+)?\Z")
INDENTS = 40  # levels of indentation; what is nested deeper stands at the last one
ALIGNED = 6  # levels of nested tables whose columns are aligned; the cells of deeper ones are lines
WIDEST = 100  # characters that a column is padded to at most


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if text and not text.isspace():
        for name, a, b, c in _ATTRIBUTE.findall(text):
            out.setdefault(name.lower(), unescape(a or b or c))
    return out


def parse(html: str) -> Node:
    """The tree of a page; any text gives a tree."""
    root = Node("html")
    stack = [root]
    opened: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is open, so that nothing walks it

    def top(tags: frozenset) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def cut(at: int) -> None:
        for node in stack[at:]:
            opened[node.tag].pop()
        del stack[at:]

    def close(tags: frozenset, barrier: frozenset) -> None:
        """Ends the outermost open element of ``tags`` above ``barrier``, and what is in it."""
        limit = top(barrier)
        first = [opened[t][k] for t in tags if opened.get(t) and (k := bisect_right(opened[t], limit)) < len(opened[t])]
        if first:
            cut(min(first))

    def begin(tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        return node

    def push(node: Node) -> None:
        opened[node.tag].append(len(stack))
        stack.append(node)

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            stack[-1].children.append(unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        if m["name"] is None:
            if m[0] == "<":
                stack[-1].children.append("<")
            continue
        if html[at - 1] != ">":
            break  # a tag that the page doesn't end is none
        tag = m["name"].lower()
        if m["end"]:
            if tag == "br" or tag == "p" and not opened["p"]:
                begin(tag, {})
                continue
            barrier = _TABLE if tag in CELLS or tag in ROWS or tag == "tr" else CELLS
            if opened[tag] and (tag == "table" or opened[tag][-1] >= top(barrier)):
                cut(opened[tag][-1])
            continue
        if tag == "html" or tag == "body" and opened["body"]:
            told = stack[0 if tag == "html" else opened["body"][0]].attrs
            for k, v in _attributes(m["attrs"]).items():
                told.setdefault(k, v)
            continue
        if tag in CLOSES_P:
            close(_P, P_SCOPE)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ("td", "th") and stack[-1].tag != "tr":
            push(begin("tr", {}))
        node = begin(tag, _attributes(m["attrs"]))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            text = html[at : end.start() if end else size]
            node.children.append(unescape(text) if tag in ("textarea", "title") else text)
            at = end.end() if end else size
        elif tag not in VOID:
            push(node)
    return root


def _rules(sheet: str):
    """(selectors, declarations) of the rules that hold on a screen of any size: not those within print or other conditions."""
    holds, start = [True], 0
    sheet = _COMMENT.sub(" ", sheet)
    for m in re.finditer(r"[{};]", sheet):
        before = sheet[start : m.start()].strip()
        if m[0] == "{":
            if before.startswith("@"):
                holds.append(holds[-1] and bool(_HOLDS.match(before)))
            else:
                end = sheet.find("}", m.end())
                body = sheet[m.end() : end if end >= 0 else len(sheet)]
                if holds[-1]:
                    yield before, body
                holds.append(False)
        elif m[0] == "}" and len(holds) > 1:
            holds.pop()
        elif m[0] == ";" and not before.startswith("@"):
            continue
        start = m.end()


def _styles(root: Node) -> dict[tuple[str, str], dict[str, tuple]]:
    """Of simple selectors (element; class or id): for display and visibility, the winning (important, weight, order, value)."""
    out: dict[tuple[str, str], dict[str, tuple]] = {}
    todo, order = [root], 0
    while todo:
        node = todo.pop()
        if node.tag == "style":
            for selectors, body in _rules("".join(c for c in node.children if isinstance(c, str))):
                told = _DECLARATION.findall(body)
                for s in selectors.split(",") if told else ():
                    m = _SELECTOR.match(s.strip())
                    if m and (m[1] or m[2]):
                        weight = (100 if (m[2] or "")[:1] == "#" else 10 if m[2] else 0) + bool(m[1])
                        held = out.setdefault(((m[1] or "").lower(), m[2] or ""), {})
                        for name, value, important in told:
                            order += 1
                            new = (bool(important), weight, order, value.lower())
                            held[name.lower()] = max(held.get(name.lower(), new), new)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def _told(node: Node, styles: dict) -> dict[str, str]:
    """The display and visibility that the page's simple rules and the element's own style give it."""
    if not node.attrs and not styles:
        return {}
    best: dict[str, tuple] = {}
    if styles:
        marks = ["", *("." + c for c in node.attrs.get("class", "").split()), *(["#" + node.attrs["id"]] if "id" in node.attrs else [])]
        for key in ((t, m) for t in (node.tag, "") for m in marks):
            for name, new in styles.get(key, {}).items():
                best[name] = max(best.get(name, new), new)
    for k, (name, value, important) in enumerate(_DECLARATION.findall(node.attrs.get("style", ""))):
        new = (bool(important), 1000, k, value.lower())
        best[name.lower()] = max(best.get(name.lower(), new), new)
    return {name: x[3] for name, x in best.items()}


def _shown(node: Node, told: dict[str, str]) -> bool:
    if node.tag in UNSEEN or node.tag == "input":
        return False
    if "display" in told:
        return told["display"] != "none"
    return "hidden" not in node.attrs and not (node.tag == "dialog" and "open" not in node.attrs)


class _Flow:
    """Lines of text as blocks, breaks and list markers shape them."""

    def __init__(self):
        self.out: list[str] = []
        self.breaks = 0  # line ends that must stand before the next text
        self.fresh = True  # at the beginning of a line
        self.space = False
        self.indent: list[str] = []
        self.marker = ""

    def line_break(self, least: int) -> None:
        self.breaks = max(self.breaks, least)
        self.space = False

    def _begin(self) -> None:
        if self.breaks:
            if self.out:
                self.out.append("\n" * self.breaks)
            self.breaks, self.fresh = 0, True
        if self.fresh:
            prefix = "".join(self.indent[:INDENTS])
            if self.marker:
                prefix, self.marker = prefix[: max(0, len(prefix) - len(self.marker))] + self.marker, ""
            self.out.append(prefix)
            self.fresh = False
            self.space = False

    def text(self, text: str, kept: bool = False) -> None:
        if kept:
            for k, line in enumerate(text.split("\n")):
                if k:
                    self.breaks = self.breaks + 1 if self.out or self.breaks else 0
                if line:
                    self._begin()
                    self.out.append(line)
            return
        words = _SPACE.sub(" ", text)
        if not words.strip(" "):
            self.space = self.space or bool(words) and not self.fresh
            return
        self._begin()
        if (self.space or words[0] == " ") and self.out[-1][-1:] not in ("", " ") and not self.out[-1].endswith("\n"):
            self.out.append(" ")
        self.out.append(words.strip(" "))
        self.space = words[-1] == " "

    def lines(self, lines: list[str]) -> None:
        for line in lines:
            self.line_break(1)
            if line:
                self._begin()
                self.out.append(line)
            else:
                self.breaks += 1

    def done(self) -> str:
        return "\n".join(x.rstrip(" ") for x in "".join(self.out).strip("\n").split("\n"))


def _aligned(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Rows of (text, columns spanned), columns padded to one width and two spaces apart."""
    widths: list[int] = []
    for row in rows:
        at = 0
        for text, span in row:
            widths += [0] * (at + span - len(widths))
            if span == 1:
                widths[at] = max(widths[at], min(WIDEST, max(map(len, text.split("\n")))))
            at += span
    out = []
    for row in rows:
        cells, at = [], 0
        for text, span in row:
            cells.append((text.split("\n"), min(WIDEST, sum(widths[at : at + span]) + 2 * (span - 1))))
            at += span
        for k in range(max((len(c) for c, _ in cells), default=0)):
            out.append("  ".join((c[k] if k < len(c) else "").ljust(w) for c, w in cells).rstrip(" "))
    return out


def render(root: Node) -> str:
    """All visible text of a tree."""
    styles = _styles(root)
    flows = [_Flow()]
    tables: list[list[list[tuple[str, int]]]] = []
    numbers: list[int | None] = []  # of open lists: the next number, None where items have no numbers
    seen = [True]
    pre = drawn = lettered = 0  # open elements of preformatted text, of drawings, and of text in these
    plain: list[bool] = []  # of open tables: whether their cells are but lines
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if seen[-1] and (lettered or not drawn):
                flow.text(node.replace("\r\n", "\n") if pre else node, bool(pre))
            continue
        tag = node.tag
        gap = 2 if tag in PARAGRAPH and not (tag in ("ul", "ol") and len(numbers) > (1 if leaving else 0)) else 1 if tag in BLOCK else 0
        if not leaving:
            told = _told(node, styles)
            if not _shown(node, told):
                continue
            if tag == "br":
                flow.breaks, flow.space = flow.breaks + 1, False
                continue
            if tag == "hr":
                flow.line_break(1)
                continue
            if tag == "img" or tag in VOID:
                continue
            seen.append(told["visibility"] == "visible" if told.get("visibility") in ("visible", "hidden", "collapse") else seen[-1])
            drawn += tag == "svg"
            lettered += bool(drawn) and tag in ("text", "foreignobject")
            if tag in CELLS and tables and not plain[-1] or tag == "tr" and tables and not plain[-1]:
                pass
            elif gap:
                flow.line_break(gap)
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.attrs.get("start", "1")
                numbers.append((int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1) if tag == "ol" else None)
            elif tag == "li":
                number = numbers[-1] if numbers else None
                marker = "- " if number is None else f"{number}. "
                if number is not None:
                    numbers[-1] = number + 1
                flow.indent.append(" " * len(marker))
                flow.marker = marker
            elif tag == "dd" or tag == "blockquote":
                flow.indent.append("  ")
            elif tag in ("pre", "listing", "textarea", "xmp"):
                pre += 1
            elif tag == "table":
                plain.append(len(plain) >= ALIGNED)
                if not plain[-1]:
                    tables.append([])
            elif tag == "tr" and tables and not plain[-1]:
                tables[-1].append([])
            elif tag in CELLS and tables and not plain[-1]:
                flows.append(_Flow())
            todo.append((node, True))
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            todo += [(c, False) for c in reversed(children)]
            continue
        seen.pop()
        lettered -= bool(drawn) and tag in ("text", "foreignobject")
        drawn -= tag == "svg"
        if tag in ("ul", "ol", "menu", "dir"):
            numbers.pop()
        elif tag == "li":
            if flow.marker:  # an item without text
                flow._begin()
            flow.indent.pop()
        elif tag == "dd" or tag == "blockquote":
            flow.indent.pop()
        elif tag in ("pre", "listing", "textarea", "xmp"):
            pre -= 1
        elif tag in CELLS and tables and not plain[-1]:
            text = flows.pop().done()
            if tag == "caption":
                flows[-1].lines(text.split("\n"))
                continue
            if not tables[-1]:
                tables[-1].append([])
            span = node.attrs.get("colspan", "1")
            tables[-1][-1].append((text, min(max(int(span), 1), 1000) if re.fullmatch(r"\d{1,4}", span) else 1))
            continue
        elif tag == "table" and not plain.pop():
            rows = tables.pop()
            flow.lines(_aligned([r for r in rows if r]))
        if tag != "tr" and gap:
            flow.line_break(gap)
    return flows[0].done()


def text_of(html: str | None) -> str:
    return render(parse(html)) if html else ""


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text of each page, one row for each input row.

    Visible is all text but what is in elements that show none, has the attribute hidden,
    or is hidden by its own style or by a simple selector (element, class, id) of the
    page: the rule of the highest weight counts, the later one of equals, and none that
    holds in print or under a condition only. Of drawings, the text elements show. Up to
    INDENTS levels are indented, ALIGNED nested tables and WIDEST characters of a column
    aligned; deeper and longer text is shown as well, as plain lines. Paragraph-like elements stand apart by an empty line, other blocks by a line
    end; list items carry markers and indents; the columns of a table are padded. Null
    and empty pages give an empty text; text without tags gives itself, white space
    collapsed; broken tags end at the end of the page. Repeated rows give equal rows,
    pages may have any length and depth; other columns are not read.
    """

    def run(batches):
        for batch in W.chunks(batches, "html", 8 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([text_of(x) for x in batch.column("html").to_pylist()], pa.string())], names=["page_id", "text"])

    return W.small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, text string")
