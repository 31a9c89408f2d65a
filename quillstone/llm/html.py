"""HTML extraction by layout-aware rendering.

A tree builder splits a page into tags and text as the HTML standard does and supplies the tags that a page leaves out: ends of
paragraphs, list items, cells and rows, table bodies, and whatever an end tag closes with it. A renderer walks the tree
and emits all text that a browser would show: scripts, the head, templates, the bodies of closed details and elements whose
attributes, styles or the page's own style rules hide them are left out; what is visible again inside a hidden element
shows. Blocks stand on lines of their own, with a blank line where they have margins; list items keep their marks and their
depth; cells of a table are padded so that columns line up, over column and row spans.

Tables that hold other tables lay a page out: their cells are blocks, one after the other. Only tables that hold none are
aligned, so that nothing is laid out twice. Both passes take time in proportion to the page.
"""

from __future__ import annotations

import re
from collections import Counter
from bisect import bisect_right
from html import unescape
from unicodedata import combining, east_asian_width

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, table

# Fixed values of the HTML standard: element names by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript noframes iframe object video audio canvas datalist param rp area base col colgroup embed link meta source track input annotation annotation-xml desc metadata defs symbol mphantom".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset menu hr details".split())
BLOCK = MARGIN | frozenset("html body address article aside caption center dd dialog dir div dt figcaption footer form header hgroup legend li listing main nav optgroup option search section select summary tbody td textarea tfoot th thead tr".split())
#: A start tag ends an open element of these names, unless one of the second set lies between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
HEAD_ONLY = frozenset("base link meta script style template title noscript".split())
TABLE = frozenset("table tr tbody thead tfoot td th".split())
SCOPE = frozenset("table td th caption html template button object".split())
LISTS = frozenset("ul ol menu dir".split())
SPACE = re.compile(r"[ \t\n\r\f]+")
BULLET = "- "
#: Characters beyond which deeper lists are indented no further.
DEEPEST_INDENT = 80
#: Columns of a terminal up to which a table's column is as wide as its widest line, and up to which cells are aligned at all.
WIDEST, FARTHEST = 80, 400
#: The most columns and rows that a cell may span, as the standard has it.
COLUMNS, ROWS = 1000, 65534


class Node:
    __slots__ = ("name", "attrs", "children", "holds_table")

    def __init__(self, name: str, attrs: dict | None = None):
        self.name, self.attrs, self.children, self.holds_table = name, attrs or {}, [], False


class Tree:
    """Builds a tree of Nodes and strings; every page gives one. Open elements are also listed by name, so that no search walks over all."""

    def __init__(self):
        self.root = Node("html")
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}
        self.styles: list[Node] = []

    def last(self, names) -> int:
        """The place of the innermost open element of ``names``; 0 if none is open."""
        return max((at[-1] for n in names if (at := self.at.get(n))), default=0)

    def cut(self, place: int) -> None:
        """Ends the open elements from ``place`` on."""
        for node in self.open[place:]:
            self.at[node.name].pop()
        del self.open[place:]

    def end(self, names: set, within: set) -> None:
        """Ends the innermost-to-outermost open elements of ``names`` up to the nearest of ``within``."""
        barrier = self.last(within)
        found = [at[k] for n in names if (at := self.at.get(n)) and (k := bisect_right(at, barrier)) < len(at)]
        if found:
            self.cut(min(found))

    def add(self, name: str, attrs: dict | None = None) -> None:
        node = Node(name, attrs)
        self.open[-1].children.append(node)
        if name == "table" and (outer := self.last(["table"])):
            self.open[outer].holds_table = True
        if name == "style":
            self.styles.append(node)
        if name not in VOID:
            self.at.setdefault(name, []).append(len(self.open))
            self.open.append(node)

    def read(self, html: str) -> None:
        """Takes a page from its beginning to its end; no part is looked at twice. What never ends, as a quote or a comment, takes the rest."""
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0 or lt == n - 1:
                self.text(html[at:])
                return
            if TAG.match(html, lt + 1):
                if lt > at:
                    self.text(html[at:lt])
                name = NAME.match(html, lt + 1)
                at = self.start_tag(html, name[0].lower(), name.end())
            elif html[lt + 1] == "/" and TAG.match(html, lt + 2):
                if lt > at:
                    self.text(html[at:lt])
                name = NAME.match(html, lt + 2)
                at = html.find(">", name.end()) + 1 or n
                self.end_tag(name[0].lower())
            elif html[lt + 1] in "!?/":
                if lt > at:
                    self.text(html[at:lt])
                if html.startswith("<!--", lt):
                    at = lt + 5 if html.startswith(">", lt + 4) else html.find("-->", lt + 4) + 3
                    at = n if at == 2 else at
                else:
                    at = html.find(">", lt) + 1 or n
            else:
                after = html.find("<", lt + 1)  # a sign that begins no tag is text, and so is all up to the next one
                self.text(html[at : after if after > 0 else n])
                at = after if after > 0 else n

    def start_tag(self, html: str, name: str, at: int) -> int:
        """Reads the attributes of a tag and what belongs to it alone; gives the place behind."""
        attrs: dict[str, str] = {}
        closed = False
        while True:
            m = ATTRIBUTE.match(html, at)
            if m is None:
                gap = GAP.match(html, at)
                closed, at = "/" in gap[0], gap.end()
                if at >= len(html) or html[at] != ">":
                    return len(html)  # the page ends inside the tag
                break
            if m[2] is not None and m[2][:1] in ('"', "'") and (len(m[2]) < 2 or m[2][-1] != m[2][0]):
                return len(html)
            value = m[2] or ""
            attrs.setdefault(m[1].lower(), unescape(value[1:-1] if value[:1] in ('"', "'") else value))
            at = m.end()
        at += 1
        self.open_tag(name, attrs)
        if closed and (self.at.get("svg") or self.at.get("math")) and self.open[-1].name == name:
            self.cut(len(self.open) - 1)
        elif name in RAW or name in ("textarea", "title"):
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
            content = html[at : end.start() if end else len(html)]
            if content:
                self.open[-1].children.append(content if name in RAW else unescape(content))
            at = end.start() if end else len(html)
        elif name == "plaintext":
            self.open[-1].children.append(html[at:])
            at = len(html)
        return at

    def open_tag(self, name: str, attrs: dict) -> None:
        if name == "html":
            self.root.attrs = attrs | self.root.attrs
            return
        if self.open[-1].name == "head" and name not in HEAD_ONLY:
            self.cut(len(self.open) - 1)
        if name in CLOSES_P:
            self.end({"p"}, SCOPE)
        if name in IMPLIED:
            self.end(*IMPLIED[name])
        if name in ("td", "th") and self.open[-1].name in ("table", "tbody", "thead", "tfoot"):
            self.open_tag("tr", {})
        if name == "tr" and self.open[-1].name == "table":
            self.add("tbody")
        if name == "a":
            self.end({"a"}, SCOPE)
        self.add(name, attrs)

    def end_tag(self, name: str) -> None:
        if name == "br":
            self.add("br")
        elif name == "p" and not self.at.get("p"):
            self.add("p")
            self.cut(len(self.open) - 1)
        elif name not in ("html", "body"):
            place = self.last([name])
            if place and (name in TABLE or place > self.last(["td", "th", "table"])):
                self.cut(place)

    def text(self, data: str) -> None:
        if self.open[-1].name == "head" and not data.isspace():
            self.cut(len(self.open) - 1)
        self.open[-1].children.append(unescape(data) if "&" in data else data)


TAG, NAME = re.compile("[a-zA-Z]"), re.compile(r"[^\s/>]+")
#: A name with or without a value; a quote that isn't closed takes the rest of the page.
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
GAP = re.compile(r"[\s/]*")
#: Elements whose content is no markup.
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())

DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z-]+)", re.I)
COMPOUND = re.compile(r"(\*|[a-z][a-z0-9-]*)?((?:[.#][\w-]+)*)", re.I)


def declared(style: str) -> tuple[str | None, str | None]:
    """The last display and visibility that declarations give, in lower case."""
    style = style.lower()
    return tuple(found[-1] if word in style and (found := rule.findall(style)) else None for word, rule in (("display", DISPLAY), ("visibility", VISIBILITY)))


class Rules:
    """A page's own style rules for display and visibility: those whose selectors name an element by tag, classes and id.

    Selectors with combinators, attributes or pseudo-classes aren't followed; of at-rules only @media for screens are. Rules
    of one selector are one, the last of each property. The rarest of its names finds it, the others are checked.
    """

    def __init__(self, sheets: list[str]):
        merged: dict[tuple[str, frozenset], list] = {}
        order = 0
        for sheet in sheets:
            for selectors, body in self.blocks(re.sub(r"/\*.*?(?:\*/|$)", " ", sheet, flags=re.S)):
                given = declared(body)
                if any(given):
                    for selector in selectors.split(","):
                        if (m := COMPOUND.fullmatch(selector.strip())) and m[0]:
                            names = frozenset(re.findall(r"[.#][\w-]+", m[2]))
                            tag = (m[1] or "*").lower()
                            order += 1
                            ids = sum(x[0] == "#" for x in names)
                            values = merged.setdefault((tag, names), [None, None])
                            for k, value in enumerate(given):
                                if value:
                                    values[k] = ((ids, len(names) - ids, tag != "*", order), value)
        common = Counter(x for tag, names in merged for x in names or (tag,))
        self.by_key: dict[str, list] = {}
        for (tag, names), values in merged.items():
            self.by_key.setdefault(min(names or (tag,), key=lambda x: (common[x], x)), []).append((tag, names, values))

    @staticmethod
    def blocks(sheet: str):
        """(selectors, declarations) of the rules that apply on screens."""
        live, at = [True], 0
        for m in re.finditer(r"[{}]", sheet):
            before, at = sheet[at : m.start()], m.end()
            if m[0] == "{":
                prelude = before.rpartition(";")[2].strip().lower()
                media = prelude.startswith("@media") and ("screen" in prelude or "all" in prelude or "print" not in prelude)
                live.append(live[-1] and (media or not prelude.startswith("@")))
                opened = before.rpartition(";")[2].strip()
            elif len(live) > 1:
                if live.pop() and not opened.startswith("@") and opened:
                    yield opened, before
                opened = ""

    def of(self, node: Node) -> tuple[str | None, str | None]:
        """display and visibility of an element, its style attribute above the rules."""
        display = visibility = None
        if self.by_key:
            names = {f".{c}" for c in node.attrs.get("class", "").split()} | ({"#" + node.attrs["id"]} if node.attrs.get("id") else set())
            found = [values for key in (*names, node.name, "*") for tag, own, values in self.by_key.get(key, ()) if tag in ("*", node.name) and own <= names]
            display, visibility = (max(given)[1] if (given := [v[k] for v in found if v[k]]) else None for k in (0, 1))
        if "style" in node.attrs:
            d, v = declared(node.attrs["style"])
            display, visibility = d or display, v or visibility
        return display, visibility


def seen(node: Node, rules: Rules, visible: bool) -> tuple[bool, bool]:
    """Whether an element takes part in the page at all, and whether its own text is visible."""
    display, visibility = rules.of(node)
    gone = node.name in HIDDEN or (display == "none" if display else "hidden" in node.attrs or node.name == "dialog" and "open" not in node.attrs)
    return not gone, visible if visibility in (None, "inherit") else visibility == "visible"


class Page:
    """Lines of text, with what is due before the next word: spaces, line ends and blank lines collapse."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.prefix, self.mark = "", ""

    def block(self, margin: bool) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space, self.blank = False, self.blank or margin

    def begin(self) -> None:
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.line.append(self.prefix + self.mark)
            self.prefix, self.mark = (self.prefix + " " * len(self.mark))[:DEEPEST_INDENT], ""
            self.space = False

    def text(self, data: str) -> None:
        for k, word in enumerate(SPACE.split(data)):
            self.space = self.space or k > 0
            if word:
                started = bool(self.line)
                self.begin()
                if self.space and started:
                    self.line.append(" ")
                self.line.append(word)
                self.space = False

    def raw(self, data: str) -> None:
        for k, part in enumerate(data.replace("\r\n", "\n").split("\n")):
            if k:
                self.newline()
            if part:
                self.begin()
                self.line.append(part)

    def newline(self) -> None:
        if not self.line:
            self.begin()
        self.lines.append("".join(self.line).rstrip(" "))
        self.line, self.space = [], False

    def done(self) -> list[str]:
        self.block(False)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def columns(text: str) -> int:
    """How many columns of a terminal a text takes: wide characters take two, combining ones none."""
    return len(text) if text.isascii() else sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in text)


def span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "").strip()
    return max(1, min(int(value), most)) if value.isascii() and value.isdigit() and len(value) < 9 else 1


def aligned(rows: list[list[tuple[int, int, list[str]]]]) -> list[str]:
    """Rows of cells (columns and rows that it spans, lines) as lines: columns are as wide as their widest line and stand two spaces apart.

    A cell begins in the first column that no cell above reaches into. What a cell of several columns needs beyond their
    widths widens the last of them. A column is no wider than WIDEST: what stands behind a longer cell begins two spaces
    after it, and so does what would begin beyond FARTHEST, so that spaces stay in proportion to the cells.
    """
    placed: list[list[tuple[int, int, list[str]]]] = []
    taken: list[tuple[int, int, int]] = []  # (first column, column behind, row behind) of cells that reach further down
    for r, row in enumerate(rows):
        taken = [t for t in taken if t[2] > r]
        at, k, own = 0, 0, []
        for wide, high, lines in row:
            while k < len(taken) and taken[k][0] <= at:
                at, k = max(at, taken[k][1]), k + 1
            own.append((at, at + wide, lines, r + high))
            at += wide
        placed.append([c[:3] for c in own])
        more: list[tuple[int, int, int]] = []
        for begin, end, _, until in own:
            if until > r + 1 and r + 1 < len(rows):
                if more and more[-1][1:] == (begin, until):
                    begin = more.pop()[0]
                more.append((begin, end, until))
        if more:
            taken = sorted(taken + more)
    # only columns at which a cell begins or ends count
    edges = sorted({x for row in placed for b, e, _ in row for x in (b, e)})
    number = {x: k for k, x in enumerate(edges)}
    cells = [[(number[b], number[e], lines, max(map(columns, lines), default=0)) for b, e, lines in row] for row in placed]
    width = [0] * len(edges)
    for b, e, _, need in sorted((c for row in cells for c in row), key=lambda c: c[1] - c[0]):
        have = sum(width[b:e]) + 2 * (e - b - 1) if e - b > 1 else width[b]
        width[e - 1] = min(WIDEST, width[e - 1] + max(0, need - have))
    left = [0]
    for w in width:
        left.append(min(FARTHEST, left[-1] + w + 2))
    out = []
    for row in cells:
        for i in range(max((len(c[2]) for c in row), default=0)):
            line, at = [], 0
            for b, _, lines, _ in row:
                if i < len(lines) and lines[i]:
                    gap = max(2 if at else 0, left[b] - at)
                    line.append(" " * gap + lines[i])
                    at += gap + columns(lines[i])
            out.append("".join(line).rstrip())
    return out


def render(top: Node, rules: Rules, visible: bool = True) -> list[str]:
    """The lines of a node's visible text. Walks with a stack of its own, so that no page is nested too deep."""
    page = Page()
    lists: list[list] = []
    pre = 0
    # nodes with their visibility; at the end of an element its name and the indentation before it; the rows of a table
    todo: list[tuple] = [(n, visible) for n in reversed(top.children)]
    while todo:
        node, state = todo.pop()
        if isinstance(node, str):
            if state is True:
                page.raw(node) if pre else page.text(node)
            elif isinstance(state, tuple):  # the end of an element
                name, prefix = node, state[0]
                if name in LISTS and lists:
                    page.block(len(lists) == 1)
                    lists.pop()
                    page.prefix, page.mark = prefix, ""
                elif name == "li" and lists:
                    page.block(False)
                    page.prefix, page.mark = lists[-1][2], ""
                elif name == "dd":
                    page.block(False)
                    page.prefix = prefix
                elif name in ("pre", "textarea"):
                    pre -= 1
                if name in BLOCK:
                    page.block(name in MARGIN and not (name in LISTS and lists))
            continue
        if isinstance(node, list):
            page.block(False)
            for line in aligned([[(span(c, "colspan", COLUMNS), span(c, "rowspan", ROWS), render(c, rules, v)) for c, v in row] for row in node]):
                page.begin()
                page.line.append(line)
                page.block(False)
            page.block(True)
            continue
        name = node.name
        here, visible = seen(node, rules, state)
        if not here:
            continue
        children = node.children
        if name == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.name == "summary"][:1]
        if name == "br":
            page.newline()
        elif name == "hr":
            page.block(True)
        elif name == "wbr":
            pass
        elif name == "img":
            if visible:
                page.text(node.attrs.get("alt", ""))
        elif name == "table" and not node.holds_table:
            rows, captions, stray = parts(node, rules, visible)
            page.block(True)
            # what stands in a table outside its cells shows before it
            todo.append((rows, None))
            todo += [(n, v) for n, v in reversed(stray + captions)]
        else:
            if name in BLOCK:
                page.block(name in MARGIN and not (name in LISTS and lists))
            todo.append((name, (page.prefix,)))
            if name in LISTS:
                start = node.attrs.get("start", "1")
                lists.append([name == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1, page.prefix])
            elif name == "li" and lists:
                ordered, number, prefix = lists[-1]
                page.prefix, page.mark = prefix, f"{number}. " if ordered else BULLET
                lists[-1][1] = number + 1
            elif name == "dd":
                page.prefix = (page.prefix + "  ")[:DEEPEST_INDENT]
            elif name in ("pre", "textarea"):
                pre += 1
            todo += [(n, visible) for n in reversed(children)]
    return page.done()


def parts(node: Node, rules: Rules, visible: bool) -> tuple[list[list[tuple]], list[tuple], list[tuple]]:
    """The cells of a table by row, its captions, and whatever else stands in it, each with its visibility."""
    rows, captions, stray, todo = [], [], [], [(n, visible) for n in reversed(node.children)]
    while todo:
        n, state = todo.pop()
        if isinstance(n, str):
            stray += [(n, state)] * (not n.isspace())
            continue
        here, own = seen(n, rules, state)
        if not here:
            continue
        if n.name == "tr":
            rows.append([])
            for c in n.children:
                if isinstance(c, Node) and c.name in ("td", "th"):
                    shown, inside = seen(c, rules, own)
                    if shown:
                        rows[-1].append((c, inside))
                elif isinstance(c, Node) or not c.isspace():
                    stray.append((c, own))
        elif n.name in ("tbody", "thead", "tfoot"):
            todo += [(c, own) for c in reversed(n.children)]
        else:
            (captions if n.name == "caption" else stray).append((n, state))
    return rows, captions, stray


def visible_text(html: str | None) -> str:
    """All visible text of a page; a null or empty page has none."""
    tree = Tree()
    tree.read(html or "")
    rules = Rules(["".join(c for c in s.children if isinstance(c, str)) for s in tree.styles])
    here, visible = seen(tree.root, rules, True)
    return "\n".join(render(tree.root, rules, visible)) if here else ""


def extracted(pages: DataFrame) -> DataFrame:
    """page_id and text (never null), a row for each row of ``pages`` (page_id, html).

    Null and empty pages give an empty text, as do pages without visible text; malformed pages never fail, and pages of any
    length are read whole. An empty table stays empty. Repeated rows are alike; other columns of ``pages`` are neither read nor returned.
    """
    field = T.StructField("text", T.StringType())
    return add_columns(pages.select("page_id", "html"), "html", [field], lambda pages: ((visible_text(p),) for p in pages)).drop("html")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).select("page_id", F.length("text").cast("long").alias("n_chars"), "text")
