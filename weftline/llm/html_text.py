"""Operator 7: HTML extraction by layout-aware rendering.

A tree builder reads the tags, puts in the end tags that HTML lets authors leave out, and drops what no browser shows:
scripts, styles, templates, closed details and dialogs, elements with ``hidden``, and those that an inline style or a
simple rule of a style sheet (tag, ``.class``, ``#id`` or ``tag.class``) hides. The renderer then walks the tree: blocks start lines, paragraphs keep an
empty line between them, lists have markers and indentation, preformatted text stays as it is, and table cells stand in
columns. All visible text is given, headings, navigation and footers included.

Defined results:
- a null page gives a null text; an empty page, or one that shows nothing, an empty text;
- broken markup never fails: end tags without a start are ignored, open elements end with the page, a tag that isn't
  closed takes the rest of the page up to the next ``>``, or is text if there is none;
- a table column is padded up to ``ALIGN`` characters; longer cells are shown whole and only reach past their column;
- tags nest to any depth and pages have any length; work grows with the length;
- rows with a null id, and repeated rows, each give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftline.llm.batches import map_rows

ALIGN = 100
SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_lines", T.IntegerType())])

STRICT = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?>"[^"]*"|'[^']*'|[^'">])*+)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SPACES = re.compile(r"[ \t\n\r\f]+")
GONE = re.compile(r"display\s*:\s*none", re.I)
UNSEEN = re.compile(r"visibility\s*:\s*(?:hidden|collapse)", re.I)
SEEN = re.compile(r"visibility\s*:\s*visible", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
END_OF = {t: re.compile(f"</{t}(?![a-zA-Z0-9])", re.I) for t in RAW}
NEVER = frozenset("script style template noscript iframe noembed noframes head title datalist audio video canvas object rp".split())
PARTED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table hr figure fieldset menu dir".split())
BLOCK = PARTED | frozenset("html body address article aside center dd details dialog dt div figcaption footer form header hgroup legend li main nav option optgroup search section summary caption tr thead tbody tfoot td th".split())
CLOSES_P = BLOCK - frozenset("html body option optgroup td th tr thead tbody tfoot caption legend".split())
LISTS = frozenset(("ul", "ol", "menu", "dir"))
#: A start tag ends the open elements of the second group, up to an element of the third.
IMPLIED = {
    "li": (frozenset(("li",)), LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "tr": (frozenset(("tr", "td", "th", "caption")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "thead": (frozenset(("thead", "tbody", "tfoot", "caption")), frozenset(("table",))),
    "tbody": (frozenset(("thead", "tbody", "tfoot", "caption")), frozenset(("table",))),
    "tfoot": (frozenset(("thead", "tbody", "tfoot", "caption")), frozenset(("table",))),
    "rt": (frozenset(("rt", "rp")), frozenset(("ruby",))),
    "rp": (frozenset(("rt", "rp")), frozenset(("ruby",))),
}
#: End tags don't reach past these, unless they are their own.
WALLS = frozenset(("table", "td", "th", "caption", "template", "html"))


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return out


class Tree:
    """Builds the tree of one page."""

    def __init__(self, page: str):
        self.root = Node("html", "")
        self.stack, self.open = [self.root], {"html": 1}
        self.styles: list[str] = []
        self._read(page)

    def _pop(self) -> None:
        self.open[self.stack.pop().tag] -= 1

    def _up_to(self, tags: frozenset, walls: frozenset) -> None:
        """End the outermost element of ``tags`` above the nearest of ``walls``, and all in it."""
        if not any(self.open.get(t) for t in tags):
            return
        cut = None
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in tags:
                cut = i
            elif tag in walls:
                break
        if cut is not None:
            while len(self.stack) > cut:
                self._pop()

    def _start(self, tag: str, attrs: str) -> None:
        if tag == "html":
            self.root.attrs += " " + attrs
            return
        if tag in ("head", "body") and self.open.get(tag):
            return
        if self.open.get("head") and tag not in ("base", "link", "meta", "title", "script", "style", "noscript", "template"):
            self._up_to(frozenset(("head",)), frozenset())
        if tag in CLOSES_P and self.open.get("p"):
            self._up_to(frozenset(("p",)), WALLS)
        if tag in IMPLIED:
            self._up_to(*IMPLIED[tag])
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push(Node("tr", ""))
        node = Node(tag, attrs)
        if tag in VOID:
            self.stack[-1].children.append(node)
        else:
            self._push(node)

    def _push(self, node: Node) -> None:
        self.stack[-1].children.append(node)
        self.stack.append(node)
        self.open[node.tag] = self.open.get(node.tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag in ("br", "p") and not self.open.get(tag):
            self._start(tag, "")
            if tag == "p":
                self._pop()
            return
        if not self.open.get(tag) or tag in ("html", "body"):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            here = self.stack[i].tag
            if here == tag:
                while len(self.stack) > i:
                    self._pop()
                return
            if here in WALLS and tag not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "template"):
                return
            if here == "table" and tag != "table":
                return

    def _text(self, text: str) -> None:
        if text:
            if self.open.get("head") and not text.isspace():
                self._up_to(frozenset(("head",)), frozenset())
            self.stack[-1].children.append(unescape(text) if "&" in text else text)

    def _read(self, page: str) -> None:
        at, size, tags = 0, len(page), STRICT
        nothing_ends = False  # no ">" is left
        while at < size:
            low = page.find("<", at)
            if low < 0:
                break
            if page.startswith("<!--", low):
                self._text(page[at:low])
                end = page.find("-->", low + 4)
                at = size if end < 0 else end + 3
                continue
            after = page[low + 1 : low + 2]
            if after in ("!", "?"):
                self._text(page[at:low])
                end = page.find(">", low)
                at = size if end < 0 else end + 1
                continue
            if nothing_ends or not (after == "/" or after.isalpha()):
                self._text(page[at : low + 1])
                at = low + 1
                continue
            m = tags.match(page, low)
            if not m and tags is STRICT and page.find(">", low) >= 0 and (page.find('"', low) >= 0 or page.find("'", low) >= 0):
                m = LOOSE.match(page, low)
                tags = LOOSE if m else tags  # a quote is never closed: from here on quotes mean nothing
            if not m:
                nothing_ends = page.find(">", low) < 0
                self._text(page[at : low + 1])
                at = low + 1
                continue
            self._text(page[at:low])
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW and self.stack[-1].tag == tag:
                found = END_OF[tag].search(page, at)
                end = found.start() if found else -1
                inner = page[at:] if end < 0 else page[at:end]
                if tag == "style":
                    self.styles.append(inner)
                if tag not in NEVER:
                    self.stack[-1].children.append(unescape(inner))
                self._pop()
                close = page.find(">", end) if end >= 0 else -1
                at = size if close < 0 else close + 1
        self._text(page[at:])


def sheet(styles: list[str]) -> dict[str, bool]:
    """Simple selectors that hide: True where they take the element away, False where they make it invisible."""
    out: dict[str, bool] = {}
    for text in styles:
        for selectors, body in RULE.findall(text):
            if (gone := bool(GONE.search(body))) or UNSEEN.search(body):
                for s in selectors.split(","):
                    if re.fullmatch(r"[\w-]*[.#]?[\w-]+", s := s.strip()):
                        out[s if s[:1] in ".#" or "." in s or "#" in s else s.lower()] = gone
    return out


class Lines:
    """Text of one flow: the page, or a table cell."""

    __slots__ = ("out", "breaks", "space", "indent", "marker", "fresh")

    def __init__(self):
        self.out: list[str] = []
        self.breaks, self.space, self.indent, self.marker, self.fresh = 0, False, 0, "", True

    def part(self, n: int) -> None:
        """At least ``n`` line ends before what comes next."""
        self.space = False
        if self.out:
            self.breaks = max(self.breaks, n)
        self.fresh = True

    def _open(self) -> None:
        if self.breaks:
            self.out.append("\n" * self.breaks)
            self.breaks = 0
        if self.fresh:
            lead = " " * max(0, self.indent - len(self.marker)) + self.marker
            if lead:
                self.out.append(lead)
            self.marker, self.fresh = "", False

    def words(self, text: str) -> None:
        shown = SPACES.sub(" ", text)
        if shown == " " or not shown:
            self.space = self.space or bool(shown) and not self.fresh
            return
        if self.fresh:
            shown = shown.lstrip(" ")
        elif self.space and shown[0] != " ":
            self.out.append(" ")
        self._open()
        self.space = shown[-1] == " "
        self.out.append(shown[:-1] if self.space else shown)

    def kept(self, text: str) -> None:
        """Preformatted text."""
        for k, line in enumerate(text.split("\n")):
            if k:
                self.breaks, self.fresh = self.breaks + bool(self.out), True
            if line:
                if self.space and not self.fresh:
                    self.out.append(" ")
                self._open()
                self.space = False
                self.out.append(line)

    def line_end(self) -> None:
        if self.out:
            self.breaks, self.fresh, self.space = self.breaks + 1 if self.fresh else 1, True, False

    def text(self) -> str:
        return "".join(self.out)


def _count(value: str | None) -> int:
    return max(1, min(1000, int(value))) if value and value.strip().isdigit() else 1


def _table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table from rows of (lines, columns, rows) cells."""
    placed: list[list[tuple[int, int, list[str]]]] = []
    taken: dict[int, int] = {}  # column -> rows for which a cell from above still covers it
    for row in rows:
        at, line = 0, []
        covered = {c for c, n in taken.items() if n > 0}
        fresh: dict[int, int] = {}
        for lines, wide, deep in row:
            while at in covered:
                at += 1
            line.append((at, wide, lines))
            if deep > 1:
                fresh.update({c: deep - 1 for c in range(at, at + wide)})
            at += wide
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | fresh
        placed.append(line)
    widths: dict[int, int] = {}
    for line in placed:
        for at, wide, lines in line:
            if wide == 1:
                widths[at] = max(widths.get(at, 0), min(ALIGN, max(map(len, lines), default=0)))
    starts, x = {}, 0
    for c in range(max((at + wide for line in placed for at, wide, _ in line), default=0)):
        starts[c] = x
        x += widths[c] + 2 if widths.get(c) else 0
    out = []
    for line in placed:
        for k in range(max((len(lines) for _, _, lines in line), default=0)):
            shown, size = [], 0
            for at, _, lines in line:
                if k < len(lines) and lines[k]:
                    gap = max(starts[at] - size, 2 if size else 0)
                    shown += [" " * gap, lines[k]]
                    size += gap + len(lines[k])
            if shown:
                out.append("".join(shown).rstrip())
    return out


def render(page: str) -> str:
    """All visible text of a page."""
    tree = Tree(page)
    rules = sheet(tree.styles) if tree.styles else {}
    lines = Lines()
    flows: list[Lines] = [lines]
    tables: list[list[list[tuple[list[str], int, int]]]] = []
    lists: list[tuple[str, list[int]]] = []
    # (node, leaving, visible, preformatted)
    todo: list[tuple] = [(tree.root, False, True, False)]
    while todo:
        node, leaving, visible, pre = todo.pop()
        if isinstance(node, str):
            if visible:
                lines.kept(node) if pre else lines.words(node)
            continue
        tag = node.tag
        if leaving:
            if tag in ("td", "th") and tables and len(flows) > 1 and tables[-1] is not None:
                cell = lines.text()
                flows.pop()
                lines = flows[-1]
                a = attributes(node.attrs) if "span" in node.attrs.lower() else {}
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((cell.split("\n") if cell else [], _count(a.get("colspan")), _count(a.get("rowspan"))))
            elif tag == "table" and tables:
                for row in _table([r for r in tables.pop() if r]):
                    lines.part(1)
                    lines.kept(row)
                lines.part(2)
            elif tag in LISTS:
                lists.pop()
                lines.part(1 if lists else 2)
            elif tag == "li":
                lines.indent -= 2 if not lists or lists[-1][0] != "ol" else 3
                lines.marker = ""
                lines.part(1)
            elif tag in ("dd", "blockquote"):
                lines.indent -= 2
                lines.part(2 if tag == "blockquote" else 1)
            elif tag == "q":
                if visible:
                    lines.words('"')
            elif tag in BLOCK:
                lines.part(2 if tag in PARTED else 1)
            continue
        if tag in NEVER:
            continue
        if tag == "br":
            lines.line_end()
            continue
        raw = node.attrs
        shown_children = node.children
        if raw or rules:
            low = raw.lower()
            if rules or "hidden" in low or "style" in low or tag in ("input", "details", "dialog"):
                a = attributes(raw)
                style = a.get("style", "")
                if ("hidden" in a and a["hidden"].lower() != "until-found") or GONE.search(style):
                    continue
                if rules:
                    names = [tag, "#" + a.get("id", ""), f"{tag}#{a.get('id', '')}"]
                    for c in a.get("class", "").split():
                        names += ["." + c, f"{tag}.{c}"]
                    said = [rules[x] for x in names if x in rules]
                    if any(said):
                        continue
                    visible = visible and not said
                if style:
                    visible = bool(SEEN.search(style)) or visible and not UNSEEN.search(style)
                if tag == "input" and visible and a.get("type", "").lower() in ("submit", "button", "reset") and a.get("value"):
                    lines.words(a["value"])
        if tag in ("details", "dialog") and "open" not in attributes(raw):
            if tag == "dialog":
                continue
            shown_children = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
        if tag in VOID:
            if tag == "hr":
                lines.part(2)
            continue
        if tag in ("td", "th") and tables:
            lines = Lines()
            flows.append(lines)
        elif tag == "table":
            lines.part(2)
            tables.append([])
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in LISTS:
            lines.part(1 if lists else 2)
            first = attributes(raw).get("start", "1") if tag == "ol" and raw else "1"
            lists.append((tag, [int(first) if first.lstrip("-").isdigit() else 1]))
        elif tag == "li":
            lines.part(1)
            ordered = bool(lists) and lists[-1][0] == "ol"
            lines.indent += 3 if ordered else 2
            lines.marker = f"{lists[-1][1][0]}. " if ordered else "- "
            if ordered:
                lists[-1][1][0] += 1
        elif tag in ("dd", "blockquote"):
            lines.part(2 if tag == "blockquote" else 1)
            lines.indent += 2
        elif tag == "q":
            if visible:
                lines.words('"')
        elif tag in BLOCK:
            lines.part(2 if tag in PARTED else 1)
        pre = pre or tag in ("pre", "textarea", "xmp", "listing", "plaintext")
        todo.append((node, True, visible, pre))
        todo += [(c, False, visible, pre) for c in reversed(shown_children)]
    return lines.text()


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_lines) of every row of ``pages``; no shuffle."""

    def make():
        def kernel(part: pa.RecordBatch) -> list:
            texts = [render(p) if p is not None else None for p in part.column(1).to_pylist()]
            counts = [t.count("\n") + 1 if t else 0 for t in texts]
            return [part.column(0).cast(pa.int64()), pa.array(texts, pa.string()), pa.array(counts, pa.int32())]

        return kernel

    return map_rows(pages, ["page_id", "html"], SCHEMA, make, text="html")
