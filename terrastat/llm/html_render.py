"""Visible text of HTML pages by a layout-aware rendering.

A small tree builder supplies the end tags that HTML implies, visibility rules drop what a browser
would not show, and a renderer lays out the rest: blocks on lines of their own with blank lines for
margins, list items with marks and indentation, table cells padded to aligned columns.

Work is linear in a page: where a tag can't end is remembered, open elements are found by name, and
elements nested deeper than ``MAX_DEPTH`` keep their visibility but share the layout of that level.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .page_styles import computed, rules_of

MAX_DEPTH = 200  # levels with a layout of their own
MAX_COLUMNS = 10_000  # columns of a table that spans may reach
# attributes as in the states of HTML's tokeniser: a quote opens a string only directly after "=" and white space
_W = r"[ \t\n\r\f]"
_VALUE = rf"""{_W}*+=(?:{_W}*+)(?:"{{0}}[^"]*+{{1}}"|'{{0}}[^']*+{{1}}'|{{0}}[^ \t\n\r\f>"'][^ \t\n\r\f>]*+{{1}}|(?=>|\Z))"""
_NAME = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+"
_PART = rf"""(?:[ \t\n\r\f/]++|{_NAME}(?:{_VALUE.format("", "")}|(?!{_W}*+=)))"""
_STEP, _ALL = re.compile(_PART), re.compile(rf"{_PART}*+>")
_TAG = re.compile(r"<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)")
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/][^>]*+(?:>|\Z)", re.S)  # the second form: bogus ones
_ATTR = re.compile(rf"({_NAME})(?:{_VALUE.format('(', ')')})?+")
_SCRIPT = re.compile(r"<!--|-->|</?script(?=[ \t\n\r\f/>])", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template noscript noembed noframes iframe audio video canvas datalist title meta link param source".split())
#: what is not drawn inside SVG and MathML
FOREIGN = {"svg": frozenset("defs title desc metadata style script".split()), "math": frozenset("annotation annotation-xml".split())}
#: elements of SVG and MathML whose content is HTML again; HTML elements that end SVG and MathML; texts placed apart
HTML_AGAIN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
APART = frozenset("text foreignobject mtd".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
BLOCK = MARGIN | frozenset("html body div section article aside header footer nav main address form li dt dd tr caption thead tbody tfoot td th details summary figcaption legend hgroup center dir menu option optgroup dialog search listing plaintext".split())
#: a start tag closes these open elements, looking no further out than the given ones
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    **{x: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for x in ("thead", "tbody", "tfoot")},
}
CLOSES_P = (BLOCK - frozenset("html body option optgroup td th tr thead tbody tfoot caption".split())) | {"table"}
#: white space by the property's value
WHITE = {"pre": True, "pre-wrap": True, "break-spaces": True, "pre-line": "line", "normal": False, "nowrap": False, "initial": False}
SCOPE = frozenset("table td th caption html template object".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "within", "inner", "state", "flat", "fold", "white")

    def __init__(self, tag: str, attrs: str = "", within: str = "", state: bool | None = True):
        self.tag, self.attrs, self.kids, self.within = tag, attrs, [], within  # within: svg or math for their elements
        self.state = state  # None where the element is not displayed, else whether its own text is visible
        self.inner, self.flat, self.fold = "", False, None
        self.white = None  # white space where a style sets it: True kept, "line" lines kept, False collapsed

    def get(self, name: str) -> str | None:
        """An attribute's value, empty for one without; the first of the name counts."""
        if name not in self.attrs.lower():
            return None
        for k, a, b, c in _ATTR.findall(self.attrs):
            if k.lower() == name:
                return unescape(a or b or c)
        return None


def _self_closing(attrs: str) -> bool:
    """Whether a tag ends with a slash that is not of an unquoted value."""
    return attrs.endswith("/") and max((m.end() for m in _ATTR.finditer(attrs)), default=0) < len(attrs)


class _Ends:
    """Ends of tags.  Once a tag turns out never to end, the places it passed are remembered, so that each is tried once."""

    def __init__(self, html: str):
        self.html, self.last, self.dead = html, html.rfind(">"), None

    def find(self, at: int) -> int:
        """The place of the > that ends the attributes which begin at ``at``; -1 if there is none."""
        if at > self.last:
            return -1
        if self.dead is None:
            m = _ALL.match(self.html, at)
            if m:
                return m.end() - 1
            self.dead = set()
        passed = []
        while at not in self.dead:
            passed.append(at)
            m = _STEP.match(self.html, at)
            if m is None:
                if self.html.startswith(">", at):
                    return at
                break
            at = m.end()
        self.dead.update(passed)
        return -1


class _Tree:
    """The open elements, from the root inwards, and where each name stands among them."""

    def __init__(self, rules: list):
        self.root, self.rules = Node("#root"), rules
        self.open, self.where = [self.root], {}

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these names; 0 if none is open."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def close(self, upto: int) -> None:
        while len(self.open) > upto:
            node = self.open.pop()
            self.where[node.tag].pop()
            if node.flat:
                self._edge(node)

    def _edge(self, node: Node) -> None:
        """What is left of the layout of an element below MAX_DEPTH: its break or its gap."""
        if node.state is not None and (node.tag in BLOCK or (node.within and node.tag in APART)):
            node.kids.append(Node("div") if node.tag in BLOCK else " ")

    def text(self, text: str) -> None:
        at = self.open[-1]
        if not at.flat:
            at.kids.append(text)
        elif at.state:
            shown = Node("span")
            shown.kids.append(text)
            at.kids.append(shown)

    def add(self, node: Node, stays: bool) -> None:
        """A new element in the innermost one; it stays open unless it can hold nothing."""
        top = self.open[-1]
        outer = top.fold if node.tag == "summary" and top.fold is not None else top.state
        said = computed(node, self.open[1:], self.rules) if outer is not None and (self.rules or "style" in node.attrs.lower()) else {}
        node.state = None if outer is None else _shown(node, outer, said)
        node.white = WHITE.get(said.get("white-space"))
        node.inner = node.tag if node.tag in FOREIGN else "" if node.within and node.tag in HTML_AGAIN else top.inner
        if not stays:
            top.kids.append(node)
            return
        if len(self.open) < MAX_DEPTH:
            top.kids.append(node)
        else:
            node.flat, node.kids = True, top.kids
            self._edge(node)
            if node.tag == "details" and node.get("open") is None:
                node.fold, node.state = node.state, None
        self.where.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def imply_ends(self, tag: str) -> None:
        """Close what a start tag closes."""
        if tag in IMPLIED:
            shut, stop = IMPLIED[tag]
            fence = self.last(*stop)
            if tag in ("li", "td", "th", "option"):
                at = self.last(*shut)
            else:  # the outermost one inside the fence
                inside = [w[bisect_right(w, fence)] for t in shut if (w := self.where.get(t)) and w[-1] > fence]
                at = min(inside, default=0)
            if at > fence:
                self.close(at)
        if tag in CLOSES_P and self.last("p") > self.last("button", *SCOPE):
            self.close(self.last("p"))
        if tag == "body" and self.last("head"):
            self.close(self.last("head"))

    def end(self, tag: str) -> None:
        at = self.last(tag)
        fence = 0 if tag in ("table", "template", "body", "html") else self.last("table", "template")
        if at > fence or (at and at == fence):
            self.close(at)
        elif not fence and tag in ("p", "br"):
            self.add(Node(tag), False)


def parse(html: str) -> Node:
    """The tree of a page; unknown and unmatched tags, and tags that never end, lose no text.  Where the page's style sheets
    say anything of display, visibility or white space it is built again under their rules."""
    root, sheets = _tree_of(html, [])
    rules = rules_of(sheets)
    return _tree_of(html, rules)[0] if rules else root


def _tree_of(html: str, rules: list) -> tuple[Node, list[str]]:
    """(tree, style sheets for screens)."""
    tree, ends, sheets = _Tree(rules), _Ends(html), []
    at, n = 0, len(html)
    while at < n:
        if html[at] != "<":
            stop = html.find("<", at)
            stop = n if stop < 0 else stop
            text = html[at:stop]
            tree.text(unescape(text) if "&" in text else text)
            at = stop
            continue
        m = _TAG.match(html, at)
        if m is None:
            if tree.open[-1].inner and html.startswith("<![CDATA[", at):
                stop = html.find("]]>", at)
                tree.text(html[at + 9 : stop if stop >= 0 else n])
                at = stop + 3 if stop >= 0 else n
                continue
            m = _COMMENT.match(html, at)
            if m is None or m[0] == "</":
                tree.text(html[at : at + 1])
                at += 1
            else:
                at = m.end()
            continue
        begin, tag = m.end(), m[2].lower()
        end = ends.find(begin)
        if end < 0:  # a tag that never ends is text, and so are those that begin inside its name
            if begin > ends.last and (begin := min((x for x in (html.find("<!", at), html.find("<?", at)) if x >= 0), default=n)) == n:
                tree.text(unescape(html[at:]))
                break
            tree.text(html[at:begin])
            at = begin
            continue
        at, attrs = end + 1, html[begin:end]
        if m[1]:
            tree.end(tag)
            continue
        within = tree.open[-1].inner
        if within and tag in BREAKOUT:
            while tree.open[-1].inner:
                tree.close(len(tree.open) - 1)
            within = ""
        tree.imply_ends(tag)
        node = Node(tag, attrs, within or (tag if tag in FOREIGN else ""))
        if node.within and _self_closing(attrs):
            tree.add(node, False)
        elif tag == "plaintext":
            tree.add(node, False)
            node.kids.append(html[at:])
            break
        elif tag in RAW:
            tree.add(node, False)
            stop = _script_end(html, at) if tag == "script" else m.start() if (m := _raw_end(tag).search(html, at)) else n
            text = html[at:stop]
            if tag == "textarea":
                text = text.removeprefix("\n")
            elif tag == "style" and (node.get("media") or "all").strip().lower() in ("all", "screen") and (node.get("type") or "text/css").strip().lower() == "text/css":
                sheets.append(text)
            node.kids.append(unescape(text) if tag in ("textarea", "title") else text)
            at = html.find(">", stop) + 1 or n if stop < n else n
        else:
            tree.add(node, tag not in VOID and not (attrs.endswith("/") and tag in ("path", "rect", "circle", "use")))
            if tag in ("pre", "listing") and html.startswith("\n", at):
                at += 1
    return tree.root, sheets


def _script_end(html: str, at: int) -> int:
    """Where a script's end tag begins.  After ``<!--`` a script tag inside the comment has an end tag of its own."""
    escaped = doubly = False
    for m in _SCRIPT.finditer(html, at):
        found = m[0].lower()
        if found == "<!--":
            escaped = escaped or not re.compile("-?>").match(html, m.end())
        elif found == "-->":
            escaped = doubly = False
        elif found == "<script":
            doubly = doubly or escaped
        elif doubly:
            doubly = False
        else:
            return m.start()
    return len(html)


def _raw_end(tag: str):
    return re.compile(rf"</{tag}(?=[ \t\n\r\f/>])", re.I)


def _shown(node: Node, visible: bool, said: dict[str, str]) -> bool | None:
    """None where the element is not displayed at all, else whether its own text is visible; ``said`` is what styles say."""
    if node.tag in UNSEEN or (node.within and node.tag in FOREIGN[node.within]) or said.get("display") == "none":
        return None
    if node.tag == "dialog" and node.get("open") is None:
        return None
    low = node.attrs.lower()
    if "hidden" in low and ((node.get("hidden") is not None and "display" not in said) or (node.tag == "input" and node.get("type") == "hidden")):
        return None  # a style that displays it outdoes the attribute
    sight = said.get("visibility")
    if node.within == "svg":
        if "display" not in said and "display" in low and (node.get("display") or "").strip().lower() == "none":
            return None
        if sight is None and "visibility" in low:
            sight = (node.get("visibility") or "").strip().lower()
    return {"hidden": False, "collapse": False, "visible": True}.get(sight, visible)


class Page:
    """Lines under layout: text flows into the last line, blocks break it, margins leave one blank line."""

    def __init__(self):
        self.lines, self.words, self.gap, self.fresh = [], [], 0, True

    def text(self, s: str) -> None:
        self.words.append(s)

    def flush(self) -> None:
        if self.words:
            line = _SPACES.sub(" ", "".join(self.words)).strip(" ")
            self.words = []
            if line:
                self._emit(line)

    def _emit(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        self.lines.append(line)

    def edge(self, margin: bool) -> None:
        self.flush()
        self.gap |= margin

    def line_break(self) -> None:
        line = _SPACES.sub(" ", "".join(self.words)).strip(" ")
        self.words = []
        self._emit(line)

    def block(self, lines: list[str], margin: bool = False) -> None:
        self.edge(margin)
        for line in lines:
            self._emit(line)
        self.gap |= margin


def _lines(node: Node, visible: bool, pre: bool, level: int) -> list[str]:
    page = Page()
    _walk(node, page, visible, pre, level)
    page.flush()
    while page.lines and not page.lines[-1]:
        page.lines.pop()
    return page.lines


def _walk(node: Node, page: Page, visible: bool, pre: bool, level: int) -> None:
    for kid in node.kids:
        if isinstance(kid, str):
            if visible:
                if pre == "line":
                    first, *more = kid.split("\n")
                    page.text(first)
                    for x in more:
                        page.line_break()
                        page.text(x)
                elif pre:  # kept as it is: no-break spaces survive the flow and become spaces at the end
                    first, *more = kid.replace("\t", "    ").replace(" ", "\xa0").split("\n")
                    page.text(first)
                    for x in more:
                        page.line_break()
                        page.text(x)
                else:
                    page.text(kid)
            continue
        tag = kid.tag
        shown, kept = kid.state, _kept(kid, pre)
        if shown is None:
            continue
        if tag == "br":
            page.line_break()
        elif tag == "hr":
            page.edge(True)
        elif tag in ("ul", "ol", "menu", "dir"):
            page.block(_list(kid, shown, kept, level), level == 0)
        elif tag == "table":
            page.block(_table(kid, shown, kept, level), True)
        elif tag in ("dd", "blockquote"):
            page.block([f"  {x}" if x else x for x in _lines(kid, shown, kept, level)], tag == "blockquote")
        elif tag == "details" and kid.get("open") is None:
            summary = Node("div")
            summary.kids = [x for x in kid.kids if isinstance(x, Node) and x.tag == "summary"][:1]
            page.block(_lines(summary, shown, kept, level))
        elif kid.within and tag in APART:
            page.text(" ")
            _walk(kid, page, shown, kept, level)
            page.text(" ")
        elif tag in BLOCK:
            page.edge(tag in MARGIN)
            _walk(kid, page, shown, kept, level)
            page.edge(tag in MARGIN)
        else:
            _walk(kid, page, shown, kept, level)


def _kept(node: Node, outer: bool | str) -> bool | str:
    """White space in an element: as its style says, else kept by some tags, else as around it."""
    if node.white is not None:
        return node.white
    return node.tag in ("pre", "textarea", "xmp", "listing", "plaintext") or outer


def _mark(kind: str | None, n: int) -> str:
    """An ordered item's number in its type: 1, a, A, i or I."""
    if kind in ("a", "A") and n > 0:
        text = ""
        while n:
            n, letter = divmod(n - 1, 26)
            text = chr(97 + letter) + text
        return text.upper() if kind == "A" else text
    if kind in ("i", "I") and 0 < n < 4000:
        text = ""
        for value, digits in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), ("m", "cm", "d", "cd", "c", "xc", "l", "xl", "x", "ix", "v", "iv", "i"), strict=True):
            times, n = divmod(n, value)
            text += digits * times
        return text.upper() if kind == "I" else text
    return str(n)


def _whole(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"\s*[-+]?\d{1,9}\s*", text) else None


def _list(node: Node, visible: bool, pre: bool, level: int) -> list[str]:
    """Lines of a list.  Ordered items count from ``start`` (``reversed``: down to 1), ``value`` sets the count."""
    ordered, step = node.tag == "ol", 1
    n, out = (_whole(node.get("start")) if ordered else None), []
    if ordered and node.get("reversed") is not None:
        step, n = -1, n if n is not None else sum(isinstance(k, Node) and k.tag == "li" and k.state is not None for k in node.kids)
    n = 1 if n is None else n
    loose = Node("div")
    for kid in [*node.kids, None]:
        if isinstance(kid, Node) and kid.tag == "li":
            out += [f"  {x}" for x in _lines(loose, visible, pre, level + 1)]
            loose = Node("div")
            if kid.state is None:
                continue
            value = _whole(kid.get("value")) if ordered else None
            n = n if value is None else value
            mark = f"{_mark(kid.get('type') or node.get('type'), n)}. " if ordered else "* "
            n += step
            lines = _lines(kid, kid.state, _kept(kid, pre), level + 1)
            if lines:
                out += [mark + lines[0], *[" " * len(mark) + x if x else x for x in lines[1:]]]
        elif kid is not None:
            loose.kids.append(kid)
    return out + [f"  {x}" for x in _lines(loose, visible, pre, level + 1)]


def _rows(node: Node, visible: bool):
    """(row element, visible, whether the table has it as a row), those of nested tables left out; what stands
    between rows comes as a row of its own."""
    for kid in node.kids:
        if isinstance(kid, str):
            if kid.strip():
                stray = Node("tr")
                stray.kids = [Node("td", state=visible)]
                stray.kids[0].kids = [kid]
                yield stray, visible, False
            continue
        shown = kid.state
        if shown is None:
            continue
        if kid.tag in ("thead", "tbody", "tfoot"):
            yield from _rows(kid, shown)
        elif kid.tag == "tr":
            yield kid, shown, True
        elif kid.tag not in ("col", "colgroup"):
            row = Node("tr")
            row.kids = [kid]
            yield row, shown, False


def _table(node: Node, visible: bool, pre: bool, level: int) -> list[str]:
    """Lines of a table: each cell begins at its column, what earlier rows' cells span is left free."""
    rows, until, number = [], {}, 0  # until: the row before which a column is free again
    for row, shown, real in _rows(node, visible):
        cells, at = [], 0  # (column, columns, lines)
        for cell in row.kids:
            if isinstance(cell, str):
                if not (cell.strip() and shown):
                    continue
                lines, wide, high = [_SPACES.sub(" ", cell).strip(" ")], 1, 1
            elif cell.state is None:
                continue
            elif cell.tag in ("td", "th", "caption"):
                lines = _lines(cell, cell.state, _kept(cell, pre), level)
                wide, high = _whole(cell.get("colspan")) or 1, _whole(cell.get("rowspan"))
                high = 1 if high is None else high or 1 << 16
            else:
                box = Node("div")
                box.kids = [cell]
                lines, wide, high = _lines(box, shown, pre, level), 1, 1
            while until.get(at, 0) > number:
                at += 1
            wide = max(1, min(wide, MAX_COLUMNS - at))
            if high > 1 and real and at < MAX_COLUMNS:
                until.update(dict.fromkeys(range(at, at + wide), number + high))
            cells.append((at, wide, lines))
            at += wide
        number += real
        if any(lines for _, _, lines in cells):
            rows.append(cells)
    width: dict[int, int] = {}
    for cells in rows:
        if len(cells) > 1 or cells[0][0]:  # a lone cell does not widen the columns below it
            for at, wide, lines in cells:
                if wide == 1:  # nor what spans columns its first
                    width[at] = max([width.get(at, 0), *map(len, lines)])
    begin, place = {}, 0
    for at in range(max((cells[-1][0] for cells in rows), default=-1) + 1):
        begin[at] = place
        place += width[at] + 2 if width.get(at) else 0
    out = []
    for cells in rows:
        for i in range(max(len(lines) for _, _, lines in cells)):
            line = ""
            for at, _, lines in cells:
                if i < len(lines) and lines[i]:
                    line = (line + "  " if line else "").ljust(begin[at]) + lines[i]
            out.append(line.rstrip(" "))
    return out


def visible_text(html: str | None) -> str:
    """The rendered text; empty for null, empty or invisible pages."""
    if not html:
        return ""
    return "\n".join(_lines(parse(html.replace("\r\n", "\n").replace("\r", "\n")), True, False, 0)).replace("\xa0", " ")


def extract_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, n_chars, text``.

    Null and empty pages give an empty text; rows that repeat give one row each; null ids stay null.
    Nesting beyond ``MAX_DEPTH`` is flattened: it loses its layout, neither text nor visibility.  Other columns are ignored,
    whatever their names; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [visible_text(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(texts, pa.string())], ["page_id", "n_chars", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {kind}, n_chars long, text string")
