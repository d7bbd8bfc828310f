"""HTML extraction: a small tree builder and a layout-aware renderer.

The builder supplies implied tags (a paragraph ends where a block starts, an item where the next one starts, and so
on) and skips what no end tag matches. The renderer drops what is not shown (by attributes, inline styles, and rules of the page's
own style elements for tags, classes and ids, alone, together, and below others) and emits all visible text: blocks on lines of their own, paragraphs apart
by an empty line, list items with their marks, table cells aligned in columns. Texts of drawings and formulas and what input
fields and buttons show (value, else placeholder) are text of the line.

Pages of any depth are built and rendered without recursion, and time is linear in a page's length also where its markup is
broken; rules with several compounds cost each element a look at those begun around it. Layout has bounds that lose no text: lines are indented by at most `MAX_INDENT`, columns padded to at most
`MAX_COLUMN` and to no more than `MAX_OFFSET` from the left, and tables inside `MAX_TABLES` others are laid out as blocks.

Defined results: null pages give null, empty ones an empty text; unclosed tags and comments run to the end; style rules with
attributes, pseudo-classes or sibling combinators, and inside at-rules other than `@media` for screens, are not applied; repeated rows give equal texts; other columns pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_INDENT, MAX_COLUMN, MAX_OFFSET, MAX_TABLES = 80, 120, 1000, 16
# Element names by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style template noscript head title iframe object canvas audio video datalist noembed noframes annotation annotation-xml".split())
#: Parts of a drawing that are not drawn themselves, and parts of formulas that stand apart.
UNDRAWN = frozenset("defs symbol clippath mask pattern marker desc metadata".split())
FORMULA = frozenset("mfrac msub msup msubsup munder mover munderover mroot mmultiscripts mtr mtd".split())
#: Inputs that show no text.
UNWRITTEN = frozenset("hidden checkbox radio password file range color".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul tr td th thead tbody tfoot caption optgroup option".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure hr article section nav header footer aside form fieldset details".split())
PARAGRAPH_ENDERS = BLOCK - frozenset("option optgroup td th tr thead tbody tfoot caption li dd dt body html legend summary".split())
TABLE_PARTS = frozenset("table tr td th thead tbody tfoot body html".split())
#: Start tag -> (open elements that it ends, elements that shield from it).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
NAME = re.compile(r"[A-Za-z][^\s/>]*")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SHOWING = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([a-z-]+)(?:\s*(!\s*important))?", re.IGNORECASE)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
BRACE = re.compile(r"[{};]")
SIMPLE = re.compile(r"[.#]?[a-zA-Z_-][\w-]*")
COMPOUND = r"(?:[a-zA-Z][\w-]*)?(?:[.#][\w-]+)*(?<![\s>])"
SELECTOR = re.compile(rf"{COMPOUND}(?:(?:\s*>\s*|\s+){COMPOUND})*")
SELECTOR_PART = re.compile(r"\s*>\s*|\s+|[^\s>]+")
SCREEN = frozenset(("all", "screen", "only all", "only screen"))
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def get(self, name: str) -> str | None:
        if name not in self.attrs.lower():
            return None
        for m in ATTRIBUTE.finditer(self.attrs):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None


class Tree:
    """The open elements of a page, and where each kind of them stands open."""

    def __init__(self):
        self.root = Node("#root")
        self.stack, self.open = [self.root], defaultdict(list)
        self.sheets: list[str] = []

    def add(self, child: Node | str) -> None:
        self.stack[-1].children.append(child)

    def push(self, node: Node) -> None:
        self.add(node)
        self.open[node.tag].append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.open[self.stack.pop().tag].pop()

    def innermost(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def end(self, tags, shields) -> None:
        """End the open elements in `tags` that no shield stands before."""
        while (at := self.innermost(tags)) > self.innermost(shields):
            self.cut(at)

    def text(self, text: str) -> None:
        if self.stack[-1].tag == "head" and text.strip():
            self.cut(len(self.stack) - 1)
        self.add(unescape(text))

    def end_tag(self, tag: str) -> None:
        if tag == "br" or tag == "p" and not self.open.get("p"):
            self.add(Node(tag))
        elif (at := self.innermost((tag,))) > (0 if tag in TABLE_PARTS else self.innermost(("td", "th", "table"))) or at and tag in ("td", "th", "table"):
            self.cut(at)

    def start_tag(self, tag: str, attrs: str) -> None:
        if tag in PARAGRAPH_ENDERS:
            self.end(("p",), ("table", "td", "th", "button", "object", "caption"))
        if self.stack[-1].tag == "head" and tag not in HEAD or self.stack[-1].tag == "colgroup" and tag not in ("col", "template"):
            self.cut(len(self.stack) - 1)
        if tag in ENDS:
            self.end(*ENDS[tag])
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self.push(Node("tr"))
        if tag in VOID or tag in RAW or attrs.endswith("/") and tag not in BLOCK:
            self.add(Node(tag, attrs))
        else:
            self.push(Node(tag, attrs))


def tag_end(html: str, at: int, lost: set[int]) -> int:
    """Place of the > that ends a tag, quotes skipped; -1 where a quote never ends. `lost` remembers the quotes that lead there."""
    passed = []
    while (m := STOP.search(html, at)) and m.start() not in lost:
        if m[0] == ">":
            return m.start()
        passed.append(m.start())
        at = html.find(m[0], m.end()) + 1
        if not at:
            break
    lost.update(passed)
    return -1


def build(html: str) -> Tree:
    """Tree of a page; text children are strings with their references resolved."""
    tree, last, lost = Tree(), html.rfind(">"), set()
    at = begun = 0  # text since `begun` is not put yet
    while 0 <= (start := html.find("<", at)):
        if html.startswith(("<!", "<?"), start):
            mark = "-->" if html.startswith("<!--", start) else ">"
            end = html.find(mark, start + len(mark) + 1)
            stop = len(html) if end < 0 else end + len(mark)
            name = None
        else:
            closing = html.startswith("/", start + 1)
            name = NAME.match(html, start + 1 + closing) if start < last else None
            if not name:
                at = start + 1
                continue
            end = tag_end(html, name.end(), lost)
            end = html.find(">", name.end()) if end < 0 else end
            stop = end + 1
        if start > begun:
            tree.text(html[begun:start])
        at = begun = stop
        if not name:
            continue
        tag = name[0].lower()
        if closing:
            tree.end_tag(tag)
            continue
        tree.start_tag(tag, html[name.end() : end])
        if tag in RAW:
            found = re.compile(rf"</{tag}\b", re.IGNORECASE | re.ASCII).search(html, at)
            body = html[at : found.start()] if found else html[at:]
            node = tree.stack[-1].children[-1]
            node.children.append(unescape(body) if tag in ("textarea", "title") else body)
            at = begun = (found and html.find(">", found.end()) + 1) or len(html)
            if tag == "style" and (node.get("media") or "all").strip().lower() in ("all", "screen"):
                tree.sheets.append(body)
    if begun < len(html):
        tree.text(html[begun:])
    return tree


def style_rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a style sheet in order, also from inside `@media` for screens; other at-rules are left out."""
    css = COMMENT.sub(" ", css)
    open_at: list[tuple[str, int, bool]] = []  # head, where its body starts, whether what it holds counts
    start = 0
    for m in BRACE.finditer(css):
        if m[0] == "{":
            head, counts = css[start : m.start()].strip(), not open_at or open_at[-1][2]
            screen = head[:6].lower() == "@media" and any(" ".join(x.lower().split()) in SCREEN for x in head[6:].split(","))
            open_at.append((head, m.end(), counts and screen))
            start = m.end()
        elif m[0] == "}":
            if open_at:
                head, body, _ = open_at.pop()
                if (not open_at or open_at[-1][2]) and not head.startswith("@"):
                    yield head, css[body : m.start()]
            start = m.end()
        elif not open_at or open_at[-1][2]:
            start = m.end()


class Rule:
    """A place in the tree of selectors: what the selectors that end here decide, and the compounds that may follow below (inside) or right below (direct)."""

    __slots__ = ("direct", "inside", "wins")

    def __init__(self):
        self.wins: dict[str, tuple] = {}
        self.inside: dict[str, dict[frozenset, Rule]] = {}
        self.direct: dict[str, dict[frozenset, Rule]] = {}

    def follow(self, compound: frozenset, direct: bool) -> Rule:
        key = max(compound, key=lambda name: (name[0] == "#", name[0] == ".", name))  # an element looks this one up
        return (self.direct if direct else self.inside).setdefault(key, {}).setdefault(compound, Rule())


class Shown:
    """How an element stands: whether its text is visible (the truth value), and which selectors have been met on the way to it."""

    __slots__ = ("around", "here", "visible")

    def __init__(self, visible: bool, around: tuple[Rule, ...], here: tuple[Rule, ...]):
        self.visible, self.around, self.here = visible, around, here

    def __bool__(self) -> bool:
        return self.visible


class Styles:
    """What is shown: display and visibility by attributes, inline styles, and a page's rules for tags, .classes and #ids, alone, together, and below others.

    What a rule decides is settled when the sheet is read, once for all its selectors. An element then looks up its own names, in the
    selectors that have been begun around it.
    """

    INLINE = (1 << 30, 0, 0)

    def __init__(self, sheets: list[str]):
        self.root, self.any = Rule(), False
        for order, (head, body) in enumerate(x for css in sheets for x in style_rules(css)):
            decided = self.settled(body)
            for selector in map(str.strip, head.split(",") if decided else ()):
                if SELECTOR.fullmatch(selector):
                    self.add(selector, order, decided)

    @staticmethod
    def settled(body: str) -> dict[str, tuple]:
        """Property -> (important, place, value) that wins inside one block of declarations."""
        found: dict[str, tuple] = {}
        for at, m in enumerate(SHOWING.finditer(body)):
            new = (m[3] is not None, at, m[2].lower())
            found[m[1].lower()] = max(new, found.get(m[1].lower(), new))
        return found

    def add(self, selector: str, order: int, decided: dict[str, tuple]) -> None:
        rule, direct, counts = self.root, False, [0, 0, 0]
        for part in SELECTOR_PART.findall(selector):
            if part.strip() in ("", ">"):
                direct = ">" in part
                continue
            names = frozenset(n if n[0] in ".#" else n.lower() for n in SIMPLE.findall(part))
            for n in names:
                counts[{"#": 0, ".": 1}.get(n[0], 2)] += 1
            rule = rule.follow(names, direct)
        for name, (important, at, value) in decided.items():
            new = (important, tuple(counts), order, at, value)
            rule.wins[name] = max(new, rule.wins.get(name, new))
        self.any = True

    def met(self, node: Node, above: Shown) -> list[Rule]:
        """Places in the tree of selectors that the element reaches."""
        names = {node.tag}
        if node.attrs:
            names.update(f".{c}" for c in (node.get("class") or "").split())
            names.add(f"#{node.get('id')}")
        found = []
        for rules, following in ((above.around, "inside"), (above.here, "direct")):
            for rule in rules:
                held = getattr(rule, following)
                for name in names & held.keys() if held else ():
                    found += [r for compound, r in held[name].items() if len(compound) == 1 or compound <= names]
        return found

    def seen(self, node: Node, above: Shown) -> Shown | None:
        """None if the node has no box; else how it stands."""
        if node.tag in UNSEEN:
            return None
        if not node.attrs and not self.any:
            return above if node.tag != "dialog" else None
        reached = self.met(node, above) if self.any else []
        found: dict[str, tuple] = {}
        if node.attrs and (style := node.get("style")):
            found = {name: (important, self.INLINE, 0, at, value) for name, (important, at, value) in self.settled(style).items()}
        for rule in reached:
            for name, new in rule.wins.items():
                found[name] = max(new, found.get(name, new))
        display = found["display"][-1] if "display" in found else None
        if display == "none" or display is None and (node.attrs and (node.get("hidden") is not None or node.get("popover") is not None) or node.tag == "dialog" and node.get("open") is None):
            return None
        visible = {"hidden": False, "collapse": False, "visible": True}.get(found["visibility"][-1] if "visibility" in found else None, above.visible)
        fresh = tuple(dict.fromkeys(r for r in reached if r.inside and r not in above.around))
        return Shown(visible, above.around + fresh if fresh else above.around, tuple(r for r in reached if r.direct))


class Page:
    """Collects lines; an empty line is put before a block only between texts."""

    def __init__(self, styles: Styles, tables: int = 0):
        self.styles, self.tables = styles, tables
        self.lines: list[str] = []
        self.line: list[str] = []
        self.mark, self.gap = "", False

    def text(self, body: str, indent: str, pre: bool) -> None:
        if pre:
            first, *rest = body.split("\n")
            self.line.append(first)
            for x in rest:
                self.end(indent, keep=True)
                self.line.append(x)
            return
        body = SPACE.sub(" ", body)
        if not self.line or self.line[-1][-1:] in ("", " "):
            body = body.lstrip(" ")
        if body:
            self.line.append(body)

    def end(self, indent: str, keep: bool = False) -> None:
        line = "".join(self.line) if keep else "".join(self.line).rstrip(" ")
        self.line = []
        if line or keep:
            if self.gap and self.lines:
                self.lines.append("")
            head = indent[: max(0, len(indent) - len(self.mark))] + self.mark
            self.lines.append((head + line).rstrip())
            self.mark, self.gap = "", False

    def done(self) -> str:
        self.end("")
        return "\n".join(self.lines).strip("\n")


def _number(text: str | None, default: int, most: int = 10**9) -> int:
    return min(most, int(text)) if text and text.isascii() and text.isdecimal() and len(text) < 12 else default


def run(task: Iterator) -> None:
    """Run a task whose steps are tasks themselves, to any depth without recursion."""
    stack = [task]
    while stack:
        try:
            stack.append(next(stack[-1]))
        except StopIteration:
            stack.pop()


def align(rows: list[tuple[Node, list[tuple[list[str], int, int]]]]) -> Iterator[str]:
    """Lines of a table's rows (group, cells (lines, columns, rows)), cells padded to the width of their columns."""
    placed, group, taken = [], None, []
    for number, (parent, cells) in enumerate(rows):
        if parent is not group:  # no cell reaches over the end of its group of rows
            group, taken = parent, []
        row, fresh, at, k = [], [], 0, 0
        taken = [t for t in taken if t[2] >= number] if cells else taken
        for lines, span, down in cells:
            while k < len(taken) and taken[k][0] < at + span:
                at, k = max(at, taken[k][1]), k + 1
            row.append((at, span, lines))
            if down > 1:
                fresh.append((at, at + span, number + down - 1))
            at += span
        taken = sorted(taken + fresh) if fresh else taken
        placed.append(row)
    order = sorted({at for row in placed for at, _, _ in row})
    index, widths = {at: i for i, at in enumerate(order)}, [0] * len(order)
    for row in placed:
        for at, span, lines in row:
            if bisect_left(order, at + span) == index[at] + 1:
                widths[index[at]] = max(widths[index[at]], *(min(len(x), MAX_COLUMN) for x in lines))
    offsets = [min(x, MAX_OFFSET) for x in accumulate((w + 2 for w in widths), initial=0)]
    for row in placed:
        out = [[0] for _ in range(max((len(lines) for _, _, lines in row), default=0))]  # length so far, then pieces
        for at, _, lines in row:
            for line, piece in zip(out, lines):
                if piece:
                    pad = max(offsets[index[at]] - line[0], 2 if line[0] else 0)
                    line[0] += pad + len(piece)
                    line += [" " * pad, piece]
        yield from ("".join(line[1:]) for line in out)


def table(node: Node, page: Page, indent: str, seen: Shown) -> Iterator:
    """A table's rows, below its captions and texts outside of cells."""
    rows, captions = [], Page(page.styles, page.tables + 1)
    todo = [(x, node, seen) for x in reversed(node.children)]
    while todo:
        x, parent, shown = todo.pop()
        if isinstance(x, str):
            if shown and x.strip():
                captions.text(x.strip(), "", False)
                captions.end("")
            continue
        if (shown := page.styles.seen(x, shown)) is None:
            continue
        if x.tag in ("thead", "tbody", "tfoot", "colgroup"):
            todo += [(c, x, shown) for c in reversed(x.children)]
        elif x.tag == "tr":
            cells = []
            for c in x.children:
                if isinstance(c, str):
                    todo += [(c, x, shown)] * bool(c.strip())
                elif (here := page.styles.seen(c, shown)) is not None:
                    cell = Page(page.styles, page.tables + 1)
                    yield flow(c, cell, "", False, here)
                    cells.append((cell.done().split("\n"), _number(c.get("colspan"), 1, 1000) or 1, _number(c.get("rowspan"), 1, 65534) or 65534))
            rows.append((parent, cells))
        else:
            yield flow(x, captions, "", False, shown)
            captions.end("")
    body = captions.done()
    for line in [*(body.split("\n") if body else []), *align(rows)]:
        if seen or line:
            page.line = [line]
            page.end(indent, keep=True)


def draw(node: Node, page: Page, indent: str, seen: Shown) -> Iterator:
    """Texts of a drawing, apart from each other."""
    for x in node.children:
        if isinstance(x, str) or x.tag in UNDRAWN or (shown := page.styles.seen(x, seen)) is None:
            continue
        if x.tag in ("text", "foreignobject"):
            page.text(" ", indent, False)
            yield flow(x, page, indent, False, shown)
            page.text(" ", indent, False)
        else:
            yield draw(x, page, indent, shown)


def flow(node: Node, page: Page, indent: str, pre: bool, seen: Shown) -> Iterator:
    children, number, step = node.children, 0, 1
    if node.tag == "details" and node.get("open") is None:
        children = [x for x in children if not isinstance(x, str) and x.tag == "summary"][:1]
    elif node.tag == "ol":
        step = -1 if node.get("reversed") is not None else 1
        items = sum(not isinstance(x, str) and x.tag == "li" for x in children) if step < 0 else 1
        number = _number(node.get("start"), items) - step
    for x in children:
        if isinstance(x, str):
            if seen:
                page.text(x, indent, pre)
            continue
        if (shown := page.styles.seen(x, seen)) is None:
            continue
        tag = x.tag
        if tag == "br":
            page.end(indent, keep=bool(page.line) or pre)
        elif tag == "img":
            if shown:
                page.text(x.get("alt") or "", indent, pre)
        elif tag == "input":
            kind = (x.get("type") or "text").strip().lower()
            text = x.get("alt") if kind == "image" else x.get("value") or kind not in ("submit", "reset", "button") and x.get("placeholder")
            if shown and text and kind not in UNWRITTEN:
                page.text(f" {text} ", indent, False)
        elif tag == "svg":
            yield draw(x, page, indent, shown)
        elif tag not in BLOCK:
            if node.tag in FORMULA:
                page.text(" ", indent, False)
            yield flow(x, page, indent, pre, shown)
        else:
            page.end(indent)
            nested = tag in ("ul", "ol", "menu", "dir") and node.tag in ("li", "ul", "ol")
            page.gap |= tag in APART and not nested
            inner = indent
            if tag == "li":
                number = _number(x.get("value"), number + step)
                page.mark = f"{number}. " if node.tag == "ol" else "- "
                inner = indent + " " * len(page.mark)
            elif tag in ("dd", "blockquote"):
                inner = indent + "  "
            inner = inner if len(inner) <= MAX_INDENT else indent
            if tag == "table" and page.tables < MAX_TABLES:
                yield table(x, page, inner, shown)
            else:
                yield flow(x, page, inner, pre or tag == "pre", shown)
            page.end(inner)
            if tag == "li":
                page.mark = ""
            page.gap |= tag in APART and not nested


def html_text(html: str | None) -> str | None:
    """Visible text of a page."""
    if html is None:
        return None
    tree = build(html)
    page = Page(Styles(tree.sheets))
    run(flow(tree.root, page, "", False, Shown(True, (page.styles.root,), ())))
    return page.done()


@F.pandas_udf(T.StringType())
def _texts(pages: pd.Series) -> pd.Series:
    return pd.Series([html_text(p) for p in pages], dtype=object)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """`pages` with the visible text of column `html` in column `out`."""
    return pages.withColumn(out, _texts(F.col(f"`{html}`")))
