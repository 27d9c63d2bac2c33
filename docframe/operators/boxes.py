"""Trees to blocks: display, lists, tables, inline runs. Writers walk what blocks_of() gives."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

from docframe.operators.grid import occupy
from docframe.sources.html import Element

# Elements that are not shown, those that are blocks, and those that set a style
HIDDEN = frozenset("head title meta link style script template noscript base param datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
BOLD, ITALIC = frozenset("b strong h1 h2 h3 h4 h5 h6 th".split()), frozenset("i em cite var dfn address".split())
STRIKE, CODE = frozenset("s strike del".split()), frozenset("code kbd samp tt".split())
LISTS = frozenset("ul ol menu dir".split())
#: Walks over trees call themselves once a level, in Python alone; pages may nest deeper than its usual limit.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 200_000))
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


@dataclass
class Run:
    text: str
    bold: bool = False
    italic: bool = False
    strike: bool = False
    code: bool = False
    href: str = ""
    literal: bool = False

    @property
    def style(self) -> tuple:
        return self.bold, self.italic, self.strike, self.code, self.href


@dataclass
class Cell:
    row: int
    col: int
    rowspan: int
    colspan: int
    header: bool
    align: str
    blocks: list[list[Run]]


@dataclass
class Block:
    """kind: heading, paragraph, quote, pre, rule, table, list."""

    kind: str
    runs: list[Run] = field(default_factory=list)
    level: int = 0
    text: str = ""
    children: list["Block"] = field(default_factory=list)
    items: list["Item"] = field(default_factory=list)
    cells: list[Cell] = field(default_factory=list)
    header_rows: set[int] = field(default_factory=set)
    caption: list[Run] = field(default_factory=list)


@dataclass
class Item:
    marker: str
    ordered: bool
    runs: list[Run]
    lists: list[Block]
    checked: bool | None = None
    blocks: list[Block] = field(default_factory=list)


def style_of(e: Element) -> dict[str, str]:
    out = {}
    for d in e.attrs.get("style", "").split(";"):
        k, _, v = d.partition(":")
        out[k.strip().lower()] = re.sub(r"(?i)\s*!\s*important$", "", v.strip()).lower()
    return out


def shown(e: Element) -> bool:
    return e.tag not in HIDDEN and not (e.tag == "input" and e.attrs.get("type", "").lower() == "hidden") and "hidden" not in e.attrs and style_of(e).get("display") != "none"


def is_block(x: Element | str) -> bool:
    return isinstance(x, Element) and (x.tag in BLOCK or style_of(x).get("display") in ("block", "list-item", "table", "flex", "grid"))


def has_block(e: Element) -> bool:
    """Found once for all elements within, from the leaves up."""
    if e.blocky is None:
        for x in reversed([x for x in e.walk() if isinstance(x, Element)]):
            x.blocky = any(isinstance(c, Element) and (shown(c) if is_block(c) else c.blocky) for c in x.children)
    return bool(e.blocky)


def inner_style(x: Element, st: Run) -> Run:
    """The style of what an element holds, given the style that it stands in."""
    css = style_of(x)
    weight = css.get("font-weight", "")
    bold = (x.tag in BOLD or st.bold) if not weight else weight in ("bold", "bolder") or weight.isdigit() and int(weight) >= 600
    italic = st.italic or x.tag in ITALIC or css.get("font-style") == "italic"
    strike = st.strike or x.tag in STRIKE or "line-through" in css.get("text-decoration", "")
    return Run("", bold, italic, strike, st.code or x.tag in CODE, x.attrs.get("href", "") if x.tag == "a" and x.attrs.get("href") else st.href)


def collect_runs(nodes: list, state: Run | None = None, lists: bool = False) -> list[Run]:
    """Text leaves with the styles of what holds them; images become literals. Nested lists are left out unless asked for."""
    out: list[Run] = []
    st = state or Run("")

    def walk(x: Element | str, st: Run) -> None:
        if isinstance(x, str):
            out.append(Run(x, *st.style))
            return
        if not shown(x) or (x.tag in LISTS and not lists):
            return
        if x.tag == "br":
            out.append(Run("\n", *st.style))
            return
        if x.tag == "img":
            out.append(Run(x.attrs.get("alt", ""), *st.style[:4], href=st.href, literal=True) if not x.attrs.get("src") else Run(f"![{x.attrs.get('alt', '')}]({x.attrs['src']})", *st.style[:4], href=st.href, literal=True))
            return
        own = inner_style(x, st)
        for c in x.children:
            walk(c, own)
        if is_block(x):
            out.append(Run(" ", *st.style))

    for x in nodes:
        walk(x, st)
    return coalesce(out)


def coalesce(runs: list[Run]) -> list[Run]:
    """Neighbours of one style are one run; literals stay apart."""
    out: list[Run] = []
    for r in runs:
        if out and not r.literal and not out[-1].literal and out[-1].style == r.style:
            out[-1] = Run(out[-1].text + r.text, *r.style)
        elif r.text or r.literal:
            out.append(r)
    return out


def collapse(runs: list[Run]) -> list[Run]:
    """White space runs to one space, over run borders too; none at either end."""
    out, space = [], True
    for r in runs:
        if r.literal:
            out.append(r)
            space = False
            continue
        text = re.sub(r"\s+", " ", r.text)
        if space and text.startswith(" "):
            text = text[1:]
        if text:
            space = text.endswith(" ")
            out.append(Run(text, *r.style))
    while out and not out[-1].literal and not out[-1].text.rstrip():
        out.pop()
    if out and not out[-1].literal:
        out[-1] = Run(out[-1].text.rstrip(" "), *out[-1].style)
    return out


def plain(runs: list[Run]) -> str:
    return " ".join("".join(re.sub(r"!\[(.*?)\]\(.*\)$", r"\1", r.text) if r.literal else r.text for r in runs).split())


def marker_text(value: int, kind: str) -> str:
    if kind in ("a", "A") and value > 0:
        out = ""
        while value:
            value, rest = divmod(value - 1, 26)
            out = chr(97 + rest) + out
        return out if kind == "a" else out.upper()
    if kind in ("i", "I") and 0 < value < 4000:
        out = ""
        for n, s in ROMAN:
            out, value = out + s * (value // n), value % n
        return out if kind == "i" else out.upper()
    return str(value)


def number(text: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d+)", text or "")
    return int(m[1]) if m else default


def list_block(e: Element) -> Block:
    ordered, count = e.tag == "ol", number(e.attrs.get("start"), 1)
    out = Block("list")
    for li in e.children:
        if not isinstance(li, Element) or not shown(li):
            continue
        if li.tag in LISTS:
            out.items.append(Item("", False, [], [list_block(li)]))
            continue
        count = number(li.attrs.get("value"), count)
        marker = marker_text(count, e.attrs.get("type", "1")) + "." if ordered else "-"
        count += 1
        box = next((x for x in li.walk() if isinstance(x, Element) and x.tag in ("img", "input", "select", "textarea", "button")), None)
        checked = "checked" in box.attrs if box is not None and box.tag == "input" and box.attrs.get("type", "").lower() == "checkbox" else None
        inner = outermost_lists(li)
        out.items.append(Item(marker, ordered, collapse(collect_runs(li.children)), [list_block(x) for x in inner], checked))
    return out


def outermost_lists(top: Element) -> list[Element]:
    out, todo = [], list(reversed(top.children))
    while todo:
        x = todo.pop()
        if isinstance(x, Element):
            if x.tag in LISTS:
                out.append(x)
            else:
                todo += reversed(x.children)
    return out


def table_block(e: Element) -> Block:
    out, rows = Block("table"), []
    for x in e.walk():
        if isinstance(x, Element) and x.tag == "tr" and next((p for p in ancestors(x) if p.tag == "table"), None) is e and shown(x):
            rows.append(x)
        if isinstance(x, Element) and x.tag == "caption" and x.parent is e:
            out.caption = collapse(collect_runs(x.children))
    spans, held = [], []
    for r, tr in enumerate(rows):
        own = [c for c in tr.children if isinstance(c, Element) and c.tag in ("td", "th") and shown(c)]
        heads = [c.tag == "th" or bool(cell_runs(c)) and all(x.bold for b in cell_runs(c) for x in b) for c in own]
        grouped = any(p.tag == "thead" for p in ancestors(tr))
        if own and (grouped or all(heads)):
            out.header_rows.add(r)
        for c, h in zip(own, heads):
            spans.append((r, max(1, min(number(c.attrs.get("rowspan"), 1), 65534)), max(1, min(number(c.attrs.get("colspan"), 1), 1000))))
            align = style_of(c).get("text-align") or c.attrs.get("align", "").lower()
            held.append((h, align, cell_runs(c)))
    out.cells = [Cell(*at, *h) for at, h in zip(occupy(spans), held)]
    return out


def ancestors(x: Element) -> Iterator[Element]:
    p = x.parent
    while p is not None:
        yield p
        p = p.parent


def cell_runs(c: Element) -> list[list[Run]]:
    """The cell's blocks as runs."""
    out: list[list[Run]] = []
    state = Run("", bold=c.tag == "th")
    pending: list = []

    def flush() -> None:
        runs = collapse(collect_runs(pending, state, lists=True))
        if runs:
            out.append(runs)
        pending.clear()

    def walk(e: Element) -> None:
        for x in e.children:
            if is_block(x) and shown(x):
                flush()
                if has_block(x):
                    walk(x)
                else:
                    pending.append(x)
                flush()
            else:
                pending.append(x)

    walk(c)
    flush()
    return out


def blocks_of(e: Element, state: Run | None = None) -> list[Block]:
    """Blocks in document order; state is the style that they stand in."""
    out: list[Block] = []
    pending: list = []
    state = state or Run("")

    def flush() -> None:
        runs = collapse(collect_runs(pending, state))
        if runs:
            out.append(Block("paragraph", runs))
        pending.clear()

    for x in e.children:
        if isinstance(x, Element) and not shown(x):
            continue
        if not is_block(x) and not (isinstance(x, Element) and has_block(x)):
            pending.append(x)
            continue
        flush()
        if re.fullmatch("h[1-6]", x.tag):
            runs = collapse(collect_runs(x.children, state))
            if runs:
                out.append(Block("heading", runs, level=int(x.tag[1])))
        elif x.tag == "blockquote":
            out.append(Block("quote", children=blocks_of(x, inner_style(x, state))))
        elif x.tag == "pre":
            out.append(Block("pre", text=x.text()))
        elif x.tag == "hr":
            out.append(Block("rule"))
        elif x.tag == "table":
            out.append(table_block(x))
        elif x.tag in LISTS:
            out.append(list_block(x))
        elif x.tag == "li":
            out.append(Block("list", items=[Item("-", False, collapse(collect_runs(x.children)), [])]))
        elif has_block(x):
            out += blocks_of(x, inner_style(x, state))
        else:
            runs = collapse(collect_runs([x], state))
            if runs:
                out.append(Block("paragraph", runs))
    flush()
    return out
