"""HTML to a tree, and the tree to a relation of nodes."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values from the HTML standard: kinds of elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style title textarea xmp iframe noembed noframes".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u del ins sub sup mark".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section summary table ul".split()
)
SCOPE = frozenset("html table td th caption button object template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TABLE_PARTS = {
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption"}, {"table"}), "option": ({"option"}, {"select"}), "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
}
# inside of a tag, quotes count after an equals sign only, and must end
TOKEN = re.compile(r"(?s)<!--(.*?)(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/><]*)((?>[^<>\"'=]+|=\s*(?:\"[^\"]*\"|'[^']*')?|[\"'])*)>|<[!?/][^>]*>?|([^<]+|<)")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Element:
    __slots__ = ("tag", "attrs", "children", "parent", "blocky")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: "Element | None" = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Element | str] = []
        self.blocky: bool | None = None  # whether a block is shown within; found when first asked for

    def walk(self) -> Iterator["Element | str"]:
        todo: list = [self]
        while todo:
            x = todo.pop()
            yield x
            if isinstance(x, Element):
                todo += reversed(x.children)

    def find(self, tag: str) -> "Element | None":
        return next((x for x in self.walk() if isinstance(x, Element) and x.tag == tag), None)

    def text(self) -> str:
        return "".join(x for x in self.walk() if isinstance(x, str))


def read_attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


class Builder:
    """Open elements, and the formatting elements that go on after the block they were opened in has ended."""

    def __init__(self) -> None:
        self.root = Element("html")
        self.head, self.body = Element("head", parent=self.root), Element("body", parent=self.root)
        self.root.children += [self.head, self.body]
        self.stack, self.active = [self.root, self.body], []
        self.open_tags: dict[str, int] = {}  # how many of each tag are open, so that none is looked for in vain

    def put(self, node: Element | str) -> None:
        top = self.stack[-1]
        if isinstance(node, str) and top.children and isinstance(top.children[-1], str):
            top.children[-1] += node
        else:
            top.children.append(node)

    def open(self, tag: str, attrs: dict[str, str], push: bool = True) -> Element:
        node = Element(tag, attrs, self.stack[-1])
        self.put(node)
        if push:
            self.stack.append(node)
            self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        return node

    def cut(self, at: int) -> None:
        for x in self.stack[at:]:
            self.open_tags[x.tag] -= 1
        del self.stack[at:]

    def index(self, tags, border) -> int:
        if not any(self.open_tags.get(t) for t in tags):
            return 0
        for i in range(len(self.stack) - 1, 1, -1):
            if self.stack[i].tag in tags:
                return i
            if self.stack[i].tag in border:
                return 0
        return 0

    def close(self, tags, border=SCOPE) -> bool:
        at = self.index(tags, border)
        if at:
            self.cut(at)
        return bool(at)

    def reopen(self) -> None:
        """Formatting elements that a block's end has closed are opened anew, those since the last cell's start."""
        last = max((i for i, f in enumerate(self.active) if f.tag == "#marker"), default=-1)
        for i in range(last + 1, len(self.active)):
            f = self.active[i]
            if f not in self.stack:
                self.active[i] = self.open(f.tag, dict(f.attrs))

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "head", "body"):
            own = {"html": self.root, "head": self.head, "body": self.body}[tag]
            for k, v in attrs.items():
                own.attrs.setdefault(k, v)
            return
        if tag in CLOSES_P:
            self.close({"p"}, SCOPE)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.cut(len(self.stack) - 1)
        if tag in TABLE_PARTS:
            self.close(*TABLE_PARTS[tag])
            if tag in ("td", "th") and self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                self.start("tr", {})
            if tag == "tr" and self.stack[-1].tag == "table":
                self.open("tbody", {})
        if tag in FORMATTING:
            if tag == "a":
                self.active = [f for f in self.active if f.tag != "a"]
                self.close({"a"})
            self.reopen()
            last = max((i for i, f in enumerate(self.active) if f.tag == "#marker"), default=-1)
            same = [i for i in range(last + 1, len(self.active)) if self.active[i].tag == tag and self.active[i].attrs == attrs]
            if len(same) >= 3:  # three of a kind go on at most
                del self.active[same[0]]
            self.active.append(self.open(tag, attrs))
            return
        if tag not in CLOSES_P and tag not in TABLE_PARTS:
            self.reopen()
        self.open(tag, attrs, tag not in VOID)
        if tag in ("td", "th", "caption"):
            self.active.append(Element("#marker"))

    def end(self, tag: str) -> None:
        if tag in ("html", "head", "body"):
            return
        if tag == "p" and not self.index({"p"}, SCOPE):
            self.open("p", {})
        if tag in FORMATTING:
            for i in range(len(self.active) - 1, -1, -1):
                if self.active[i].tag == "#marker":
                    break
                if self.active[i].tag == tag:
                    f = self.active.pop(i)
                    if f in self.stack:
                        inner = [x for x in self.stack[self.stack.index(f) + 1 :]]
                        if any(x.tag not in FORMATTING for x in inner):
                            self.open_tags[f.tag] -= 1
                            self.stack.remove(f)  # the block within stays open, without this formatting from here on
                        else:
                            self.cut(self.stack.index(f))
                    return
            return
        if tag in HEADINGS:
            self.close(HEADINGS, SCOPE)
        elif self.close({tag}, {"table"} - {tag} if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot") else frozenset()) and tag in ("td", "th", "caption"):
            while self.active and self.active.pop().tag != "#marker":
                pass

    def text(self, text: str) -> None:
        if text.strip():
            self.reopen()
        self.put(text)


def parse(source: str) -> Element:
    """The document's tree. Comments are dropped; head elements keep their place in head."""
    b = Builder()
    at, n = 0, len(source)
    while at < n:
        m = TOKEN.match(source, at)
        if m is None:
            break
        at = m.end()
        if m[5] is not None:
            b.text(html.unescape(m[5]))
        elif m[3]:
            tag = m[3].lower()
            if m[2]:
                b.end(tag)
                continue
            attrs = read_attributes(m[4])
            if tag in RAW_TEXT:
                stop = re.compile(rf"(?i)</{tag}\b[^>]*>").search(source, at)
                inner, at = source[at : stop.start() if stop else n], stop.end() if stop else n
                node = Element(tag, attrs, b.stack[-1])
                if inner:
                    node.children.append(html.unescape(inner) if tag in ("title", "textarea") else inner)
                (b.head if tag in ("title", "style", "script") and not b.body.children else b.stack[-1]).children.append(node)
            elif tag in ("meta", "link", "base"):
                (b.head if not b.body.children else b.stack[-1]).children.append(Element(tag, attrs, b.head))
            else:
                b.start(tag, attrs)
                if tag in ("pre", "textarea") and source.startswith("\n", at):
                    at += 1
    return b.root


NODES = "doc_id long, node_id int, parent_id int, pre int, post int, depth int, tag string, attrs map<string,string>, text string"


def node_rows(root: Element) -> Iterator[tuple]:
    """(node_id, parent_id, pre, post, depth, tag, attrs, text); text nodes have tag #text. A node's descendants have greater pre and smaller post."""
    clock, ids = 0, 0
    rows: list[list] = []
    todo: list[tuple] = [(root, None, 0, False)]
    open_rows: dict[int, list] = {}
    while todo:
        node, parent, depth, done = todo.pop()
        if done:
            clock += 1
            open_rows[id(node)][3] = clock
            continue
        ids += 1
        clock += 1
        own = ids
        if isinstance(node, str):
            clock += 1
            rows.append([own, parent, clock - 1, clock, depth, "#text", None, node])
            continue
        row = [own, parent, clock, 0, depth, node.tag, list(node.attrs.items()), None]
        open_rows[id(node)] = row
        rows.append(row)
        todo.append((node, parent, depth, True))
        todo += [(c, own, depth + 1, False) for c in reversed(node.children)]
    yield from map(tuple, rows)


def nodes(docs: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """NODES of every document; null documents have only html, head and body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = list(node_rows(parse(source.as_py() or "")))
                cols = list(zip(*rows))
                kinds = [pa.int32()] * 5 + [pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
                arrays = [pa.array([doc] * len(rows), pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds)]]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "node_id", "parent_id", "pre", "post", "depth", "tag", "attrs", "text"])

    return docs.select(docs[id_col].cast("long"), docs[html_col]).mapInArrow(run, NODES)
