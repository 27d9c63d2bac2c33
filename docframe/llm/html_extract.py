"""Main text of web pages by tree scoring.

Texts between block boundaries pass points for length and commas to their ancestors, discounted by
link density. The best container, its enclosing article and like siblings are kept; menus, page
headers, footers, sidebars, notices, adverts, forms, scripts and reader comments are not.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.shared import pick

#: Elements whose content is raw text and never shown; those whose content is markup that is not shown either, foreign ones of which end at any block.
RAW = "script|style|title|textarea|iframe|noembed|noframes|xmp"
UNSHOWN, FOREIGN = frozenset("noscript template svg math object".split()), frozenset("svg math".split())
#: Inside of a tag: quotes count after an equals sign only, and must end.
INSIDE = r"(?>[^<>\"'=]+|=\s*(?:\"[^\"]*\"|'[^']*')?|[\"'])*"
TOKENS = re.compile(
    rf"(?is)<!--.*?(?:--!?>|\Z)|<({RAW})(?=[\s/>]){INSIDE}>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    rf"|<(/?)([a-z][^\s/><]*)({INSIDE})>|<[!?/][^>]*>?|([^<]+|<)"
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks that only pass their points on.
PARAGRAPHS = frozenset("p pre li dt dd td th h1 h2 h3 h4 h5 h6 blockquote figcaption caption summary address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open p; and those that end an open element of their own kind, up to a border.
ENDS_P = BLOCKS - frozenset("button option optgroup select body html head caption tbody td tfoot th thead tr".split())
SAME = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"})}
#: Elements that never hold main text, and roles like them.
DROPPED = frozenset("head nav aside footer menu dialog button select option search input fieldset legend".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words of class and id names that mark what is not main text.
UNLIKELY = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr notice notices popup popover modal "
    "overlay newsletter subscribe subscription signup menu nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar aside widget widgets related recommended recommendations share sharing "
    "social comment comments commentlist disqus respond replies reply footer masthead toolbar skip login search topbar header".split()
)
#: Of these, words that mark adverts, notices and what readers write, wherever they stand; the others are overruled by prose within an article.
ALWAYS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion cookie cookies consent gdpr notice notices popup popover modal "
    "newsletter subscribe subscription signup comments commentlist disqus respond replies reply related recommended recommendations".split()
)
#: Of these, words that take out an inline element too.
ADVERTS = frozenset("ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion".split())
#: Points of a text that an ancestor of some level still gets, times that level.
LEAST = 0.01
LIKELY = frozenset("article body content entry main page post story text blog".split())
HOLDS_MAIN = frozenset({"article", "main"})
#: Of these, words for what readers write: it may hold articles of its own.
REPLIES = frozenset("comment comments commentlist disqus respond replies reply".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "score", "chars", "links", "order")

    def __init__(self, tag: str, attrs: str, parent: "Node | None", order: int):
        self.tag, self.attrs, self.parent, self.order = tag, attrs, parent, order
        self.items: list = []  # nodes, and (text, characters in links)
        self.score, self.chars, self.links = 0.0, 0, 0


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(ATTRIBUTE.finditer(text)))} if text.strip(" /") else {}


def name_words(attrs: dict[str, str]) -> set[str]:
    return {w.lower() for w in WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")}


def hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")) is not None


class Stack(list):
    """Open elements, and where those of each tag stand, so that the nearest is found at once however deep they nest."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.at: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self))
        self.append(node)

    def cut(self, at: int) -> None:
        while len(self) > at:
            self.at[self.pop().tag].pop()

    def nearest(self, tags, border=frozenset()) -> int:
        """The place of the innermost open element of these tags, unless one of the border's is nearer; 0 if there is none."""
        own = max((places[-1] for t in tags if (places := self.at.get(t))), default=0)
        return own if own and all(not (places := self.at.get(t)) or places[-1] < own for t in border) else 0


def parse(source: str) -> Node:
    """The page's blocks as a tree. Inline elements make no node, but for those that hide or mark out what they hold."""
    root = Node("#root", "", None, 0)
    stack, parts, linked, in_link, order = Stack(root), [], 0, False, 0
    unshown, depth = "", 0  # the element whose content is passed over, and how many of its kind are open
    last: dict[str, int] = {}  # where the last end tag of an element stands

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                stack[-1].items.append((text, min(linked, len(text))))
            parts, linked = [], 0

    def close(at: int) -> None:
        nonlocal in_link
        flush()
        in_link = False
        stack.cut(at)

    def open_node(tag: str, attrs: str) -> None:
        nonlocal order
        order += 1
        node = Node(tag, attrs, stack[-1], order)
        stack[-1].items.append(node)
        stack.push(node)

    for m in TOKENS.finditer(source):
        text = m[5]
        if text is not None:
            if not unshown:
                parts.append(text)
                if in_link:
                    linked += len(text.strip())
            continue
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if unshown:
            if tag == unshown and not (tag in FOREIGN and m[4].endswith("/")):
                depth += -1 if m[2] else 1
                if not depth:
                    unshown = ""
            if not (unshown in FOREIGN and tag in BLOCKS and not m[2]):
                continue
            unshown = ""
        if m[2]:
            if tag in BLOCKS:
                at = stack.nearest({tag})
                if at:
                    close(at)
                else:
                    flush()
            elif tag == "a":
                in_link = False
            elif stack[-1].tag == tag:  # an inline element with a node
                close(len(stack) - 1)
            continue
        if tag in UNSHOWN:
            if tag not in last:
                last[tag] = max((e.start() for e in re.finditer(rf"(?i)</{tag}(?=[\s/>])", source)), default=-1)
            if last[tag] > m.end() and not (tag in FOREIGN and m[4].endswith("/")):
                unshown, depth = tag, 1
        elif tag in BLOCKS:
            flush()
            in_link = False
            if tag == "hr":
                continue
            if tag in ENDS_P and (at := stack.nearest({"p"}, {"button", "td", "th", "caption"})):
                close(at)
            if tag in SAME and (at := stack.nearest(*SAME[tag])):
                close(at)
            open_node(tag, m[4])
        elif tag == "br":
            parts.append("\n")
        elif tag == "a":
            in_link = True
        elif tag not in VOID and m[4] and ("class" in m[4] or "id" in m[4] or "hidden" in m[4] or "style" in m[4]):
            attrs = attributes(m[4])
            if hidden(attrs) or name_words(attrs) & ADVERTS:
                flush()
                open_node(tag, m[4])
    flush()
    return root


def prune(root: Node) -> list[Node]:
    """Takes out what is not main text; gives the nodes left, parents first."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += [x for x in reversed(node.items) if isinstance(x, Node)]
    sure: set[int] = set()  # nodes with main or h1 below
    holds: set[int] = set()  # and those with an article
    for node in nodes:
        for kind, tags in ((sure, ("main", "h1")), (holds, ("main", "h1", "article"))):
            up = node.parent if node.tag in tags else None
            while up is not None and id(up) not in kind:
                kind.add(id(up))
                up = up.parent
    chars, links, ends = {}, {}, {}
    for node in reversed(nodes):
        chars[id(node)] = sum(chars[id(x)] if isinstance(x, Node) else len(x[0]) for x in node.items)
        links[id(node)] = sum(links[id(x)] if isinstance(x, Node) else x[1] for x in node.items)
        ends[id(node)] = any(ends[id(x)] if isinstance(x, Node) else x[0].endswith((".", "!", "?", ":", "\u3002")) for x in node.items)
    total = chars[id(root)]
    kept, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        kept.append(node)
        inside = inside or node.tag in HOLDS_MAIN
        items = []
        for x in node.items:
            if not isinstance(x, Node):
                items.append(x)
                continue
            attrs = attributes(x.attrs)
            gone = hidden(attrs) or x.tag in DROPPED or attrs.get("role", "").lower() in ROLES and x.tag not in HOLDS_MAIN
            gone = gone or x.tag == "header" and not inside
            gone = gone or x.tag == "form" and (inside or id(x) not in holds and chars[id(x)] < total / 2)
            words = name_words(attrs) & UNLIKELY - ({"header"} if inside else frozenset())
            prose = inside and not words & ALWAYS and (x.tag in HEADINGS or ends[id(x)] and 4 * links[id(x)] < chars[id(x)])
            likely = prose or x.tag == "h1" or x.tag not in BLOCKS and not words & ADVERTS or id(x) in sure or id(x) in holds and chars[id(x)] > total / 2 and not words & REPLIES
            gone = gone or bool(words) and x.tag not in ("html", "body", "main", "article") and not likely
            gone = gone or x.tag == "article" and bool(words & (REPLIES | {"related"}))
            if not gone:
                items.append(x)
        node.items = items
        todo += [(x, inside) for x in reversed(items) if isinstance(x, Node)]
    return kept


def score(nodes: list[Node]) -> None:
    """Points pass to all ancestors, less with each level, until they no longer count; nodes come parents first."""
    for node in nodes:
        node.score = node.chars = node.links = 0
    for node in nodes:
        for x in node.items:
            if isinstance(x, Node):
                continue
            text, linked = x
            points = (min(len(text), 25) / 25 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
            up, level = node.parent if node.tag in PARAGRAPHS else node, 0
            while up is not None and up.tag in PARAGRAPHS and up.parent is not None:
                up = up.parent
            while up is not None and points > LEAST * level:
                up.score += points / (1, 2)[level] if level < 2 else points / (3 * level)
                up, level = up.parent, level + 1
            node.chars += len(text)
            node.links += linked
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.links += node.links
    for node in nodes:
        if node.tag not in PARAGRAPHS and node.chars:
            words = name_words(attributes(node.attrs))
            node.score += 25 * bool(words & LIKELY and node.tag not in ("html", "body")) + {"article": 25, "main": 15, "section": 3, "div": 2}.get(node.tag, 0)
            node.score *= 1 - node.links / node.chars


def density(node: Node) -> float:
    return node.links / node.chars if node.chars else 0.0


def blocks_of(node: Node) -> Iterator[str]:
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            todo += reversed(x.items)
        else:
            yield x[0]


def main_text(source: str | None) -> str:
    """The main text's blocks, in page order, joined by two line feeds; empty if there is none."""
    if not source:
        return ""
    nodes = prune(parse(source))
    score(nodes)
    containers = [n for n in nodes if n.tag not in PARAGRAPHS and n.chars and n.parent is not None] or nodes[:1]
    best = max(containers, key=lambda n: (n.score, -n.order))
    up = best
    while up is not None:
        if up.tag in HOLDS_MAIN and (best.tag not in HOLDS_MAIN or up.tag == "article"):
            best = up
        up = up.parent
    kept: list = [best]
    if best.parent is not None and best.tag not in ("body", "html"):
        kept = []
        for x in best.parent.items:
            if x is best:
                kept.append(x)
            elif isinstance(x, Node) and x.chars:
                like = x.tag == best.tag and (x.tag == "article" or attributes(x.attrs).get("class") == attributes(best.attrs).get("class") != None)  # noqa: E711
                prose = x.tag in PARAGRAPHS and (x.tag in HEADINGS and density(x) < 0.5 or x.chars > 80 and density(x) < 0.25 or x.links == 0 and any(b.endswith((".", "!", "?")) for b in blocks_of(x)))
                if prose or x.tag not in PARAGRAPHS and (x.score >= max(5, best.score / 5) or like and x.links < x.chars / 2):
                    kept.append(x)
            elif not isinstance(x, Node) and len(x[0]) > 80 and x[1] < len(x[0]) / 4:
                kept.append(x)
    return "\n\n".join(b for x in kept for b in blocks_of(x))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars for every page; a null or empty page has the empty text.

    Ids, urls and repeated rows pass as they come. Of containers with equal scores the first in page
    order is the best. Bytes that are no UTF-8 count as U+FFFD. Elements may nest to any depth.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n"])

    own = pick(pages, id_col, url_col, html_col).withColumn(html_col, F.make_valid_utf8(html_col))
    a, b = (own.schema[i].dataType.simpleString() for i in (0, 1))
    return own.mapInArrow(run, f"id {a}, url {b}, text string, n long").toDF(id_col, url_col, "text", "n_chars")
