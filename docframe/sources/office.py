"""Word-processing, slide, book and rich-text documents to HTML."""

from __future__ import annotations

import html
import posixpath
import re
import urllib.parse
import xml.etree.ElementTree as ET

from docframe.sources.packages import parts_of
from docframe.sources.workbook import relations, tree

# Style names that are headings; number formats of lists and the list types that show them
HEADING = re.compile(r"(?i)heading\s*([1-9])|^(title)$")
LIST_TYPES = {"lowerLetter": "a", "upperLetter": "A", "lowerRoman": "i", "upperRoman": "I"}


def esc(text: str) -> str:
    return html.escape(text, quote=False)


def on(props: ET.Element | None, name: str) -> bool:
    e = props.find(name) if props is not None else None
    return e is not None and e.get("val", "1") not in ("0", "false", "none", "off")


class Word:
    """A word-processing package; its main part is walked once."""

    def __init__(self, parts: dict[str, bytes]):
        main = next((t for k, t in relations(parts, "").values() if k == "officeDocument"), "word/document.xml")
        self.rels = relations(parts, main)
        part = lambda kind: tree(next((parts.get(t) for k, t in self.rels.values() if k == kind), None))
        self.body = tree(parts[main]).find("body")
        self.styles = {s.get("styleId", ""): s for s in part("styles").iter("style")}
        numbering = part("numbering")
        abstract = {a.get("abstractNumId"): {int(v.get("ilvl", 0)): v for v in a.findall("lvl")} for a in numbering.findall("abstractNum")}
        self.levels, self.starts = {}, {}
        for n in numbering.findall("num"):
            link = n.find("abstractNumId")
            self.levels[n.get("numId")] = abstract.get(link.get("val") if link is not None else None, {})
            for o in n.findall("lvlOverride"):
                s = o.find("startOverride")
                if s is not None:
                    self.starts[n.get("numId"), int(o.get("ilvl", 0))] = int(s.get("val", 1))
        self.notes = {}
        for kind in ("footnotes", "endnotes"):
            for n in part(kind).iter(kind[:-1]):
                self.notes[kind[:-1], n.get("id")] = n

    def chain(self, style: str | None):
        """A style and those it is based on; one that was met ends it."""
        met = set()
        while style and style not in met and style in self.styles:
            met.add(style)
            yield self.styles[style]
            base = self.styles[style].find("basedOn")
            style = base.get("val") if base is not None else None

    def level_of(self, p: ET.Element) -> tuple[str, int] | None:
        pr = p.find("pPr")
        style = pr.find("pStyle").get("val") if pr is not None and pr.find("pStyle") is not None else None
        for holder in [pr, *[s.find("pPr") for s in self.chain(style)]]:
            num = holder.find("numPr") if holder is not None else None
            if num is not None and num.find("numId") is not None:
                level = num.find("ilvl")
                return (num.find("numId").get("val"), int(level.get("val", 0)) if level is not None else 0) if num.find("numId").get("val") != "0" else None
        return None

    def heading_of(self, p: ET.Element) -> int:
        pr = p.find("pPr")
        style = pr.find("pStyle").get("val") if pr is not None and pr.find("pStyle") is not None else None
        for s in self.chain(style):
            name = s.find("name")
            m = HEADING.search((name.get("val", "") if name is not None else "") or s.get("styleId", ""))
            if m:
                return 1 if m[2] else min(6, int(m[1]))
        m = HEADING.search(style or "")
        return (1 if m[2] else min(6, int(m[1]))) if m else 0

    def run(self, r: ET.Element) -> str:
        pr, out = r.find("rPr"), []
        for x in r:
            if x.tag == "t":
                out.append(esc(x.text or ""))
            elif x.tag in ("tab",):
                out.append(" ")
            elif x.tag in ("br", "cr") and x.get("type", "textWrapping") == "textWrapping":
                out.append("<br>")
            elif x.tag in ("footnoteReference", "endnoteReference"):
                note = self.notes.get((x.tag[:-9], x.get("id")))
                out.append(f"<sup>{esc(x.get('id', ''))}</sup>" if note is not None else "")
            elif x.tag in ("drawing", "pict"):
                alt = next((d.get("descr") or "" for d in x.iter("docPr")), "")
                blip = next((d for d in x.iter("blip")), None)
                target = self.rels.get(blip.get("embed", ""), ("", ""))[1] if blip is not None else ""
                out.append(f'<img src="{html.escape(target)}" alt="{html.escape(alt)}">')
        text = "".join(out)
        style = pr.find("rStyle").get("val") if pr is not None and pr.find("rStyle") is not None else None
        holders = [pr, *[s.find("rPr") for s in self.chain(style)]]
        first = lambda name: next((on(h, name) for h in holders if h is not None and h.find(name) is not None), False)
        for flag, tag in (("b", "b"), ("i", "i"), ("strike", "s")):
            if text and first(flag):
                text = f"<{tag}>{text}</{tag}>"
        return text

    def inline(self, p: ET.Element) -> str:
        """Insertions are in, deletions and anchors out."""
        out = []
        for x in p:
            if x.tag == "r":
                out.append(self.run(x))
            elif x.tag == "hyperlink":
                url = self.rels.get(x.get("id", ""), ("", ""))[1] or (f"#{x.get('anchor')}" if x.get("anchor") else "")
                out.append(f'<a href="{html.escape(url)}">{self.inline(x)}</a>')
            elif x.tag in ("ins", "smartTag", "fldSimple", "moveTo"):
                out.append(self.inline(x))
            elif x.tag == "sdt" and x.find("sdtContent") is not None:
                out.append(self.inline(x.find("sdtContent")))
        return "".join(out)

    def blocks(self, holder: ET.Element, counts: dict | None = None) -> str:
        counts = {} if counts is None else counts
        out: list[str] = []
        open_lists: list[tuple[str, str]] = []  # (closing tags, list id) from the outermost on

        def close(depth: int) -> None:
            while len(open_lists) > depth:
                out.append(f"</li></{open_lists.pop()[0]}>")

        items = [y for x in holder for y in (x.find("sdtContent") if x.tag == "sdt" and x.find("sdtContent") is not None else [x])]
        for x in items:
            if x.tag == "p":
                level = self.level_of(x)
                heading = self.heading_of(x)
                if level and not heading:
                    number, depth = level
                    for key in [k for k in counts if k[0] == number and k[1] > depth]:
                        del counts[key]
                    lvl = self.levels.get(number, {}).get(depth)
                    fmt = lvl.find("numFmt").get("val", "decimal") if lvl is not None and lvl.find("numFmt") is not None else "decimal"
                    start = lvl.find("start") if lvl is not None else None
                    first = self.starts.get((number, depth), int(start.get("val", 1)) if start is not None else 1)
                    counts[number, depth] = counts.get((number, depth), first - 1) + 1
                    close(depth + 1 if not open_lists or open_lists[0][1] == number else 0)
                    tag = "ul" if fmt == "bullet" else "ol"
                    if len(open_lists) == depth + 1:
                        out.append("</li>")
                    while len(open_lists) < depth + 1:
                        if open_lists and out[-1].startswith("<ol") or open_lists and out[-1].startswith("<ul"):
                            out.append("<li>")
                        kind = f' type="{LIST_TYPES[fmt]}"' if fmt in LIST_TYPES else ""
                        out.append(f'<{tag}{kind} start="{counts[number, depth]}">' if tag == "ol" else "<ul>")
                        open_lists.append((tag, number))
                    out.append(f"<li>{self.inline(x)}")
                    continue
                close(0)
                text = self.inline(x)
                if heading:
                    out.append(f"<h{heading}>{text}</h{heading}>")
                elif text:
                    out.append(f"<p>{text}</p>")
            elif x.tag == "tbl":
                close(0)
                out.append(self.table(x))
        close(0)
        return "\n".join(out)

    def table(self, t: ET.Element) -> str:
        rows, spans = [], {}
        for r, tr in enumerate(t.findall("tr")):
            col, own = 0, []
            for tc in tr.findall("tc"):
                pr = tc.find("tcPr")
                span = int(pr.find("gridSpan").get("val", 1)) if pr is not None and pr.find("gridSpan") is not None else 1
                merge = pr.find("vMerge") if pr is not None else None
                if merge is not None and merge.get("val", "continue") != "restart" and col in spans:
                    spans[col]["rows"] += 1
                else:
                    cell = {"cols": span, "rows": 1, "text": self.blocks(tc, {})}
                    own.append(cell)
                    if merge is not None:
                        spans[col] = cell
                    else:
                        spans.pop(col, None)
                col += span
            head = tr.find("trPr/tblHeader") is not None
            rows.append((head, own))
        line = lambda head, own: "<tr>" + "".join(f'<{"th" if head else "td"} colspan="{c["cols"]}" rowspan="{c["rows"]}">{c["text"]}</{"th" if head else "td"}>' for c in own) + "</tr>"
        return "<table>" + "".join(line(h, o) for h, o in rows) + "</table>"


def nested(items: list[tuple[int, bool, str]]) -> str:
    """(depth, ordered, text) as lists within lists."""
    out, open_tags = [], []
    for depth, ordered, text in items:
        tag = "ol" if ordered else "ul"
        while len(open_tags) > depth + 1 or len(open_tags) == depth + 1 and open_tags[-1] != tag:
            out.append(f"</li></{open_tags.pop()}>")
        if len(open_tags) == depth + 1:
            out.append("</li>")
        while len(open_tags) < depth + 1:
            out.append(f"<{tag}>" if not open_tags or not out[-1].endswith(">") or out[-1].startswith("<li>") or out[-1].startswith("</") else f"<li><{tag}>")
            open_tags.append(tag)
        out.append(f"<li>{text}")
    return "".join(out + [f"</li></{t}>" for t in reversed(open_tags)])


def docx_to_html(data: bytes) -> str:
    w = Word(parts_of(data))
    return w.blocks(w.body)


def pptx_to_html(data: bytes) -> str:
    """Shown slides in order: the title, then shapes by top and left; places that a shape lacks come from its layout, then the master."""
    parts = parts_of(data)
    main = next((t for k, t in relations(parts, "").values() if k == "officeDocument"), "ppt/presentation.xml")
    rels, out = relations(parts, main), []
    for s in tree(parts[main]).iter("sldId"):
        part = rels.get(s.attrib.get("id", ""), ("", ""))[1]
        if part not in parts:
            part = next((t for k, (kind, t) in rels.items() if kind == "slide" and k in s.attrib.values()), "")
        slide = tree(parts.get(part))
        if slide.get("show", "1") in ("0", "false") or slide.tag == "none":
            continue
        layout = next((t for k, t in relations(parts, part).values() if k == "slideLayout"), "")
        master = next((t for k, t in relations(parts, layout).values() if k == "slideMaster"), "")
        places = [frames(tree(parts.get(p))) for p in (layout, master)]
        shapes = []
        for e in slide.iter():
            if e.tag not in ("sp", "graphicFrame", "pic"):
                continue
            kind, idx = placeholder(e)
            at = offset(e)
            for p in places:
                at = at or p.get((kind, idx)) or p.get((kind, ""))
            title = kind in ("title", "ctrTitle")
            body = table(e) if e.find(".//tbl") is not None else shape_text(e, title) if e.tag == "sp" else ""
            if body:
                shapes.append((not title, at or (0, 0), len(shapes), body))
        out.append('<section class="slide">' + "\n".join(x[-1] for x in sorted(shapes)) + "</section>")
    return "\n".join(out)


def placeholder(e: ET.Element) -> tuple[str | None, str]:
    ph = e.find(".//nvPr/ph")
    return (ph.get("type", "body"), ph.get("idx", "")) if ph is not None else (None, "")


def offset(e: ET.Element) -> tuple[int, int] | None:
    off = e.find(".//xfrm/off")
    return (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else None


def frames(root: ET.Element) -> dict:
    return {placeholder(e): offset(e) for e in root.iter("sp") if placeholder(e)[0] and offset(e)}


def shape_text(e: ET.Element, title: bool) -> str:
    out = []
    for p in e.iterfind("txBody/p"):
        text = "".join("<br>" if r.tag == "br" else styled(r) for r in p if r.tag in ("r", "br", "fld"))
        if not text:
            continue
        pr = p.find("pPr")
        bullet = pr is not None and (pr.find("buChar") is not None or pr.find("buAutoNum") is not None)
        out.append(f"<h1>{text}</h1>" if title else f"<ul><li>{text}</li></ul>" if bullet else f"<p>{text}</p>")
    return "\n".join(out).replace("</ul>\n<ul>", "")


def styled(r: ET.Element) -> str:
    t, pr = r.find("t"), r.find("rPr")
    text = esc(t.text or "") if t is not None else ""
    for flag, tag in (("b", "b"), ("i", "i")):
        if text and pr is not None and pr.get(flag) in ("1", "true"):
            text = f"<{tag}>{text}</{tag}>"
    return text


def table(e: ET.Element) -> str:
    rows = []
    for tr in e.iter("tr"):
        cells = [c for c in tr.findall("tc") if c.get("hMerge") != "1" and c.get("vMerge") != "1"]
        rows.append("<tr>" + "".join(f'<td colspan="{c.get("gridSpan", 1)}" rowspan="{c.get("rowSpan", 1)}">{esc(" ".join(t.text or "" for t in c.iter("t")))}</td>' for c in cells) + "</tr>")
    return f"<table>{''.join(rows)}</table>"


def epub_to_html(data: bytes) -> str:
    """The spine's chapters in order, without those off the line. Encrypted books are an error."""
    parts = parts_of(data)
    if any(n.lower() == "meta-inf/encryption.xml" for n in parts) and tree(parts["META-INF/encryption.xml"]).find(".//CipherReference") is not None:
        raise ValueError("the book is encrypted")
    root = next(r.get("full-path", "") for r in tree(parts["META-INF/container.xml"]).iter("rootfile"))
    opf, folder, out = tree(parts[root]), posixpath.dirname(root), []
    manifest = {i.get("id"): i.get("href", "") for i in opf.iter("item")}
    for ref in opf.iter("itemref"):
        if ref.get("linear", "yes") == "no":
            continue
        name = posixpath.normpath(posixpath.join(folder, urllib.parse.unquote(manifest.get(ref.get("idref"), ""))))
        chapter = parts.get(name, b"").decode("utf-8", "replace")
        body = re.search(r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\Z)", chapter)
        out.append(f"<section>{body[1] if body else chapter}</section>")
    return "\n".join(out)


RTF = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|([\r\n]+)|([^\\{}\r\n]+)")
# Groups that hold no text of the document; control words that stand for a letter
SILENT = frozenset("fonttbl colortbl stylesheet info pict header footer headerl headerr headerf footerl footerr footerf themedata colorschememapping datastore listtable listoverridetable rsidtbl generator xmlnstbl latentstyles filetbl".split())
LETTERS = {"emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "tab": " ", "emspace": " ", "enspace": " ", "~": "\xa0", "_": "-", "-": ""}


def rtf_to_html(data: bytes) -> str:
    """Control words and groups in turn: paragraphs, headings by outline level, tables, links, bold, italic, strike."""
    out, para, cells, rows = [], [], [], []
    state = {"b": False, "i": False, "strike": False, "skip": False, "uc": 1, "level": 0, "field": "", "table": False, "li": 0}
    stack, pending, field, items = [], 0, [""], []

    def emit(text: str) -> None:
        if state["skip"]:
            if state["field"] == "inst":
                field[0] += text
            return
        text = esc(text)
        for flag, tag in (("b", "b"), ("i", "i"), ("strike", "s")):
            if state[flag] and text:
                text = f"<{tag}>{text}</{tag}>"
        para.append(text)

    def end_rows() -> None:
        if rows:
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>")
            rows.clear()

    def end_items() -> None:
        if items:
            out.append(nested(items))
            items.clear()

    def end_para() -> None:
        text = "".join(para).strip()
        para.clear()
        m = re.match(r"(?:([•‣·◦▪●])|(\d+|[a-zA-Z]|[ivxlcIVXLC]+)[.)])\s+(.*)$", text, re.S)
        if text and state["li"] > 0 and m and not state["level"]:
            end_rows()
            items.append((max(0, min(8, state["li"] // 360 - 1)), m[1] is None, m[3]))
        elif text:
            end_rows()
            end_items()
            level = state["level"]
            out.append(f"<h{level}>{text}</h{level}>" if level else f"<p>{text}</p>")

    for m in RTF.finditer(data):
        word, number = (m[1] or b"").decode("latin-1"), m[2]
        n = int(number) if number is not None else None
        if m[5] == b"{":
            stack.append(dict(state))
        elif m[5] == b"}":
            if stack:
                if state["field"] == "rslt" and stack[-1]["field"] != "rslt" and field[0]:
                    para.append("</a>")
                    field[0] = ""
                state = stack.pop()
        elif word:
            if word in SILENT or (word == "pict"):
                state["skip"] = True
            elif word == "par" or word == "sect" or word == "page":
                if not state["skip"]:
                    end_para()
            elif word == "pard":
                state |= {"level": 0, "table": False, "li": 0}
            elif word == "plain":
                state |= {"b": False, "i": False, "strike": False}
            elif word in ("b", "i", "strike"):
                state[word] = n != 0
            elif word == "outlinelevel":
                state["level"] = min(6, (n or 0) + 1)
            elif word == "li":
                state["li"] = n or 0
            elif word == "intbl":
                state["table"] = True
            elif word == "cell":
                cells.append("".join(para).strip())
                para.clear()
            elif word == "row":
                end_items()
                rows.append(list(cells))
                cells.clear()
            elif word == "line":
                para.append("<br>")
            elif word == "uc":
                state["uc"] = n if n is not None else 1
            elif word == "u" and n is not None:
                emit(chr(n % 65536) if not 0xD800 <= n % 65536 < 0xE000 else "\ufffd")
                pending = state["uc"]
            elif word == "fldinst":
                state |= {"skip": True, "field": "inst"}
                field[0] = ""
            elif word == "fldrslt":
                got = re.search(r'HYPERLINK\s+(?:\\l\s+)?"([^"]*)"', field[0])
                state |= {"skip": False, "field": "rslt"}
                field[0] = got[1] if got else ""
                if got:
                    para.append(f'<a href="{html.escape(got[1])}">')
            elif word in LETTERS:
                emit(LETTERS[word])
        elif m[3]:
            if pending:
                pending -= 1
            else:
                emit(bytes.fromhex(m[3].decode()).decode("cp1252", "replace"))
        elif m[4]:
            if m[4] == b"*":
                state["skip"] = True
            elif m[4] in b"\\{}":
                emit(m[4].decode())
            elif m[4] in b"~_-":
                emit(LETTERS[m[4].decode()])
            elif m[4] in b"\r\n":
                end_para()
        elif m[7]:
            text = m[7].decode("cp1252", "replace")
            skipped = min(pending, len(text))
            pending -= skipped
            emit(text[skipped:])
    end_para()
    end_items()
    end_rows()
    return "\n".join(out)
