"""Blocks to HTML, word-processing, rich text, slides and books."""

from __future__ import annotations

import re
from html import escape

from docframe.operators.boxes import Block, Item, Run, plain
from docframe.sources.packages import pack

# Fixed values of the formats, here and in the parts written below: namespaces, part names, content types, control words
NS = "http://schemas.openxmlformats.org"
OFFICE, RELS = f"{NS}/officeDocument/2006/relationships", f"{NS}/package/2006/relationships"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def esc(text: str) -> str:
    return escape(text, quote=False)


def inline(runs: list[Run], bold: bool = True) -> str:
    out = []
    for r in runs:
        m = re.fullmatch(r"!\[(.*?)\]\((.*)\)", r.text) if r.literal else None
        text = f'<img src="{escape(m[2])}" alt="{escape(m[1])}"/>' if m else esc(r.text)
        for on, tag in ((r.code, "code"), (r.bold and bold, "strong"), (r.italic, "em"), (r.strike, "del")):
            text = f"<{tag}>{text}</{tag}>" if on else text
        out.append(f'<a href="{escape(r.href)}">{text}</a>' if r.href else text)
    return "".join(out)


def items(block: Block) -> str:
    ordered = bool(block.items) and block.items[0].ordered
    tag = "ol" if ordered else "ul"

    def one(i: Item) -> str:
        box = "" if i.checked is None else f'<input type="checkbox"{" checked=" + chr(34) + "checked" + chr(34) if i.checked else ""}/> '
        return f"<li>{box}{inline(i.runs)}{''.join(items(b) for b in i.lists)}</li>"

    return f"<{tag}>{''.join(map(one, block.items))}</{tag}>"


def chunk(b: Block) -> str:
    if b.kind == "heading":
        return f"<h{b.level}>{inline(b.runs, False)}</h{b.level}>"
    if b.kind == "quote":
        return f"<blockquote>{write(b.children)}</blockquote>"
    if b.kind == "pre":
        return f"<pre>{esc(b.text)}</pre>"
    if b.kind == "rule":
        return "<hr/>"
    if b.kind == "list":
        return items(b)
    if b.kind == "table":
        rows: dict[int, list[str]] = {}
        for c in b.cells:
            tag = "th" if c.header or c.row in b.header_rows else "td"
            spans = (f' colspan="{c.colspan}"' if c.colspan > 1 else "") + (f' rowspan="{c.rowspan}"' if c.rowspan > 1 else "")
            rows.setdefault(c.row, []).append(f"<{tag}{spans}>{'<br/>'.join(inline(x, tag == 'td') for x in c.blocks)}</{tag}>")
        caption = f"<caption>{inline(b.caption)}</caption>" if b.caption else ""
        return f"<table>{caption}{''.join('<tr>' + ''.join(rows[r]) + '</tr>' for r in sorted(rows))}</table>"
    return f"<p>{inline(b.runs)}</p>"


def write(blocks: list[Block]) -> str:
    return "\n".join(map(chunk, blocks))


def page(blocks: list[Block], title: str = "Document", xhtml: bool = False) -> str:
    body = write(blocks)
    if xhtml:
        return f'<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{esc(title)}</title></head><body>\n{body}\n</body></html>\n'
    return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{esc(title)}</title></head><body>\n{body}\n</body></html>\n'


def first_title(blocks: list[Block], title: str | None) -> str:
    return title or next((plain(b.runs) for b in blocks if b.kind == "heading" and b.level == 1), "") or "Document"


def sections(blocks: list[Block], level: int) -> list[list[Block]]:
    """Blocks split before each heading of the level or above."""
    out: list[list[Block]] = []
    for b in blocks:
        if not out or b.kind == "heading" and b.level <= level:
            out.append([])
        out[-1].append(b)
    return out


def epub(blocks: list[Block], title: str | None = None) -> bytes:
    """Chapters start at level-1 headings; the stored mimetype comes first."""
    name, chapters = first_title(blocks, title), sections(blocks, 1) or [[]]
    listed = [f"ch{i}.xhtml" for i in range(1, len(chapters) + 1)]
    heads = [first_title(c, None) for c in chapters]
    manifest = "".join(f'<item id="c{i}" href="{f}" media-type="application/xhtml+xml"/>' for i, f in enumerate(listed, 1))
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(1, len(listed) + 1))
    nav = "".join(f'<li><a href="{f}">{esc(h)}</a></li>' for f, h in zip(listed, heads))
    parts = [
        ("mimetype", "application/epub+zip"),
        ("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'),
        ("OEBPS/content.opf", f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:docframe:book</dc:identifier><dc:title>{esc(name)}</dc:title><dc:language>en</dc:language><meta property="dcterms:modified">1980-01-01T00:00:00Z</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{manifest}</manifest><spine>{spine}</spine></package>'),
        ("OEBPS/nav.xhtml", f'<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{esc(name)}</title></head><body><nav epub:type="toc"><ol>{nav}</ol></nav></body></html>'),
        *[(f"OEBPS/{f}", page(c, h, True)) for f, c, h in zip(listed, chapters, heads)],
    ]
    return pack(parts, stored=("mimetype",))


def flat(blocks: list[Block]) -> list[Block]:
    return [y for b in blocks for y in (flat(b.children) if b.kind == "quote" else [b])]


def lines_of(block: Block, depth: int = 0) -> list[tuple[int, Item]]:
    return [x for i in block.items for x in [(depth, i), *[y for sub in i.lists for y in lines_of(sub, depth + 1)]]]


def rtf_text(text: str) -> str:
    out = []
    for c in text:
        if c in "\\{}":
            out.append("\\" + c)
        elif c == "\n":
            out.append("\\line ")
        elif ord(c) < 128:
            out.append(c)
        else:
            units = c.encode("utf-16-le")
            out += [f"\\u{int.from_bytes(units[k : k + 2], 'little', signed=True)}?" for k in range(0, len(units), 2)]
    return "".join(out)


def rtf_runs(runs: list[Run], bold: bool = True) -> str:
    out = []
    for r in runs:
        text = rtf_text(plain([r]) if r.literal else r.text)
        marks = "".join(m for on, m in ((r.bold and bold, "\\b"), (r.italic, "\\i"), (r.strike, "\\strike")) if on)
        text = f"{{{marks} {text}}}" if marks else text
        out.append(f'{{\\field{{\\*\\fldinst HYPERLINK "{rtf_text(r.href)}"}}{{\\fldrslt {text}}}}}' if r.href else text)
    return "".join(out)


def rtf(blocks: list[Block]) -> str:
    from docframe.sinks.markdown import grid_of

    out = ["{\\rtf1\\ansi\\deff0{\\fonttbl{\\f0 Helvetica;}{\\f1 Courier;}}"]
    for b in flat(blocks):
        if b.kind == "heading":
            out.append(f"\\pard\\outlinelevel{b.level - 1}\\b {rtf_runs(b.runs, False)}\\b0\\par")
        elif b.kind == "pre":
            out.append(f"\\pard\\f1 {rtf_text(b.text.rstrip(chr(10)))}\\f0\\par")
        elif b.kind == "list":
            out += [f"\\pard\\li{360 * (d + 1)} {rtf_text(i.marker if i.ordered else '•')} {rtf_runs(i.runs)}\\par" for d, i in lines_of(b)]
        elif b.kind == "table":
            for row in grid_of(b, lambda c: " ".join(plain(x) for x in c.blocks)):
                out.append("\\trowd" + "".join(f"\\cellx{2000 * (k + 1)}" for k in range(len(row))) + "".join(f"\\pard\\intbl {rtf_text(v)}\\cell" for v in row) + "\\row")
        elif b.kind == "paragraph":
            out.append(f"\\pard {rtf_runs(b.runs)}\\par")
    return "\n".join(out) + "\n}"


def w_runs(runs: list[Run], links: list[str], bold: bool = True) -> str:
    out = []
    for r in runs:
        props = "".join(f"<w:{n}/>" for on, n in ((r.bold and bold, "b"), (r.italic, "i"), (r.strike, "strike")) if on)
        text = "".join(f'<w:t xml:space="preserve">{esc(t)}</w:t>' if k == 0 else f'<w:br/><w:t xml:space="preserve">{esc(t)}</w:t>' for k, t in enumerate((plain([r]) if r.literal else r.text).split("\n")))
        run = f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}{text}</w:r>"
        if r.href:
            links.append(r.href)
            run = f'<w:hyperlink r:id="rIdL{len(links)}">{run}</w:hyperlink>'
        out.append(run)
    return "".join(out)


def docx(blocks: list[Block]) -> bytes:
    links: list[str] = []
    body, numbers = [], []
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    for b in flat(blocks):
        if b.kind == "heading":
            body.append(f'<w:p><w:pPr><w:pStyle w:val="Heading{b.level}"/></w:pPr>{w_runs(b.runs, links, False)}</w:p>')
        elif b.kind == "pre":
            body += [f'<w:p><w:r><w:t xml:space="preserve">{esc(line)}</w:t></w:r></w:p>' for line in b.text.rstrip("\n").split("\n")]
        elif b.kind == "list":
            lines = lines_of(b)
            kinds = {d: i.ordered for d, i in reversed(lines)}
            numbers.append(kinds)
            body += [f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{min(d, 8)}"/><w:numId w:val="{len(numbers)}"/></w:numPr></w:pPr>{w_runs(i.runs, links)}</w:p>' for d, i in lines]
        elif b.kind == "table":
            body.append(w_table(b, links))
        elif b.kind == "paragraph":
            body.append(f"<w:p>{w_runs(b.runs, links)}</w:p>")
    levels = lambda kinds: "".join(f'<w:lvl w:ilvl="{d}"><w:start w:val="1"/><w:numFmt w:val="{"decimal" if kinds.get(d, False) else "bullet"}"/><w:lvlText w:val="{f"%{d + 1}." if kinds.get(d, False) else "•"}"/></w:lvl>' for d in range(9))
    numbering = "".join(f'<w:abstractNum w:abstractNumId="{i}">{levels(k)}</w:abstractNum>' for i, k in enumerate(numbers, 1)) + "".join(f'<w:num w:numId="{i}"><w:abstractNumId w:val="{i}"/></w:num>' for i in range(1, len(numbers) + 1))
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{n}"><w:name w:val="heading {n}"/><w:rPr><w:b/></w:rPr></w:style>' for n in range(1, 7))
    rels = "".join(f'<Relationship Id="rIdL{i}" Type="{OFFICE}/hyperlink" Target="{escape(u)}" TargetMode="External"/>' for i, u in enumerate(links, 1))
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    return pack([
        ("[Content_Types].xml", f'{HEAD}<Types xmlns="{NS}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{kind}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{kind}.styles+xml"/><Override PartName="/word/numbering.xml" ContentType="{kind}.numbering+xml"/></Types>'),
        ("_rels/.rels", f'{HEAD}<Relationships xmlns="{RELS}"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>'),
        ("word/document.xml", f'{HEAD}<w:document xmlns:w="{w}" xmlns:r="{OFFICE}"><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>'),
        ("word/_rels/document.xml.rels", f'{HEAD}<Relationships xmlns="{RELS}"><Relationship Id="rId1" Type="{OFFICE}/styles" Target="styles.xml"/><Relationship Id="rId2" Type="{OFFICE}/numbering" Target="numbering.xml"/>{rels}</Relationships>'),
        ("word/styles.xml", f'{HEAD}<w:styles xmlns:w="{w}">{styles}</w:styles>'),
        ("word/numbering.xml", f'{HEAD}<w:numbering xmlns:w="{w}">{numbering}</w:numbering>'),
    ])


def w_table(b: Block, links: list[str]) -> str:
    rows = max((c.row + c.rowspan for c in b.cells), default=0)
    at = {(c.row, c.col): c for c in b.cells}
    covered = {(r, c.col): c for c in b.cells for r in range(c.row + 1, c.row + c.rowspan)}
    out = []
    for r in range(rows):
        cells = []
        for (_, col), c in sorted({**{k: v for k, v in at.items() if k[0] == r}, **{k: v for k, v in covered.items() if k[0] == r}}.items()):
            start = (r, col) in at
            span = f'<w:gridSpan w:val="{c.colspan}"/>' if c.colspan > 1 else ""
            merge = ('<w:vMerge w:val="restart"/>' if start else "<w:vMerge/>") if c.rowspan > 1 else ""
            text = "".join(f"<w:p>{w_runs(x, links)}</w:p>" for x in c.blocks) if start else ""
            cells.append(f"<w:tc><w:tcPr>{span}{merge}</w:tcPr>{text or '<w:p/>'}</w:tc>")
        head = "<w:trPr><w:tblHeader/></w:trPr>" if r in b.header_rows else ""
        out.append(f"<w:tr>{head}{''.join(cells)}</w:tr>")
    return f"<w:tbl><w:tblPr/>{''.join(out)}</w:tbl>"


def pptx(blocks: list[Block]) -> bytes:
    """A slide starts at each heading of level 1 or 2."""
    from docframe.sinks.markdown import grid_of

    a, p = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    run = lambda r: f'<a:r><a:rPr{" b=" + chr(34) + "1" + chr(34) if r.bold else ""}{" i=" + chr(34) + "1" + chr(34) if r.italic else ""}/><a:t>{esc(plain([r]) if r.literal else r.text)}</a:t></a:r>'
    slides = []
    for section in sections(flat(blocks), 2) or [[]]:
        title, body, shapes = "", [], []
        for b in section:
            if b.kind == "heading" and b.level <= 2 and not title:
                title = f"<a:p>{''.join(map(run, b.runs))}</a:p>"
            elif b.kind == "list":
                body += [f'<a:p><a:pPr lvl="{min(d, 8)}"><a:buChar char="•"/></a:pPr>{"".join(map(run, i.runs))}</a:p>' for d, i in lines_of(b)]
            elif b.kind == "table":
                rows = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody><a:bodyPr/><a:p><a:r><a:t>{esc(v)}</a:t></a:r></a:p></a:txBody></a:tc>" for v in row) + "</a:tr>" for row in grid_of(b, lambda c: " ".join(plain(x) for x in c.blocks)))
                shapes.append(f'<p:graphicFrame><p:xfrm><a:off x="0" y="{3000000 + len(shapes)}"/></p:xfrm><a:graphic><a:graphicData><a:tbl>{rows}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>')
            elif b.kind in ("paragraph", "heading"):
                body.append(f"<a:p>{''.join(map(run, b.runs))}</a:p>")
            elif b.kind == "pre":
                body += [f"<a:p><a:r><a:t>{esc(x)}</a:t></a:r></a:p>" for x in b.text.rstrip("\n").split("\n")]
        shape = lambda kind, y, text: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:bodyPr/>{text}</p:txBody></p:sp>' if text else ""
        slides.append(f'{HEAD}<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree>{shape("title", 0, title)}{shape("body", 1000000, "".join(body))}{"".join(shapes)}</p:spTree></p:cSld></p:sld>')
    ids = "".join(f'<p:sldId id="{255 + i}" r:id="rId{i}"/>' for i in range(1, len(slides) + 1))
    rels = "".join(f'<Relationship Id="rId{i}" Type="{OFFICE}/slide" Target="slides/slide{i}.xml"/>' for i in range(1, len(slides) + 1))
    kind = "application/vnd.openxmlformats-officedocument.presentationml"
    types = "".join(f'<Override PartName="/ppt/slides/slide{i}.xml" ContentType="{kind}.slide+xml"/>' for i in range(1, len(slides) + 1))
    return pack([
        ("[Content_Types].xml", f'{HEAD}<Types xmlns="{NS}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/ppt/presentation.xml" ContentType="{kind}.presentation.main+xml"/>{types}</Types>'),
        ("_rels/.rels", f'{HEAD}<Relationships xmlns="{RELS}"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="ppt/presentation.xml"/></Relationships>'),
        ("ppt/presentation.xml", f'{HEAD}<p:presentation xmlns:p="{p}" xmlns:r="{OFFICE}"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>'),
        ("ppt/_rels/presentation.xml.rels", f'{HEAD}<Relationships xmlns="{RELS}">{rels}</Relationships>'),
        *[(f"ppt/slides/slide{i}.xml", s) for i, s in enumerate(slides, 1)],
    ])
