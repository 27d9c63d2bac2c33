"""Small files of the readable formats as other programs write them: other prefixes, split runs, odd folders, marks that readers must pass over."""

from __future__ import annotations

import html

from docframe.sources.packages import pack


def esc(text: str) -> str:
    return html.escape(text, quote=False)


def halves(text: str) -> tuple[str, str]:
    return text[: len(text) // 2], text[len(text) // 2 :]


def docx(parts: list[str]) -> bytes:
    """Runs split within words, proofing marks, a deletion, bookmarks, another prefix and part name."""
    body = []
    for n, text in enumerate(parts):
        a, b = halves(text)
        runs = f'<x:proofErr x:type="spellStart"/><x:r><x:t xml:space="preserve">{esc(a)}</x:t></x:r><x:del x:id="{n}"><x:r><x:delText>gone</x:delText></x:r></x:del><x:ins x:id="{n}9"><x:r><x:rPr><x:lang x:val="de"/></x:rPr><x:t xml:space="preserve">{esc(b)}</x:t></x:r></x:ins>'
        body.append(f'<x:p><x:pPr><x:spacing x:after="9"/></x:pPr><x:bookmarkStart x:id="{n}" x:name="b{n}"/>{runs}<x:bookmarkEnd x:id="{n}"/></x:p>')
    main = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
    return pack([
        ("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="main" Type="{office}" Target="/word/document.xml"/></Relationships>'),
        ("word/document.xml", f'<x:document xmlns:x="{main}"><x:body>{"".join(body)}<x:sectPr/></x:body></x:document>'),
    ])


def pptx(parts: list[str]) -> bytes:
    """A slide a paragraph, in a text box whose place comes last in the file; a hidden slide."""
    a, p, r = (f"http://schemas.openxmlformats.org/{x}" for x in ("drawingml/2006/main", "presentationml/2006/main", "officeDocument/2006/relationships"))
    names = f'xmlns:a="{a}" xmlns:p="{p}" xmlns:r="{r}"'
    slide = lambda text, more="": f'<p:sld {names}{more}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="9" y="9"/></a:xfrm></p:spPr><p:txBody><a:bodyPr/><a:p>{"".join(f"<a:r><a:rPr/><a:t>{esc(h)}</a:t></a:r>" for h in halves(text))}</a:p><a:p/></p:txBody></p:sp></p:spTree></p:cSld></p:sld>'
    slides = [slide(t) for t in parts] + [slide("hidden", ' show="0"')]
    types = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rels = "".join(f'<Relationship Id="x{n}" Type="{types}/slide" Target="./slides/s{n}.xml"/>' for n in range(len(slides)))
    listed = "".join(f'<p:sldId id="{300 + n}" r:id="x{n}"/>' for n in range(len(slides)))
    wrap = lambda inner: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'
    return pack([
        ("_rels/.rels", wrap(f'<Relationship Id="a" Type="{types}/officeDocument" Target="ppt/presentation.xml"/>')),
        ("ppt/presentation.xml", f"<p:presentation {names}><p:sldIdLst>{listed}</p:sldIdLst></p:presentation>"),
        ("ppt/_rels/presentation.xml.rels", wrap(rels)),
        *[(f"ppt/slides/s{n}.xml", s) for n, s in enumerate(slides)],
    ])


def rtf(parts: list[str]) -> bytes:
    """Letters as Unicode words with a stand-in, groups for formats, lines broken anywhere, tables of fonts and a picture to pass over."""
    out = ["{\\rtf1\\ansi\\uc1{\\fonttbl{\\f0 Some Face;}}{\\*\\generator Other;}{\\info{\\title none}}{\\pict 00ff}\r\n"]
    for text in parts:
        a, b = halves(text)
        out.append(f"\\pard\\plain{{\\rsid1 {a}}}\r\n" + "".join(f"\\u{ord(c)}?" for c in b[:3]) + b[3:] + "\\par\r\n")
    return ("".join(out) + "}").encode("cp1252", "replace")


def epub(parts: list[str]) -> bytes:
    """A chapter a paragraph in a folder of its own, names with blanks, the spine in order; one chapter off the line."""
    names = [f"part {n}.xhtml" for n in range(len(parts))]
    items = "".join(f'<item id="c{n}" href="text/{name.replace(" ", "%20")}" media-type="application/xhtml+xml"/>' for n, name in enumerate([*names, "extra.xhtml"]))
    spine = "".join(f'<itemref idref="c{n}"/>' for n in range(len(parts))) + f'<itemref idref="c{len(parts)}" linear="no"/>'
    page = lambda text: f'<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>t</title></head><body class="x"><div><span>{esc(text)}</span></div></body></html>'
    return pack([
        ("mimetype", "application/epub+zip"),
        ("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book/own.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'),
        ("book/own.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine>{spine}</spine></package>'),
        *[(f"book/text/{name}", page(text)) for name, text in zip(names, parts)],
        ("book/text/extra.xhtml", page("off the line")),
    ], stored=("mimetype",))


def markdown(parts: list[str]) -> bytes:
    return ("\ufeff" + "\r\n\r\n\r\n".join(f"   {a}\\\r\n{b}".replace("\\\r\n", "") for a, b in map(halves, parts)) + "\r\n").encode()


def page(parts: list[str]) -> bytes:
    """Tags in capitals, paragraphs left open, comments, a hidden one, a script."""
    return ("<HTML><BODY><!-- a > b --><SCRIPT>if (a < b) x('</p>')</SCRIPT>" + "".join(f"<P CLASS=a>{esc(a)}<!-- -->{esc(b)}\n" for a, b in map(halves, parts)) + "<P HIDDEN>gone</BODY>").encode()


def xlsx(lines: list[str]) -> bytes:
    """Rows of tab-separated fields: a number, a shared string, a date by a format of its own, a truth value, a per cent."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    strings: dict[str, int] = {}
    rows = []
    for n, line in enumerate(lines, 2):
        key, text, day, flag, share = line.split("\t")
        at = strings.setdefault(text, len(strings))
        rows.append(f'<row r="{n}"><c r="A{n}"><v>{key}</v></c><c r="B{n}" t="s"><v>{at}</v></c><c r="C{n}" s="1"><v>{day}</v></c><c r="D{n}" t="b"><v>{flag}</v></c><c r="E{n}" s="2"><v>{share}</v></c></row>')
    shared = "".join(f"<si><r><t>{esc(a)}</t></r><r><rPr><b/></rPr><t xml:space='preserve'>{esc(b)}</t></r><rPh sb='0' eb='1'><t>x</t></rPh></si>" for a, b in map(halves, strings))
    wrap = lambda inner: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'
    kinds = {"worksheet": ["worksheets/one.xml", "worksheets/two.xml"], "sharedStrings": ["strings.xml"], "styles": ["/xl/looks.xml"]}
    targets = [(k, t) for k, own in kinds.items() for t in own]
    return pack([
        ("_rels/.rels", wrap(f'<Relationship Id="w" Type="{rel}/officeDocument" Target="xl/workbook.xml"/>')),
        ("xl/workbook.xml", f'<s:workbook xmlns:s="{main}" xmlns:q="{rel}"><s:sheets><s:sheet name="Orders" sheetId="4" q:id="k0"/><s:sheet name="Old" sheetId="2" state="hidden" q:id="k1"/></s:sheets></s:workbook>'),
        ("xl/_rels/workbook.xml.rels", wrap("".join(f'<Relationship Id="k{n}" Type="{rel}/{k}" Target="{t}"/>' for n, (k, t) in enumerate(targets)))),
        ("xl/strings.xml", f'<sst xmlns="{main}">{shared}</sst>'),
        ("xl/looks.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="d\\-mmm\\-yyyy;@"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="9"/></cellXfs></styleSheet>'),
        ("xl/worksheets/one.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(rows)}</sheetData></worksheet>'),
        ("xl/worksheets/two.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData></worksheet>'),
    ])


def pdf(parts: list[str]) -> bytes:
    """Pages of 612 x 792 of twenty paragraphs each: kerned strings, a plain cross-reference table, no compression. Long paragraphs run off the page's side."""
    text = lambda t: t.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    pages = [parts[k : k + 20] for k in range(0, len(parts), 20)] or [[]]
    kids = b" ".join(b"%d 0 R" % (4 + 2 * n) for n in range(len(pages)))
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[%s]/Count %d/MediaBox[0 0 612 792]/Resources<</Font<</Own 3 0 R>>>>>>" % (kids, len(pages)), b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"]
    for n, own in enumerate(pages):
        shown = [b"1 0 0 1 36 %d Tm [(%s) -3 (%s)] TJ" % (740 - 34 * k, *map(text, halves(t))) for k, t in enumerate(own)]
        body = b"BT /Own 10 Tf " + b"\n".join(shown) + b" ET"
        objects += [b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (5 + 2 * n), b"<</Length %d>>stream\r\n%s\nendstream" % (len(body), body)]
    out, at = bytearray(b"%PDF-1.3\n%\xe2\xe3\n"), []
    for n, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
    out += b"trailer <</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, start)
    return bytes(out)


MAKERS = {"docx": docx, "pptx": pptx, "rtf": rtf, "epub": epub, "markdown": markdown, "html": page, "xlsx": xlsx, "pdf": pdf}
