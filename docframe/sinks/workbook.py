"""Tables to workbooks (XLSX)."""

from __future__ import annotations

import re
from html import escape
from itertools import count, groupby

from docframe.functions.sheet import general_number
from docframe.operators.boxes import Block, Cell, plain
from docframe.sinks.csv import tables_of
from docframe.sources.packages import pack

# Fixed values of the file format: namespaces, content types, signs that sheet names may not have and their length, the fills that come first
NS = "http://schemas.openxmlformats.org"
MAIN, RELS, OFFICE = f"{NS}/spreadsheetml/2006/main", f"{NS}/package/2006/relationships", f"{NS}/officeDocument/2006/relationships"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
DEFAULT_TYPES = {"rels": "application/vnd.openxmlformats-package.relationships+xml", "xml": "application/xml"}
SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
BARRED, NAME_BYTES = "[]:*?/\\", 31
OBLIGATORY_FILLS = ("none", "gray125")
CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
#: How cells look, by kind; the first is that of a cell without a style of its own.
LOOKS: dict[str, dict] = {"body": {"face": "Arial", "size": 10, "bold": False, "line": ""}, "head": {"face": "Arial", "size": 10, "bold": True, "line": "thin"}}
EMPTY_NAME = "Sheet1"


def sheet_names(captions: list[str]) -> list[str]:
    """Captions without the signs that names may not have, cut to NAME_BYTES bytes, told apart regardless of case by a number at their end."""

    def cut(text: str, room: int) -> str:
        return text.encode()[:room].decode("utf-8", "ignore").strip()

    out: list[str] = []
    used: set[str] = set()
    for place, caption in enumerate(captions, 1):
        plain_name = cut(caption.translate(dict.fromkeys(map(ord, BARRED), " ")).strip() or f"Table {place}", NAME_BYTES)
        candidates = (plain_name if n == 1 else cut(plain_name, NAME_BYTES - len(f" {n}")) + f" {n}" for n in count(1))
        name = next(c for c in candidates if c.lower() not in used)
        used.add(name.lower())
        out.append(name)
    return out


def clean_number(text: str) -> bool:
    """Whether a text is how its number is written: 007 and 1.50 stay texts."""
    if re.fullmatch(r"-?(0|[1-9]\d*)", text):
        return text != "-0" and -(2**63) <= int(text) < 2**63
    try:
        return general_number(float(text)) == text
    except (ValueError, OverflowError):
        return False


def column_name(col: int) -> str:
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def tag(name: str, /, *inner: str, **attrs: object) -> str:
    """An XML element; names with a colon are given with two underscores."""
    shown = "".join(f' {k.replace("__", ":")}="{escape(str(v))}"' for k, v in attrs.items())
    return f"<{name}{shown}>{''.join(inner)}</{name}>" if inner else f"<{name}{shown}/>"


def look_of(cell: Cell, table: Block) -> str:
    return "head" if cell.header or cell.row in table.header_rows else "body"


def cell_xml(cell: Cell, look: str) -> str:
    """A clean number as one, other text in place; an empty cell only where its look differs from the plain one."""
    text = " ".join(plain(b) for b in cell.blocks)
    attrs: dict[str, object] = {"r": f"{column_name(cell.col + 1)}{cell.row + 1}"} | ({"s": list(LOOKS).index(look)} if look != "body" else {})
    if clean_number(text):
        return tag("c", tag("v", text), **attrs)
    if not text:
        return ""
    shown = escape(CONTROL.sub("", text), quote=False)
    return tag("c", tag("is", f'<t xml:space="preserve">{shown}</t>'), **attrs, t="inlineStr")


def sheet_xml(table: Block | None) -> str:
    """A worksheet of a table: its cells row by row, then the ranges that spanning cells join."""
    cells = sorted(table.cells, key=lambda c: (c.row, c.col)) if table else []
    rows = [tag("row", *[cell_xml(c, look_of(c, table)) for c in own], r=r + 1) for r, own in groupby(cells, key=lambda c: c.row)]
    joined = [tag("mergeCell", ref=f"{column_name(c.col + 1)}{c.row + 1}:{column_name(c.col + c.colspan)}{c.row + c.rowspan}") for c in cells if (c.rowspan, c.colspan) != (1, 1)]
    return HEAD + tag("worksheet", tag("sheetData", *rows), *([tag("mergeCells", *joined, count=len(joined))] if joined else []), xmlns=MAIN)


def styles_xml() -> str:
    """The style sheet of LOOKS: a font, a fill and a border of its own for each look."""
    parts: dict[str, list[str]] = {"fonts": [], "fills": [tag("fill", tag("patternFill", patternType=p)) for p in OBLIGATORY_FILLS], "borders": [], "cellXfs": []}
    for look in LOOKS.values():
        parts["fonts"].append(tag("font", *([tag("b")] if look["bold"] else []), tag("sz", val=look["size"]), tag("name", val=look["face"])))
        parts["borders"].append(tag("border", tag("left"), tag("right"), tag("top"), tag("bottom", style=look["line"]) if look["line"] else tag("bottom"), tag("diagonal")))
        number = len(parts["cellXfs"])
        parts["cellXfs"].append(tag("xf", numFmtId=0, fontId=number, fillId=0, borderId=number, xfId=0, applyFont=1, applyBorder=1))
    own = [tag(name, *inner, count=len(inner)) for name, inner in parts.items()]
    own.insert(3, tag("cellStyleXfs", tag("xf", numFmtId=0, fontId=0, fillId=0, borderId=0), count=1))
    return HEAD + tag("styleSheet", *own, xmlns=MAIN)


def relations(targets: list[tuple[str, str]]) -> str:
    return HEAD + tag("Relationships", *[tag("Relationship", Id=f"rId{n}", Type=f"{OFFICE}/{kind}", Target=to) for n, (kind, to) in enumerate(targets, 1)], xmlns=RELS)


def write(blocks: list[Block]) -> bytes:
    """A sheet for each table; one empty sheet if there is none."""
    tables: list[Block | None] = [*tables_of(blocks)] or [None]
    names = sheet_names([plain(t.caption) for t in tables if t]) or [EMPTY_NAME]
    sheets = {f"worksheets/sheet{n}.xml": sheet_xml(t) for n, t in enumerate(tables, 1)}
    kinds = {"workbook.xml": "sheet.main", "styles.xml": "styles"} | dict.fromkeys(sheets, "worksheet")
    types = [tag("Default", Extension=e, ContentType=t) for e, t in DEFAULT_TYPES.items()] + [tag("Override", PartName=f"/xl/{part}", ContentType=f"{SHEET_TYPE}.{kind}+xml") for part, kind in kinds.items()]
    listed = [tag("sheet", name=name, sheetId=n, r__id=f"rId{n}") for n, name in enumerate(names, 1)]
    parts = {
        "[Content_Types].xml": HEAD + tag("Types", *types, xmlns=f"{NS}/package/2006/content-types"),
        "_rels/.rels": relations([("officeDocument", "xl/workbook.xml")]),
        "xl/workbook.xml": HEAD + tag("workbook", tag("sheets", *listed), xmlns=MAIN, xmlns__r=OFFICE),
        "xl/_rels/workbook.xml.rels": relations([*[("worksheet", part) for part in sheets], ("styles", "styles.xml")]),
        "xl/styles.xml": styles_xml(),
    }
    return pack([*parts.items(), *[(f"xl/{part}", xml) for part, xml in sheets.items()]])
