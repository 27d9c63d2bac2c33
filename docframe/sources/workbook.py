"""Workbooks (XLSX): cells as rows, joined to shared strings, formats and merges by DataFrame functions."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.functions import sheet as S
from docframe.sources.packages import parts_of, per_document

CELL_FIELDS = [
    ("sheet", pa.int32(), "int"), ("name", pa.string(), "string"), ("hidden", pa.bool_(), "boolean"), ("seq", pa.int32(), "int"), ("ref", pa.string(), "string"), ("t", pa.string(), "string"),
    ("v", pa.string(), "string"), ("f", pa.string(), "string"), ("si", pa.int32(), "int"), ("code", pa.string(), "string"), ("shared", pa.string(), "string"), ("bold", pa.bool_(), "boolean"), ("date1904", pa.bool_(), "boolean"),
]
MERGE_FIELDS = [("sheet", pa.int32(), "int"), ("r0", pa.int32(), "int"), ("c0", pa.int32(), "int"), ("r1", pa.int32(), "int"), ("c1", pa.int32(), "int")]


def tree(data: bytes | None) -> ET.Element:
    """A part without its namespaces."""
    root = ET.fromstring(data) if data else ET.Element("none")
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
        e.attrib = {k.rpartition("}")[2]: v for k, v in e.attrib.items()}
    return root


def relations(parts: dict[str, bytes], part: str) -> dict[str, tuple[str, str]]:
    """Relation id -> (last word of its type, target part) of a part."""
    folder, _, name = part.rpartition("/")
    out = {}
    for r in tree(parts.get(f"{folder}/_rels/{name}.rels".lstrip("/"))).iter("Relationship"):
        target = r.get("Target", "")
        if r.get("TargetMode") != "External":
            base = [] if target.startswith("/") else folder.split("/") if folder else []
            for step in target.strip("/").split("/"):
                base = base[:-1] if step == ".." else base if step == "." else [*base, step]
            target = "/".join(base)
        out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], target)
    return out


def text_of(e: ET.Element) -> str:
    """All t elements, but those of phonetic runs."""
    own = [] if e.tag == "rPh" else [e.text or ""] if e.tag == "t" else []
    return "".join(own + [text_of(c) for c in e if c.tag != "rPh"])


def book_of(parts: dict[str, bytes]) -> tuple[list[tuple[str, bool, bytes]], list[str], list[tuple[str, bool]], bool]:
    """(sheets: name, hidden, part), shared strings, styles by xf (format code, bold), 1904 dates."""
    rels = relations(parts, "xl/workbook.xml")
    book = tree(parts["xl/workbook.xml"])
    strings = [text_of(si) for si in tree(next((parts.get(t) for k, t in rels.values() if k == "sharedStrings"), None)).iter("si")]
    style = tree(next((parts.get(t) for k, t in rels.values() if k == "styles"), None))
    own = {int(n.get("numFmtId", 0)): n.get("formatCode", "") for n in style.iter("numFmt")}
    fonts = [f.find("b") is not None and f.find("b").get("val", "1") not in ("0", "false") for p in style.findall("fonts") for f in p.findall("font")]
    xfs = []
    for xf in style.iterfind("cellXfs/xf"):
        number, font = int(xf.get("numFmtId", 0)), int(xf.get("fontId", 0))
        xfs.append((own.get(number, S.BUILTIN_FORMATS.get(number, "")), font < len(fonts) and fonts[font]))
    pr = book.find("workbookPr")
    date1904 = pr is not None and pr.get("date1904", "0") in ("1", "true")
    sheets = [(s.get("name", ""), s.get("state", "visible") != "visible", parts.get(rels.get(s.get("id", ""), ("", ""))[1])) for s in book.iterfind("sheets/sheet")]
    return sheets, strings, xfs, date1904


def cells_of(content: bytes) -> Iterator[tuple]:
    sheets, strings, xfs, date1904 = book_of(parts_of(content))
    for number, (name, hidden, part) in enumerate(sheets):
        for seq, c in enumerate(tree(part).iterfind("sheetData/row/c")):
            v, f = c.find("v"), c.find("f")
            t = c.get("t", "n")
            raw = text_of(c.find("is")) if t == "inlineStr" and c.find("is") is not None else (v.text or "") if v is not None else None
            at = int(raw) if t == "s" and raw and raw.strip().isdigit() else -1
            xf = int(c.get("s", 0))
            code, bold = xfs[xf] if xf < len(xfs) else ("", False)
            yield (
                number, name, hidden, seq, c.get("r"), t, raw, f.text if f is not None else None, int(f.get("si")) if f is not None and f.get("t") == "shared" and f.get("si") else None,
                code, strings[at] if 0 <= at < len(strings) else None, bold, date1904,
            )


def merges_of(content: bytes) -> Iterator[tuple]:
    sheets, *_ = book_of(parts_of(content))
    for number, (_, _, part) in enumerate(sheets):
        for m in tree(part).iterfind("mergeCells/mergeCell"):
            got = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)(?::\$?([A-Z]+)\$?(\d+))?", m.get("ref", ""))
            if got:
                a, b = number_of(got[1]), number_of(got[3] or got[1])
                rows = sorted((int(got[2]) - 1, int(got[4] or got[2]) - 1))
                yield number, rows[0], min(a, b) - 1, rows[1], max(a, b) - 1


def number_of(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def raw_cells(docs: DataFrame, id_col: str, content_col: str) -> DataFrame:
    return per_document(docs, id_col, content_col, cells_of, CELL_FIELDS)


def merges(docs: DataFrame, id_col: str, content_col: str) -> DataFrame:
    return per_document(docs, id_col, content_col, merges_of, MERGE_FIELDS)


def display(kind: Column, raw: Column, shared: Column, code: Column, date1904: Column) -> Column:
    return (
        F.when(kind == "s", F.coalesce(shared, F.lit("")))
        .when(kind == "b", F.when(raw == "1", "TRUE").otherwise("FALSE"))
        .when(kind.isin("str", "inlineStr", "e") | raw.isNull(), F.coalesce(raw, F.lit("")))
        .otherwise(S.format_number(raw, code, date1904))
    )


def cells(raw: DataFrame) -> DataFrame:
    """raw and row, col (from 0), text, value (typed), formula: a member of a shared formula takes the first text of its group, moved to its place."""
    at = raw.where("error is null").withColumn("_at", S.parse_part_ref(F.col("ref"))).where("_at.row >= 0")
    own = at.withColumn("row", F.col("_at.row").cast("int")).withColumn("col", F.col("_at.col").cast("int")).drop("_at")
    kind, shown, none = F.col("t"), F.col("shared"), F.coalesce("code", F.lit(""))
    own = own.withColumn("text", display(kind, F.col("v"), shown, none, F.col("date1904"))).withColumn("value", S.typed_value(kind, F.col("v"), shown, none, F.col("date1904")))
    w = Window.partitionBy("doc_id", "sheet", "si")
    first = F.min_by(F.struct("row", "col", "f"), F.when(F.col("f") != "", F.col("seq"))).over(w)
    own = own.withColumn("_first", F.when(F.col("si").isNotNull(), first))
    moved = S.shifted(F.col("_first.f"), F.col("row") - F.col("_first.row"), F.col("col") - F.col("_first.col"))
    return own.withColumn("formula", F.coalesce(F.when(F.col("f") != "", F.col("f")), moved)).drop("_first")


def select_sheets(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Visible sheets in order; or the named ones in the order asked for, hidden or not (a name that is not there is an error)."""
    if not names:
        return rows.where("not hidden").withColumn("position", F.col("sheet"))
    return rows.where(F.col("name").isin(*names)).withColumn("position", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name")).cast("int") - 1)


def sheet_grid(cell_rows: DataFrame, merge_rows: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, col, rowspan, colspan, header, text): merged cells span, what they cover is left out."""
    own = cell_rows.select("doc_id", "sheet", F.col("row").alias("r"), F.col("col").alias("c"), "text", "bold")
    from docframe.operators.rules import uncovered

    kept = uncovered(own, merge_rows).join(merge_rows.select("doc_id", "sheet", F.col("r0").alias("r"), F.col("c0").alias("c"), "r1", "c1"), ["doc_id", "sheet", "r", "c"], "left")
    return kept.select(
        "doc_id", F.col("sheet").cast("long").alias("table_id"), F.col("r").alias("row"), F.col("c").alias("col"), F.coalesce(F.col("r1") - F.col("r") + 1, F.lit(1)).alias("rowspan"),
        F.coalesce(F.col("c1") - F.col("c") + 1, F.lit(1)).alias("colspan"), F.col("bold").alias("header"), "text",
    )
