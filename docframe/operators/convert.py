"""Any readable format to any writable one, document by document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docframe.functions.formats import FORMATS
from docframe.operators import page_blocks
from docframe.operators.boxes import Block
from docframe.sinks import csv, html, markdown, pdf, workbook
from docframe.sources import office, text

#: Formats whose content has a block structure that this engine reads and writes.
READ = ("html", "markdown", "text", "csv", "tsv", "xlsx", "rtf", "docx", "pptx", "epub", "pdf")
WRITE = READ


def can_convert(source: str | None, target: str | None) -> str:
    """ok, or why not: unknown (source, then target), input, output, same."""
    if source not in FORMATS or target not in FORMATS:
        return "unknown"
    return "input" if not FORMATS[source][3] else "output" if not FORMATS[target][4] else "same" if source == target else "ok"


def to_html(source: str, data: bytes) -> str:
    if source == "html":
        return data.decode("utf-8", "replace")
    if source == "markdown":
        return text.markdown_to_html(text.decode(data))
    if source == "text":
        return text.text_to_html(data)
    if source in ("csv", "tsv"):
        return text.separated_to_html(data, "," if source == "csv" else "\t")
    if source == "xlsx":
        return workbook_to_html(data)
    return {"rtf": office.rtf_to_html, "docx": office.docx_to_html, "pptx": office.pptx_to_html, "epub": office.epub_to_html, "pdf": page_blocks.pdf_to_html}[source](data)


def workbook_to_html(data: bytes) -> str:
    """A captioned table for each visible sheet; cells as their raw text."""
    from docframe.functions.sheet import general_number
    from docframe.sources.workbook import cells_of, merges_of, number_of

    sheets: dict[int, tuple[str, dict]] = {}
    import re

    for number, name, hidden, _, ref, t, raw, _, _, _, shared, bold, _ in cells_of(data):
        m = re.fullmatch(r"([A-Z]+)(\d+)", ref or "")
        if hidden or not m:
            continue
        if t == "s":
            shown = shared or ""
        elif t == "b":
            shown = "TRUE" if raw == "1" else "FALSE"
        elif t in ("str", "inlineStr", "e") or not raw:
            shown = raw or ""
        else:
            try:
                shown = general_number(float(raw))
            except ValueError:
                shown = raw
        sheets.setdefault(number, (name, {}))[1][int(m[2]) - 1, number_of(m[1]) - 1] = (shown, bold)
    merged = list(merges_of(data))
    out = []
    for number, (name, cells) in sorted(sheets.items()):
        spans = {(r0, c0): (r1 - r0 + 1, c1 - c0 + 1) for s, r0, c0, r1, c1 in merged if s == number}
        covered = {(r, c) for (r0, c0), (h, w) in spans.items() for r in range(r0, r0 + h) for c in range(c0, c0 + w)} - set(spans)
        height, width = max(r for r, _ in cells) + 1, max(c for _, c in cells) + 1
        rows = []
        for r in range(height):
            row = []
            for c in range(width):
                if (r, c) not in covered:
                    shown, bold = cells.get((r, c), ("", False))
                    h, w = spans.get((r, c), (1, 1))
                    row.append(f'<td rowspan="{h}" colspan="{w}">{"<b>" if bold else ""}{office.esc(shown)}{"</b>" if bold else ""}</td>')
            rows.append(f"<tr>{''.join(row)}</tr>")
        out.append(f"<table><caption>{office.esc(name)}</caption>{''.join(rows)}</table>")
    return "\n".join(out)


def from_blocks(target: str, blocks: list[Block]) -> bytes:
    return {
        "html": lambda: html.page(blocks, html.first_title(blocks, None)).encode(), "markdown": lambda: markdown.write(blocks).encode(), "text": lambda: markdown.write(blocks, True).encode(),
        "csv": lambda: csv.write(blocks, ",").encode(), "tsv": lambda: csv.write(blocks, "\t").encode(), "xlsx": lambda: workbook.write(blocks), "rtf": lambda: html.rtf(blocks).encode(),
        "docx": lambda: html.docx(blocks), "pptx": lambda: html.pptx(blocks), "epub": lambda: html.epub(blocks), "pdf": lambda: pdf.write(blocks),
    }[target]()


def convert_one(source: str | None, target: str, data: bytes) -> tuple[bytes | None, str | None]:
    """(output, error)."""
    verdict = can_convert(source, target)
    if verdict != "ok":
        return None, {"unknown": "unknown document format", "same": "source and target are the same format"}.get(verdict, "unsupported format")
    if source not in READ or target not in WRITE:
        return None, "unsupported format"
    try:
        return from_blocks(target, markdown.body_blocks(to_html(source, data))), None
    except Exception as e:  # noqa: BLE001  the document is named, the others go on
        return None, f"{type(e).__name__}: {e}"


def convert(docs: DataFrame, target: str, id_col: str = "doc_id", content_col: str = "content", format_col: str = "format") -> DataFrame:
    """(id_col, output BINARY, error) for each document (content BINARY, format STRING). One failure does not stop the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [convert_one(f, target, c or b"") for c, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o for o, _ in out], pa.binary()), pa.array([e for _, e in out], pa.string())], ["id", "output", "error"])

    own = docs.select(id_col, content_col, format_col)
    return own.mapInArrow(run, f"id {own.schema[0].dataType.simpleString()}, output binary, error string").toDF(id_col, "output", "error")
