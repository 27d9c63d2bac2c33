"""Blocks to page descriptions (PDF): one column of text in the standard faces, tables ruled."""

from __future__ import annotations

import zlib

from docframe.operators.boxes import Block, Run, plain
from docframe.sinks.html import flat, lines_of
from docframe.sinks.markdown import grid_of
from docframe.sources.pdf import STANDARD_WIDTHS

# Page, margin and sizes in points
WIDTH, HEIGHT, MARGIN, BODY = 612.0, 792.0, 54.0, 11.0
SIZES = {1: 24.0, 2: 18.0, 3: 15.5, 4: 13.8, 5: 12.8, 6: 12.7}
FACES = {(False, False): "F1", (True, False): "F2", (False, True): "F3", (True, True): "F4"}
NAMES = ("Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique")


def width(text: str, size: float) -> float:
    return sum(STANDARD_WIDTHS[ord(c) - 32] if 32 <= ord(c) < 127 else 556 for c in text) * size / 1000


def string(text: str) -> bytes:
    return b"(" + text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


class Writer:
    def __init__(self) -> None:
        self.pages: list[list[bytes]] = [[]]
        self.y = MARGIN

    def room(self, height: float) -> None:
        if self.y + height > HEIGHT - MARGIN and self.pages[-1]:
            self.pages.append([])
            self.y = MARGIN

    def put(self, x: float, text: str, size: float, face: str) -> None:
        self.pages[-1].append(b"BT /%s %.2f Tf %.2f %.2f Td %s Tj ET" % (face.encode(), size, x, HEIGHT - self.y - size, string(text)))

    def line(self, x0: float, y0: float, x1: float, y1: float) -> None:
        self.pages[-1].append(b"0.5 w %.2f %.2f m %.2f %.2f l S" % (x0, HEIGHT - y0, x1, HEIGHT - y1))

    def flow(self, runs: list[Run], size: float, bold: bool = False, indent: float = 0.0, lead: str = "") -> None:
        """Words in lines by first fit; a word that is too long stays whole."""
        words = [(w, FACES[r.bold or bold, r.italic]) for r in runs for w in (plain([r]) if r.literal else r.text).split()]
        x, start = MARGIN + indent, True
        self.room(size * 1.3)
        if lead:
            self.put(x - width(lead + " ", size), lead, size, "F1")
        for word, face in words:
            w = width(word, size)
            if not start and x + w > WIDTH - MARGIN:
                self.y += size * 1.3
                self.room(size * 1.3)
                x = MARGIN + indent
            self.put(x, word, size, face)
            x += w + width(" ", size)
            start = False
        self.y += size * 1.3

    def table(self, rows: list[list[str]], heads: set[int]) -> None:
        cols = len(rows[0])
        step = (WIDTH - 2 * MARGIN) / cols
        height = BODY * 1.8
        top = None
        for r, row in enumerate(rows):
            before = len(self.pages)
            self.room(height)
            if top is None or len(self.pages) != before:
                self.line(MARGIN, self.y, WIDTH - MARGIN, self.y)
            top = self.y
            self.y += BODY * 0.4
            for c, text in enumerate(row):
                self.put(MARGIN + c * step + 4, text, BODY, "F2" if r in heads else "F1")
            self.y = top + height
            self.line(MARGIN, self.y, WIDTH - MARGIN, self.y)
            for c in range(cols + 1):
                self.line(MARGIN + c * step, top, MARGIN + c * step, self.y)


def write(blocks: list[Block]) -> bytes:
    w = Writer()
    for b in flat(blocks):
        if b.kind == "heading":
            w.flow(b.runs, SIZES[b.level], True)
        elif b.kind == "list":
            for depth, item in lines_of(b):
                w.flow(item.runs, BODY, indent=24.0 * (depth + 1), lead=item.marker if item.ordered else "•")
        elif b.kind == "table":
            rows = grid_of(b, lambda c: " ".join(plain(x) for x in c.blocks))
            if rows:
                w.table(rows, b.header_rows)
        elif b.kind == "pre":
            for text in b.text.rstrip("\n").split("\n"):
                w.room(BODY * 1.3)
                w.put(MARGIN, text, BODY, "F1")
                w.y += BODY * 1.3
        elif b.kind == "rule":
            w.line(MARGIN, w.y, WIDTH - MARGIN, w.y)
        else:
            w.flow(b.runs, BODY)
        w.y += BODY
    count = len(w.pages)
    kids = b" ".join(b"%d 0 R" % (7 + 2 * i) for i in range(count))
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (count, kids)]
    bodies += [b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding /BaseFont /%s >>" % n.encode() for n in NAMES]
    for i, ops in enumerate(w.pages):
        data = zlib.compress(b"\n".join(ops))
        bodies.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Contents %d 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R /F3 5 0 R /F4 6 0 R >> >> >>" % (WIDTH, HEIGHT, 8 + 2 * i))
        bodies.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(data), data))
    out, places = bytearray(b"%PDF-1.7\n"), []
    for i, body in enumerate(bodies, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, table, len(bodies) + 1, start)
    return bytes(out)
