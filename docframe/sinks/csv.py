"""Tables to separated values."""

from __future__ import annotations

from docframe.operators.boxes import Block, plain
from docframe.sinks.markdown import body_blocks, grid_of


def quote(value: str, comma: str) -> str:
    if value and (comma in value or '"' in value or "\r" in value or "\n" in value or value[0].isspace() or value == "\\."):
        return '"' + value.replace('"', '""') + '"'
    return value


def tables_of(blocks: list[Block]) -> list[Block]:
    out = []
    for b in blocks:
        if b.kind == "table":
            out.append(b)
        out += tables_of(b.children)
    return out


def write(blocks: list[Block], comma: str = ",") -> str:
    """All tables in order, a blank line between them; spans repeat their text. Empty if there is none."""
    parts = []
    for t in tables_of(blocks):
        grid = grid_of(t, lambda c: " ".join(plain(b) for b in c.blocks))
        # a row of one empty field would read as no row
        parts.append("".join(comma.join(quote(v, comma) for v in row) + "\n" if row != [""] else '""\n' for row in grid))
    return "\n".join(parts)


def to_csv(source: str | None, comma: str = ",") -> str:
    return write(body_blocks(source), comma)


def counted(source: str | None) -> tuple[int, int]:
    """How many tables there are, and how many other blocks are left out (a quote that holds a table is none)."""
    blocks = body_blocks(source)
    return len(tables_of(blocks)), sum(not tables_of([b]) for b in blocks)
