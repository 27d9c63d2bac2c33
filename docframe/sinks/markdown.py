"""Blocks to Markdown and to plain text."""

from __future__ import annotations

import re

from docframe.operators.boxes import Block, Item, Run, blocks_of, plain
from docframe.sources.html import Element, parse


def escape(text: str) -> str:
    return re.sub(r"([\\`*_\[\]])", r"\\\1", text)


def escape_url(url: str) -> str:
    return url.replace(" ", "%20").replace("(", "%28").replace(")", "%29")


def inline(runs: list[Run], bare: bool = False, no_bold: bool = False) -> str:
    """Runs with their marks: code, bold, italic, strike, link, from within; white space at a run's ends stays outside."""
    if bare:
        return "".join(re.sub(r"^!\[(.*?)\]\(.*\)$", r"\1", r.text) if r.literal else r.text for r in runs)
    out = []
    for r in runs:
        if r.literal:
            m = re.fullmatch(r"!\[(.*?)\]\((.*)\)", r.text)
            text, lead, tail = f"![{escape(m[1])}]({escape_url(m[2])})" if m else escape(r.text), "", ""
        else:
            core = r.text.strip(" ")
            if not core:
                out.append(r.text)
                continue
            lead, tail = r.text[: len(r.text) - len(r.text.lstrip(" "))], r.text[len(r.text.rstrip(" ")) :]
            text = f"`{core}`" if r.code else escape(core)
        for on, mark in ((r.bold and not no_bold, "**"), (r.italic, "_"), (r.strike, "~~")):
            if on:
                text = f"{mark}{text}{mark}"
        if r.href:
            text = f"[{text}]({escape_url(r.href)})"
        out.append(lead + text + tail)
    return "".join(out)


def item_lines(item: Item, depth: int, bare: bool) -> list[str]:
    text = inline(item.runs, bare)
    box = "" if item.checked is None or bare else ("[x] " if item.checked else "[ ] ")
    lines = ["  " * depth + f"{item.marker} {box}{text}".rstrip()] if item.marker else []
    for sub in item.lists:
        lines += [line for i in sub.items for line in item_lines(i, depth + 1, bare)]
    return lines


def grid_of(block: Block, text_of) -> list[list[str]]:
    rows = max((c.row + c.rowspan for c in block.cells), default=0)
    cols = max((c.col + c.colspan for c in block.cells), default=0)
    grid = [[""] * cols for _ in range(rows)]
    for c in block.cells:
        text = text_of(c)
        for r in range(c.row, c.row + c.rowspan):
            for k in range(c.col, c.col + c.colspan):
                grid[r][k] = text
    return grid


def table(block: Block, bare: bool) -> str:
    """A table as a pipe table (its first row is the header), or padded columns."""
    if bare:
        grid = grid_of(block, lambda c: " ".join(inline(b, True) for b in c.blocks))
        widths = [max(len(row[k].encode()) for row in grid) for k in range(len(grid[0]))] if grid else []
        lines = ["  ".join(cell + " " * (w - len(cell.encode())) for cell, w in zip(row, widths)) for row in grid]
        body = "\n".join(lines).rstrip()
        return "\n\n".join(x for x in (inline(block.caption, True), body) if x)
    heads = {(c.row, c.col): c for c in block.cells}
    grid = grid_of(block, lambda c: " <br> ".join(inline(b, no_bold=c.header) for b in c.blocks).replace("|", "\\|"))
    if not grid:
        return ""
    marks = {"left": ":---", "center": ":---:", "right": "---:"}
    line = lambda cells: "| " + " | ".join(cells) + " |"
    aligned = [marks.get(heads[0, k].align if (0, k) in heads and 0 in block.header_rows else "", "---") for k in range(len(grid[0]))]
    caption = f"**{inline(block.caption, no_bold=True)}**" if block.caption else ""
    return "\n\n".join(x for x in (caption, "\n".join([line(grid[0]), line(aligned), *map(line, grid[1:])])) if x)


def chunk(block: Block, bare: bool) -> str:
    if block.kind == "heading":
        text = inline(block.runs, bare, no_bold=True)
        return text if bare else "#" * block.level + " " + text
    if block.kind == "quote":
        inner = write(block.children, bare).rstrip("\n")
        return inner if bare else "\n".join("> " + x if x else ">" for x in inner.split("\n")) if inner else ""
    if block.kind == "pre":
        text = block.text.rstrip("\n")
        return text if bare else f"```\n{text}\n```"
    if block.kind == "rule":
        return "---"
    if block.kind == "table":
        return table(block, bare)
    if block.kind == "list":
        return "\n".join(line for i in block.items for line in item_lines(i, 0, bare))
    return inline(block.runs, bare)


def write(blocks: list[Block], bare: bool = False) -> str:
    chunks = [c for c in (chunk(b, bare).strip("\n") for b in blocks) if c]
    return "\n\n".join(chunks) + "\n" if chunks else ""


def to_markdown(source: str | None, bare: bool = False) -> str:
    return write(body_blocks(source), bare)


def body_blocks(source: str | None) -> list[Block]:
    root = parse(source or "")
    return blocks_of(root.find("body") or Element("body"))


def first_heading(blocks: list[Block]) -> str:
    return next((plain(b.runs) for b in blocks if b.kind == "heading" and b.level == 1), "")
