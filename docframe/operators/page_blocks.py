"""A page's glyphs and rules to blocks, as HTML: lines, parts, reading order, paragraphs, headings, lists, one table a page."""

from __future__ import annotations

import html
import re
from statistics import median

import numpy as np

from docframe.functions.text import BULLETS, HEADING_RATIOS
from docframe.operators.glyphs import BAND, GUTTER, GUTTER_SHARE, LATTICE, PARAGRAPH_SHARE, SNAP, STREAM_ROWS, PageGlyphs, fold_words, stream_grid, xy_cut

MARKER = re.compile(rf"([{re.escape(BULLETS)}])\S*\s+|((?:\d+|[A-Za-z]|[ivxlcdmIVXLCDM]+)[.)])\s+")


def words_of(glyphs: list[tuple]) -> list[list[dict]]:
    """Lines of words from a page's glyphs (r, x, x1, y, size, bold, italic, is_space)."""
    if not glyphs:
        return []
    letters, *rest = zip(*glyphs)
    x, x1, y, size = (np.array(c, float) for c in rest[:4])
    bold, italic, space = (np.array(c, bool) for c in rest[4:])
    found = fold_words(PageGlyphs(np.zeros(len(x), np.int64), list(letters), x, x1, y, size, bold, italic, space))
    lines: dict[int, list[dict]] = {}
    for line, a, b, text in zip(found.line.tolist(), found.first.tolist(), found.last.tolist(), found.text):
        at = found.order[a:b]
        word = {"text": text, "x": float(x[at[0]]), "x1": float(x1[at].max()), "ys": y[at].tolist(), "sizes": size[at].tolist(), "bold": bool(bold[at].all()), "italic": bool(italic[at].all()), "first": float(size[at[0]])}
        lines.setdefault(line, []).append(word)
    return [lines[k] for k in sorted(lines)]


def line_of(words: list[dict]) -> dict:
    sizes = [s for w in words for s in w["sizes"] if s > 0]
    return {"words": words, "y": median(y for w in words for y in w["ys"]), "size": median(sizes) if sizes else 0.0, "x": min(w["x"] for w in words), "x1": max(w["x1"] for w in words)}


def parts_of(words: list[dict], width: float) -> list[list[dict]]:
    out: list[list[dict]] = []
    reach = None
    for w in words:
        if reach is None or w["x"] - reach >= max(GUTTER, GUTTER_SHARE * width):
            out.append([])
        out[-1].append(w)
        reach = max(reach if reach is not None else w["x1"], w["x1"])
    return out


def snapped(values: list[float]) -> list[float]:
    out: list[list[float]] = []
    for v in sorted(values):
        if out and v - sum(out[-1]) / len(out[-1]) <= SNAP:
            out[-1].append(v)
        else:
            out.append([v])
    return [sum(c) / len(c) for c in out]


def band(lines: list[float], v: float) -> int:
    return -1 if not lines[0] - SNAP <= v <= lines[-1] + SNAP else min(len(lines) - 2, next((i for i, hi in enumerate(lines[1:]) if v <= hi), len(lines) - 2))


def lattice(lines: list[dict], rules: list[tuple]) -> tuple[float, float, str] | None:
    """(top, bottom, html) of a ruled table: three grid lines each way at least; a missing rule between two cells joins them."""
    ys, xs = snapped([a for h, a, *_ in rules if h]), snapped([a for h, a, *_ in rules if not h])
    if len(ys) < LATTICE or len(xs) < LATTICE:
        return None
    n, m = len(ys) - 1, len(xs) - 1
    cells: dict[tuple[int, int], list] = {}
    for line in lines:
        for w in line["words"]:
            r, c = band(ys, line["y"]), band(xs, (w["x"] + w["x1"]) / 2)
            if r >= 0 and c >= 0:
                cells.setdefault((r, c), []).append((line["y"], w["x"], w))
    if len({c for _, c in cells}) < 2 and m > 1 or not cells:
        return None
    near = lambda a, b: abs(a - b) <= SNAP
    wall = lambda h, at, lo, hi: any(k == h and near(a, at) and min(b1, hi) - max(b0, lo) > SNAP for k, a, b0, b1 in rules)
    rows = []
    gone: set[tuple[int, int]] = set()
    for r in range(n):
        row = []
        for c in range(m):
            if (r, c) in gone:
                continue
            right = c + 1
            while right < m and not wall(False, xs[right], ys[r], ys[r + 1]):
                right += 1
            down = r + 1
            while down < n and not any(wall(True, ys[down], xs[k], xs[k + 1]) for k in range(c, right)):
                down += 1
            gone |= {(i, k) for i in range(r, down) for k in range(c, right)}
            words = sorted((x for i in range(r, down) for k in range(c, right) for x in cells.get((i, k), [])), key=lambda x: x[:2])
            row.append((down - r, right - c, styled([w for *_, w in words])))
        rows.append("<tr>" + "".join(f'<td rowspan="{a}" colspan="{b}">{t}</td>' for a, b, t in row) + "</tr>")
    return ys[0], ys[-1], f"<table>{''.join(rows)}</table>"


def stream(lines: list[dict]) -> tuple[float, float, str] | None:
    """A table without rules: the page's lines fall into the same columns, between gutters that half of them have and no word crosses."""
    if len(lines) < STREAM_ROWS:
        return None
    lines = sorted(lines, key=lambda line: line["y"])
    numbered = [[(w["x"], w["x1"], w["first"], str(k)) for k, w in enumerate(line["words"])] for line in lines]
    grid = stream_grid(numbered)
    if not grid:
        return None
    rows = ("".join(f"<td>{styled([line['words'][int(k)] for k in cell.split()])}</td>" for cell in row) for line, row in zip(lines, grid))
    return lines[0]["y"], lines[-1]["y"], "<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>"


def styled(words: list[dict]) -> str:
    out, held = [], None
    for w in words:
        style = (w["bold"], w["italic"])
        if style != held:
            out.append([style, []])
            held = style
        out[-1][1].append(html.escape(w["text"], quote=False))
    texts = []
    for (bold, italic), own in out:
        text = " ".join(own)
        text = f"<i>{text}</i>" if italic else text
        texts.append(f"<b>{text}</b>" if bold else text)
    return " ".join(texts)


def level_of(size: float, body: float) -> int:
    return next((i for i, least in enumerate(HEADING_RATIOS, 1) if body and size / body >= least), 0)


def page_html(glyphs: list[tuple], rules: list[tuple], width: float, body: float) -> str:
    lines = [line_of(w) for w in words_of(glyphs)]
    table = lattice(lines, rules) if rules else None
    table = table or stream(lines)
    if table:
        lines = [x for x in lines if not table[0] - BAND <= x["y"] <= table[1] + BAND]
    parts = [line_of(p) for line in lines for p in parts_of(line["words"], width)]
    order = xy_cut([(p["x"], p["x1"], p["y"], p["size"]) for p in parts], width)
    groups: list[list[dict]] = []
    for i in order:
        line = parts[i]
        last = groups[-1][-1] if groups else None
        text = " ".join(w["text"] for w in line["words"]) + " "
        gap = last is None or line["y"] < last["y"] or line["y"] - last["y"] > PARAGRAPH_SHARE * max(line["size"], last["size"])
        if gap or MARKER.match(text) or level_of(line["size"], body) != level_of(last["size"], body):
            groups.append([])
        groups[-1].append(line)
    out: list[tuple[float, str]] = []
    items: list[tuple[float, str]] = []
    kind = ""

    def close() -> None:
        if items:
            out.append((items[0][0], f"<{kind}>{''.join(t for _, t in items)}</{kind}>"))
            items.clear()

    for g in groups:
        words = [w for line in g for w in line["words"]]
        text = " ".join(w["text"] for w in words)
        level = level_of(median(line["size"] for line in g), body)
        marked = MARKER.match(text + " ")
        if marked and not level and len(words) > 1:
            tag = "ul" if marked[1] else "ol"
            if tag != kind:
                close()
            kind = tag
            items.append((g[0]["y"], f"<li>{styled(words[1:])}</li>"))
            continue
        close()
        kind = ""
        out.append((g[0]["y"], f"<h{level}>{html.escape(text, quote=False)}</h{level}>" if level else f"<p>{styled(words)}</p>"))
    close()
    if table:
        at = next((i for i, (y, _) in enumerate(out) if y >= table[0]), len(out))
        out.insert(at, (table[0], table[2]))
    return "\n".join(x for _, x in out)


def pdf_to_html(data: bytes) -> str:
    from docframe.sources.pdf import pages_of

    pages = [p for _, p in pages_of(data)]
    weighted = sorted(line["size"] for p in pages for line in (line_of(w) for w in words_of(p.glyphs)) for _ in line["words"] if line["size"] > 0)
    body = median(weighted) if weighted else 0.0
    return "\n".join(page_html(p.glyphs, p.rules, p.width, body) for p in pages)
