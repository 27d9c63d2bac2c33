"""Positioned glyphs to lines, words, sub-lines, blocks and tables."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tolerances in points, or in shares of the glyph size or page width
LINE_SHARE, WORD_SHARE, GUTTER, GUTTER_SHARE, PARAGRAPH_SHARE, SNAP, BAND = 0.5, 0.15, 18.0, 0.05, 1.6, 3.0, 3.0
GUTTER_SIZES, LATTICE, STREAM_ROWS, STREAM_COLUMNS, TOUCH = 1.5, 3, 3, 2, 0.01
#: Lines whose pages are cut together.
PAGE_ROWS = 1 << 16
WORDS = "doc_id long, page int, line int, word int, text string, x double, x1 double, y double, size double, bold boolean"
RUNS = "array<struct<text: string, widths: array<double>, x: double, y: double, size: double, bold: boolean, italic: boolean>>"


def lines_fold(ys: list[float], sizes: list[float]) -> list[int]:
    """Line numbers of glyphs sorted by y: a new line where y leaves the line's first y by over half the greater size."""
    out, line, first, last = [], -1, 0.0, 0.0
    for y, size in zip(ys, sizes):
        if line < 0 or abs(y - first) > LINE_SHARE * max(size, last, 1.0):
            line, first = line + 1, y
        out.append(line)
        last = size
    return out


@dataclass
class PageGlyphs:
    """Glyphs of one page or several, as arrays; r holds a string for each, empty where a font gives none."""

    page: np.ndarray
    r: list[str] | str
    x: np.ndarray
    x1: np.ndarray
    y: np.ndarray
    size: np.ndarray
    bold: np.ndarray
    italic: np.ndarray
    space: np.ndarray

    def __len__(self) -> int:
        return len(self.x)


@dataclass
class PageWords:
    """Words in order of page and line. order: the places of glyphs sorted by page, line and x; a word's are order[first:last]."""

    order: np.ndarray
    first: np.ndarray
    last: np.ndarray
    page: np.ndarray
    line: np.ndarray
    text: list[str]


def fold_words(g: PageGlyphs) -> PageWords:
    """The one fold from glyphs to lines and words; conversion and relations both use it.

    Glyphs of a page are in lines by lines_fold(). A space, or a gap to the glyph before of over
    WORD_SHARE of the greater of its size and that of the word's first glyph, ends a word. Glyphs
    without a character show as U+FFFD.
    """
    n = len(g)
    if not n:
        none = np.zeros(0, np.int64)
        return PageWords(none, none, none, none, none, [])
    order = np.lexsort((np.arange(n), g.x, g.y, g.page))
    page, y, size = g.page[order], g.y[order], g.size[order]
    # neighbours of one height and size cannot part, so the fold goes over runs of them
    start = np.flatnonzero(np.concatenate([[True], (page[1:] != page[:-1]) | (y[1:] != y[:-1]) | (size[1:] != size[:-1])]))
    run_line = np.zeros(len(start), np.int64)
    borders = np.flatnonzero(np.concatenate([[True], page[start][1:] != page[start][:-1], [True]]))
    ys, sizes = y[start].tolist(), size[start].tolist()
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
        run_line[a:b] = lines_fold(ys[a:b], sizes[a:b])
    line = np.empty(n, np.int64)
    line[order] = np.repeat(run_line, np.diff(np.append(start, n)))
    order = np.lexsort((np.arange(n), g.x, line, g.page))
    page, line, x, x1, size, space = g.page[order], line[order], g.x[order], g.x1[order], g.size[order], g.space[order]
    new = np.concatenate([[True], (page[1:] != page[:-1]) | (line[1:] != line[:-1]) | space[:-1]]) | space
    gap = np.concatenate([[0.0], x[1:] - x1[:-1]])
    wide = ~new & (gap > WORD_SHARE * size)
    if (size == size[0]).all():
        new |= wide
    else:
        begins = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # where each glyph's word begins, as far as spaces and lines tell
        broken = -1
        for k in np.flatnonzero(wide).tolist():  # wide for its own size; the size of its word's first glyph may forgive it
            if gap[k] > WORD_SHARE * size[max(broken, begins[k])]:
                new[k], broken = True, k
    first = np.flatnonzero(new & ~space)
    ends = np.append(np.flatnonzero(new), n)
    last = ends[np.searchsorted(ends, first, "right")]
    if isinstance(g.r, str):
        letters = np.frombuffer(g.r.encode("utf-32-le", "surrogatepass"), np.uint32)[order]
        text = np.where(letters == 0, 0xFFFD, letters).astype(np.uint32).tobytes().decode("utf-32-le", "replace")
        texts = [text[a:b] for a, b in zip(first.tolist(), last.tolist())]
    else:
        shown = [g.r[k] or "\ufffd" for k in order.tolist()]
        texts = ["".join(shown[a:b]) for a, b in zip(first.tolist(), last.tolist())]
    return PageWords(order, first, last, page[first], line[first], texts)


def medians(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of values[first:last]; most are all one value."""
    if not len(first):
        return np.zeros(0)
    at = np.ravel(np.column_stack([first, last]))
    padded = np.append(values, values[-1:])
    low, high = np.minimum.reduceat(padded, at)[::2], np.maximum.reduceat(padded, at)[::2]
    out = low.astype(float)
    for k in np.flatnonzero(low != high).tolist():
        out[k] = np.median(values[first[k] : last[k]])
    return out


def word_table(g: PageGlyphs, docs: pa.Array, pages: np.ndarray) -> pa.Table:
    """WORDS of folded glyphs; docs and pages name the pages that g.page numbers."""
    w = fold_words(g)
    number = np.concatenate([[0], np.cumsum((w.page[1:] != w.page[:-1]) | (w.line[1:] != w.line[:-1]))]) if len(w.first) else w.first
    starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else number
    place = np.arange(len(number)) - np.repeat(starts, np.diff(np.append(starts, len(number)))) + 1
    at = np.ravel(np.column_stack([w.first, w.last]))
    bold = np.append(g.bold[w.order], True)
    columns = [
        docs.take(pa.array(w.page)), pa.array(pages[w.page], pa.int32()), pa.array(w.line, pa.int32()), pa.array(place, pa.int32()), pa.array(w.text, pa.string()), pa.array(g.x[w.order][w.first]),
        pa.array(np.maximum.reduceat(np.append(g.x1[w.order], -np.inf), at)[::2] if len(at) else np.zeros(0)), pa.array(medians(g.y[w.order], w.first, w.last)), pa.array(medians(g.size[w.order], w.first, w.last)),
        pa.array(np.logical_and.reduceat(bold, at)[::2] if len(at) else np.zeros(0, bool)),
    ]
    return pa.table(columns, [c.split()[0] for c in WORDS.split(", ")])


def page_words(glyphs: DataFrame) -> DataFrame:
    """WORDS of glyphs (doc_id, page, seq, r, x, x1, y, size, bold, italic, is_space), one pass a page."""

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq").combine_chunks()
        numbers = [table.column(c).to_numpy().astype(float) for c in ("x", "x1", "y", "size")]
        flags = [table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("bold", "italic", "is_space")]
        g = PageGlyphs(np.zeros(len(table), np.int64), [r or "" for r in table.column("r").to_pylist()], *numbers, *flags)
        return word_table(g, table.column("doc_id").combine_chunks().slice(0, 1), table.column("page").to_numpy()[:1])

    return glyphs.groupBy("doc_id", "page").applyInArrow(fold, WORDS)


def run_words(pages: DataFrame) -> DataFrame:
    """WORDS of pages of RUNS: strings shown from a place on, with the width of each character. No shuffle: a row is a page."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 64) for b in batches for i in range(0, len(b), 64)):
            lists = batch.column(2)
            runs = lists.flatten()
            text, widths, *numbers = [runs.field(k) for k in range(5)]
            count = np.diff(widths.offsets.to_numpy())
            page = np.repeat(np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy())), count)
            letters = "".join(text.to_pylist())
            if len(letters) != len(page):
                raise ValueError("a run needs a width for each character")
            width = widths.flatten().to_numpy().astype(float)
            total = np.concatenate([[0.0], np.cumsum(width)])
            begin = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
            x0, y, size = (np.repeat(v.to_numpy().astype(float), count) for v in numbers)
            x = x0 + total[:-1] - np.repeat(total[begin[: len(count)]], count)
            bold, italic = (np.repeat(runs.field(k).to_numpy(zero_copy_only=False).astype(bool), count) for k in (5, 6))
            space = np.isin(np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32), [9, 32])
            own = word_table(PageGlyphs(page, letters, x, x + width, y, size, bold, italic, space), batch.column(0), batch.column(1).to_numpy())
            yield from own.combine_chunks().to_batches()

    return pages.select("doc_id", "page", "runs").mapInArrow(fold, WORDS)


def gutter_split(words_df: DataFrame, width: Column) -> DataFrame:
    """words and part: a gap of GUTTER points or GUTTER_SHARE of the width after all words so far starts a new part of the line."""
    w = Window.partitionBy("doc_id", "page", "line").orderBy("x", "word")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col("x") - reach >= F.greatest(F.lit(GUTTER), width * GUTTER_SHARE)).cast("int")
    return words_df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("part", F.sum("_new").over(w).cast("int")).drop("_new")


def body_size(lines: DataFrame) -> DataFrame:
    """Median size of a page's lines weighted by their words (one at least)."""
    weight = F.greatest(F.col("n_words"), F.lit(1)).cast("long")
    return lines.where("size > 0").groupBy("doc_id").agg(F.percentile("size", 0.5, weight).alias("body_size"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page, line, y, size, text) and para: a wide gap, a list marker or a change of size class starts one."""
    from docframe.functions.text import list_marker

    w = Window.partitionBy("doc_id", "page").orderBy("y", "line")
    gap = F.col("y") - F.lag("y").over(w) > PARAGRAPH_SHARE * F.greatest(F.col("size"), F.lag("size").over(w))
    flip = (F.col("size") >= 1.15 * F.col("body_size")) != F.lag(F.col("size") >= 1.15 * F.col("body_size")).over(w)
    own = lines.join(body_size(lines), "doc_id", "left")
    new = (F.coalesce(gap, F.lit(True)) | F.coalesce(flip, F.lit(False)) | list_marker(F.col("text")).isNotNull()).cast("int")
    return own.withColumn("_new", new).withColumn("para", F.sum("_new").over(w).cast("int")).drop("_new")


def snap(values: Column) -> Column:
    """Means of clusters of a sorted array: a value within SNAP of its cluster's running mean joins it."""
    first = F.struct(F.lit(None).cast("double").alias("sum"), F.lit(0).cast("long").alias("n"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        near = (acc["n"] > 0) & (v - acc["sum"] / acc["n"] <= SNAP)
        done = F.when(acc["n"] > 0, F.concat(acc["out"], F.array(acc["sum"] / acc["n"]))).otherwise(acc["out"])
        return F.struct(
            F.when(near, acc["sum"] + v).otherwise(v).alias("sum"), F.when(near, acc["n"] + 1).otherwise(F.lit(1).cast("long")).alias("n"), F.when(near, acc["out"]).otherwise(done).alias("out")
        )

    return F.aggregate(F.array_sort(values), first, step, lambda a: F.when(a["n"] > 0, F.concat(a["out"], F.array(a["sum"] / a["n"]))).otherwise(a["out"]))


def track(lines: Column, value: Column) -> Column:
    """From 0: the first band whose upper edge is not below value, the last one up to SNAP beyond its edge; -1 further outside."""
    inside = (value >= F.element_at(lines, 1) - SNAP) & (value <= F.element_at(lines, -1) + SNAP)
    at = F.size(F.filter(F.slice(lines, 2, F.size(lines)), lambda v: v < value))
    return F.when((F.size(lines) >= 2) & inside, F.least(at, F.size(lines) - 2)).otherwise(-1)


def ruled_cells(rules: DataFrame, words_df: DataFrame) -> DataFrame:
    """(doc_id, page, row, col, text) of one ruled table a page: rules (horizontal, a, b0, b1) snap to a grid of LATTICE lines each way at least, words fall in its cells."""
    at = rules.groupBy("doc_id", "page").agg(snap(F.collect_list(F.when(~F.col("horizontal"), F.col("a")))).alias("xs"), snap(F.collect_list(F.when(F.col("horizontal"), F.col("a")))).alias("ys"))
    at = at.where((F.size("xs") >= LATTICE) & (F.size("ys") >= LATTICE))
    own = words_df.join(at, ["doc_id", "page"]).withColumn("row", track(F.col("ys"), F.col("y"))).withColumn("col", track(F.col("xs"), (F.col("x") + F.col("x1")) / 2))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda g: g["text"]), " ")
    return own.where("row >= 0 and col >= 0").groupBy("doc_id", "page", "row", "col").agg(texts.alias("text"))


def gutters(lines: list[list[tuple[float, float, float]]]) -> list[float]:
    """Places of column gutters of lines of words (x, x1, size).

    Candidates are the middles of gaps of GUTTER_SIZES sizes or more; one within SNAP of an earlier one
    counts for it. Those stay that half of the lines or more have, and that no word of any line crosses.
    """
    found: list[list[float]] = []  # [middle, how many]
    for words in lines:
        for (_, end, a), (start, _, b) in zip(words, words[1:]):
            if start > end and start - end >= GUTTER_SIZES * max(a, b):
                middle = (start + end) / 2
                near = next((f for f in found if abs(f[0] - middle) <= SNAP), None)
                if near:
                    near[1] += 1
                else:
                    found.append([middle, 1])
    most = [at for at, count in found if 2 * count >= len(lines)]
    free = sorted(at for at in most if not any(x < at - TOUCH and x1 > at + TOUCH for words in lines for x, x1, _ in words))
    return dedupe_sorted(free)


def dedupe_sorted(values: list[float], tolerance: float = SNAP) -> list[float]:
    """Sorted values without those within tolerance of the last one kept."""
    out: list[float] = []
    for v in values:
        if not out or v - out[-1] > tolerance:
            out.append(v)
    return out


def stream_grid(lines: list[list[tuple[float, float, float, str]]]) -> list[list[str]]:
    """The rows of a table without rules, of lines of words (x, x1, size, text): words fall between gutters. Empty if it is none."""
    at = gutters([[w[:3] for w in words] for words in lines])
    rows = []
    for words in lines:
        cells: list[list[str]] = [[] for _ in range(len(at) + 1)]
        for x, x1, _, text in words:
            cells[bisect_left(at, (x + x1) / 2)].append(text)
        rows.append([" ".join(c) for c in cells])
    filled = sum(any(row) for row in rows)
    columns = sum(any(row[k].strip() for row in rows) for k in range(len(at) + 1))
    return rows if len(at) + 1 >= STREAM_COLUMNS and filled >= STREAM_ROWS and columns >= STREAM_COLUMNS else []


def stream_cells(words_df: DataFrame) -> DataFrame:
    """(doc_id, page, row, col, text) of the tables without rules that pages are: one pass a page over its words."""

    def run(table: pa.Table) -> pa.Table:
        lines: dict[int, list] = {}
        for w in table.sort_by([("line", "ascending"), ("x", "ascending")]).to_pylist():
            lines.setdefault(w["line"], []).append((w["x"], w["x1"], w["size"], w["text"]))
        doc, page = table.column("doc_id")[0].as_py(), table.column("page")[0].as_py()
        cells = [(doc, page, r, c, text) for r, row in enumerate(stream_grid([lines[k] for k in sorted(lines)])) for c, text in enumerate(row)]
        kinds = [("doc_id", pa.int64()), ("page", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("text", pa.string())]
        return pa.table([pa.array([c[k] for c in cells], kind) for k, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])

    return words_df.groupBy("doc_id", "page").applyInArrow(run, "doc_id long, page int, row int, col int, text string")


def segments(start: np.ndarray, n: int) -> np.ndarray:
    """The segment of each of n rows; start: where segments begin."""
    return np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))


def vertical_cuts(x: np.ndarray, x1: np.ndarray, start: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment the rows by x, and how many of them lie left of the widest gap; 0 without a gap that is wide enough."""
    n, group = len(x), segments(start, len(x))
    order = np.lexsort((x, group))
    values, rank = np.unique(x1[order], return_inverse=True)
    reach = values[np.maximum.accumulate(group * len(values) + rank) - group * len(values)]
    gap = np.zeros(n)
    gap[1:] = x[order[1:]] - reach[:-1]
    gap[start] = 0.0
    best = np.maximum.reduceat(gap, start)
    first = np.minimum.reduceat(np.where(gap == best[group], np.arange(n), n), start)
    at = (x[order[first]] + reach[np.maximum(first - 1, 0)]) / 2
    left = np.add.reduceat((x[order] < at[group]).astype(np.int64), start)
    return order, np.where(best >= np.fmax(GUTTER, GUTTER_SHARE * width), left, 0)


def horizontal_cuts(y: np.ndarray, size: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment of two rows or more the rows by y, and how many of them lie above the widest gap; 0 without a gap that stands out."""
    n, group, count = len(y), segments(start, len(y)), np.diff(np.append(start, len(y)))
    order = np.lexsort((y, group))
    gap = np.full(n, -1.0)
    gap[1:] = y[order[1:]] - y[order[:-1]]
    gap[start] = -1.0  # sorts before all gaps
    best = np.maximum.reduceat(gap, start)
    first = np.minimum.reduceat(np.where(gap == best[group], np.arange(n), n), start)
    middle = gap[np.lexsort((gap, group))]
    median = (middle[start + 1 + (count - 2) // 2] + middle[start + 1 + (count - 1) // 2]) / 2
    out = (best >= PARAGRAPH_SHARE * np.maximum(size[order[first - 1]], 1.0)) & (best >= 1.5 * median + 0.01)
    return order, np.where(out, first - start, 0)


def xy_order(x: np.ndarray, x1: np.ndarray, y: np.ndarray, size: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Reading order of the line boxes of many pages, page by page, as places: each page is cut at the widest vertical gap, then at horizontal ones, in turn.

    start: where pages begin; width: one a page. All pages' parts are cut side by side, a level at a
    time, and parts lie in reading order throughout. A cut that leaves nothing on one side is none.
    Of equal places the earlier row comes first; boxes without a finite place come last on their page.
    """
    n = len(x)
    if not n:
        return np.zeros(0, np.int64)
    placed, page = np.isfinite(x) & np.isfinite(y), segments(start, n)
    x1, size = np.where(np.isfinite(x1), x1, x), np.where(np.isfinite(size), size, 0.0)
    rows = np.lexsort((~placed, page))
    # parts: where they begin and end in rows, whether a vertical cut is tried first, their page
    many = np.add.reduceat(placed.astype(np.int64), start)
    begin, end, upright, of = start, start + many, np.ones(len(start), bool), np.arange(len(start))
    while True:
        own = end - begin > 1
        begin, end, upright, of = begin[own], end[own], upright[own], of[own]
        if not len(begin):
            return rows
        cut, across = np.zeros(len(begin), np.int64), np.zeros(len(begin), bool)
        for now in (upright, ~upright):
            for vertical in (True, False):
                todo = np.flatnonzero((now == vertical) & (cut == 0))
                if not len(todo):
                    continue
                count = end[todo] - begin[todo]
                parts = np.cumsum(count) - count
                at = np.arange(count.sum()) + np.repeat(begin[todo] - parts, count)
                r = rows[at]
                order, left = vertical_cuts(x[r], x1[r], parts, width[of[todo]]) if vertical else horizontal_cuts(y[r], size[r], parts)
                left[left == count] = 0
                moved = np.repeat(left > 0, count)
                rows[at[moved]] = r[order[moved]]
                cut[todo], across[todo] = left, not vertical
        whole = np.flatnonzero(cut == 0)
        if len(whole):
            count = end[whole] - begin[whole]
            at = np.arange(count.sum()) + np.repeat(begin[whole] - (np.cumsum(count) - count), count)
            r = rows[at]
            rows[at] = r[np.lexsort((x[r], y[r], np.repeat(whole, count)))]
        parted = cut > 0
        middle = begin[parted] + cut[parted]
        begin, end = np.concatenate([begin[parted], middle]), np.concatenate([middle, end[parted]])
        upright, of = np.tile(across[parted], 2), np.tile(of[parted], 2)


def xy_cut(boxes: list[tuple[float, float, float, float]], width: float) -> list[int]:
    """Reading order of line boxes (x, x1, y, size) of one page as places."""
    own = np.array(boxes, float).reshape(-1, 4)
    return xy_order(*own.T, np.zeros(1, np.int64), np.array([width], float)).tolist()


def reading_order(lines: DataFrame, at_once: int = PAGE_ROWS) -> DataFrame:
    """lines (doc_id, page, line, x, x1, y, size, width) and reading_seq, page by page; a page's first line tells its width.

    Batches go to Python as they come, in order of pages, and whole pages of at_once lines or more
    are cut together.
    """
    names = lines.columns
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields]

    def ordered(table: pa.Table) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(table.column("_place").to_numpy() == 1)
        x, x1, y, size, width = (table.column(c).to_numpy().astype(float) for c in ("x", "x1", "y", "size", "width"))
        places = xy_order(x, x1, y, size, start, width[start])
        seq = np.empty(len(places), np.int32)
        seq[places] = np.arange(len(places)) - np.repeat(start, np.diff(np.append(start, len(places))))
        yield from table.select(names).append_column("reading_seq", pa.array(seq)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, last = [], 0, 0
        for batch in batches:
            place = batch.column(len(names)).to_numpy()
            if (np.diff(np.concatenate([[last], place]))[place != 1] != 1).any():
                raise ValueError("lines of a page must follow each other")
            start, last = np.flatnonzero(place == 1), place[-1] if len(place) else last
            if len(start) and rows + start[-1] >= at_once:
                yield from ordered(pa.Table.from_batches([*held, batch.slice(0, start[-1])]))
                batch, held, rows = batch.slice(start[-1]), [], 0
            held.append(batch)
            rows += len(batch)
        if rows:
            yield from ordered(pa.Table.from_batches(held))

    # a window's rows leave it sorted, so pages are whole without a further shuffle
    own = lines.withColumn("_place", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line")))
    return own.mapInArrow(run, ", ".join([*kinds, "reading_seq int"]))


def reorder_rtl(words_df: DataFrame) -> DataFrame:
    """words of lines with logical_seq: runs of right-to-left words are turned round, and their letters too."""
    w = Window.partitionBy("doc_id", "page", "line").orderBy("x")
    rtl = F.col("text").rlike(r"[\x{590}-\x{8FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]") & ~F.col("text").rlike(r"[A-Za-z]")
    flagged = words_df.withColumn("rtl", rtl)
    run = flagged.withColumn("_run", F.sum(F.coalesce((F.col("rtl") != F.lag("rtl").over(w)).cast("int"), F.lit(0))).over(w))
    order = Window.partitionBy("doc_id", "page", "line").orderBy("_run", F.when(F.col("rtl"), -F.col("x")).otherwise(F.col("x")))
    return run.withColumn("logical_seq", F.row_number().over(order)).withColumn("text", F.when(F.col("rtl"), F.reverse("text")).otherwise(F.col("text"))).drop("_run", "rtl")
