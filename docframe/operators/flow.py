"""Ordered folds of layout: wrapped lines, paint order, pages, generated counters; first uses and changed parts."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.functions.counters import counter_text


def wrapped_lines(items: DataFrame, keys: list[str], order: str, size: str, room: str, gap: str) -> DataFrame:
    """items and line: in order, an item that does not fit beside those before starts a new line; a null room is one without end."""
    first = F.struct(F.lit(0).alias("line"), F.lit(0.0).alias("used"), F.lit(True).alias("fresh"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, item: Column) -> Column:
        wanted = acc["used"] + item["size"] + F.when(acc["fresh"], 0.0).otherwise(item["gap"])
        breaks = ~acc["fresh"] & F.coalesce(wanted > item["room"], F.lit(False))
        line = acc["line"] + breaks.cast("int")
        return F.struct(line.alias("line"), F.when(breaks, item["size"]).otherwise(wanted).alias("used"), F.lit(False).alias("fresh"), F.concat(acc["out"], F.array(line)).alias("out"))

    rest = [c for c in items.columns if c not in keys]
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), F.col(size).cast("double").alias("size"), F.col(room).cast("double").alias("room"), F.col(gap).cast("double").alias("gap"), F.struct(*rest).alias("row"))))
    folded = items.groupBy(*keys).agg(listed.alias("own")).withColumn("lines", F.aggregate("own", first, step, lambda a: a["out"]))
    return folded.select(*keys, F.explode(F.arrays_zip(F.transform("own", lambda i: i["row"]).alias("row"), F.col("lines").alias("line"))).alias("z")).select(*keys, "z.row.*", "z.line")


def paint_order(boxes: DataFrame, keys: list[str], order: str, z: str) -> DataFrame:
    """boxes, band and paint: those below zero first, then those of zero or none, then those above; equal ones in document order."""
    depth = F.coalesce(F.col(z), F.lit(0))
    w = Window.partitionBy(*keys).orderBy(depth, order)
    return boxes.withColumn("band", F.signum(depth.cast("double")).cast("int")).withColumn("paint", F.row_number().over(w))


def page_at(tops: Column, y: Column) -> Column:
    """From 0: the last page whose top is not below y; the first one above all tops. tops are sorted."""
    return F.greatest(F.size(F.filter(tops, lambda t: t <= y)) - 1, F.lit(0))


def page_tops(blocks: DataFrame, keys: list[str], order: str, height: str, page_height: float) -> DataFrame:
    """(keys, page, top): blocks stand below one another and are not cut; one that would pass the page's end starts a page."""
    lined = wrapped_lines(blocks.withColumn("_room", F.lit(page_height)).withColumn("_gap", F.lit(0.0)), keys, order, height, "_room", "_gap")
    top = F.sum(height).over(Window.partitionBy(*keys).orderBy(order)) - F.col(height)
    return lined.withColumn("_top", top).groupBy(*keys, F.col("line").alias("page")).agg(F.min("_top").alias("top"))


def first_uses(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value, first, number): each value once, numbered from 0 in order of first use."""
    own = rows.groupBy(*keys, value).agg(F.min(order).alias("first"))
    return own.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1)


def part_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, name, change) of parts (doc_id, name, content): kept, changed, deleted or added."""
    a, b = before.select("doc_id", "name", F.sha2(F.col("content").cast("binary"), 256).alias("old")), after.select("doc_id", "name", F.sha2(F.col("content").cast("binary"), 256).alias("new"))
    change = F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull(), "added").when(F.col("old") == F.col("new"), "kept").otherwise("changed")
    return a.join(b, ["doc_id", "name"], "full").select("doc_id", "name", change.alias("change"))


def counter_ops(text: str | None, default: int) -> list[tuple[str, int]]:
    """(name, value) of a list of names, each with an integer after it or not."""
    out: list[tuple[str, int]] = []
    for word in (text or "").split():
        if re.fullmatch(r"[+-]?\d+", word) and out and out[-1][1] is None:
            out[-1] = (out[-1][0], int(word))
        elif word != "none":
            out.append((word, None))
    return [(name, default if value is None else value) for name, value in out]


CONTENT = re.compile(r"""\s+|"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|(counters?)\(((?:"[^"]*"|'[^']*'|[^()"'])*)\)|.""", re.I | re.S)
ARGUMENT = re.compile(r"""\s*("[^"]*"|'[^']*'|[^,]*)\s*(?:,|\Z)""")


def content_parts(text: str | None) -> list[tuple[str, ...]]:
    """("text", words), ("counter", name, style) and ("counters", name, separator, style) of generated content; what is not understood is passed over."""
    own = (text or "").strip()
    out: list[tuple[str, ...]] = []
    if own in ("", "none", "normal"):
        return out
    for m in CONTENT.finditer(own):
        if m[1] is not None or m[2] is not None:
            out.append(("text", m[1] if m[1] is not None else m[2]))
        elif m[3]:
            args = [a.strip().strip("\"'") if a.strip()[:1] in ('"', "'") else a.strip() for a in ARGUMENT.findall(m[4])]
            args = args[:-1] if args and args[-1] == "" and not m[4].rstrip().endswith(",") else args
            if m[3].lower() == "counter":
                out.append(("counter", *(args + ["", ""])[:1], (args[1] if len(args) > 1 else "") or "decimal"))
            else:
                out.append(("counters", (args or [""])[0], args[1] if len(args) > 1 else "", (args[2] if len(args) > 2 else "") or "decimal"))
    return out


def generated_texts(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, text) of nodes (doc_id, node_id, parent_id, pre, reset, increment, set, content) with content: one walk a document.

    A reset opens a scope that the element's later siblings and all within see; a counter that none
    has opened starts at 0. Elements count up after their resets; then they are set.
    """

    def walk(table: pa.Table) -> pa.Table:
        scopes: dict[str, list[int]] = {}
        opened: list[tuple[int | None, list[str]]] = [(None, [])]
        out: list[tuple[int, str]] = []
        for r in table.sort_by("pre").to_pylist():
            while len(opened) > 1 and opened[-1][0] != r["parent_id"]:
                for name in opened.pop()[1]:
                    scopes[name].pop()
            for name, value in counter_ops(r["reset"], 0):
                scopes.setdefault(name, []).append(value)
                opened[-1][1].append(name)
            for text, default, add in ((r["increment"], 1, True), (r["set"], 0, False)):
                for name, value in counter_ops(text, default):
                    levels = scopes.setdefault(name, [])
                    levels[-1:] = [(levels[-1] if levels and add else 0) + value]
            shown = []
            for part in content_parts(r["content"]):
                if part[0] == "text":
                    shown.append(part[1])
                elif part[0] == "counter":
                    shown.append(counter_text((scopes.get(part[1]) or [0])[-1], part[2]))
                else:
                    shown.append(part[2].join(counter_text(v, part[3]) for v in scopes.get(part[1]) or []))
            if shown:
                out.append((r["node_id"], "".join(shown)))
            opened.append((r["node_id"], []))
        doc = table.column("doc_id")[0].as_py()
        return pa.table([pa.array([doc] * len(out), pa.int64()), pa.array([n for n, _ in out], pa.int32()), pa.array([t for _, t in out], pa.string())], ["doc_id", "node_id", "text"])

    return nodes.groupBy("doc_id").applyInArrow(walk, "doc_id long, node_id int, text string")
