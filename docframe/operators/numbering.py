"""List numbers: counters by level, markers, style chains."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docframe.functions.counters import format_counter


def resolve_levels(instances: DataFrame, overrides: DataFrame, levels: DataFrame) -> DataFrame:
    """(doc_id, num_id, ilvl, fmt, lvl_text, start): an instance's level, its start overridden, else the level's, else 1."""
    own = instances.join(levels, ["doc_id", "abstract_id"]).join(overrides.select("doc_id", "num_id", "ilvl", F.col("start").alias("_own")), ["doc_id", "num_id", "ilvl"], "left")
    return own.select("doc_id", "num_id", "ilvl", "fmt", "lvl_text", F.coalesce("_own", "start", F.lit(1)).alias("start"))


def counters(paras: DataFrame) -> DataFrame:
    """paras (doc_id, seq, num_id, ilvl, start) and value: each level counts on; an item of a lesser level starts the deeper ones anew."""
    out = paras
    by = Window.partitionBy("doc_id", "num_id").orderBy("seq")
    # an item's run ends at the last shallower item before it: the greatest seq among those, level by level
    last = F.lit(-1).cast("long")
    for level in range(9):
        last = F.greatest(last, F.when(F.col("ilvl") > level, F.coalesce(F.max(F.when(F.col("ilvl") == level, F.col("seq"))).over(by), F.lit(-1)).cast("long")).otherwise(F.lit(-1).cast("long")))
    out = out.withColumn("_run", last)
    w = Window.partitionBy("doc_id", "num_id", "ilvl", "_run").orderBy("seq")
    return out.withColumn("value", (F.row_number().over(w) + F.coalesce(F.col("start"), F.lit(1)) - 1).cast("long")).drop("_run")


def markers(counted: DataFrame) -> DataFrame:
    """counted with fmt and lvl_text, and marker: the first %n of the text gives way to the value; bullets show alone."""
    styles = F.create_map(*[F.lit(x) for p in {"decimal": "decimal", "lowerLetter": "lower-alpha", "upperLetter": "upper-alpha", "lowerRoman": "lower-roman", "upperRoman": "upper-roman", "decimalZero": "decimal-leading-zero"}.items() for x in p])
    shown = format_counter(F.col("value"), F.coalesce(styles[F.col("fmt")], F.lit("decimal")))
    place = F.expr(r"regexp_instr(lvl_text, '%[0-9]')")
    text = F.when(place > 0, F.concat(F.expr(r"substring(lvl_text, 1, regexp_instr(lvl_text, '%[0-9]') - 1)"), shown, F.expr(r"substring(lvl_text, regexp_instr(lvl_text, '%[0-9]') + 2)"))).otherwise(F.concat(shown, F.lit(".")))
    return counted.withColumn("marker", F.when(F.col("fmt") == "bullet", F.lit("• ")).when(F.col("fmt") == "none", F.lit("")).otherwise(F.concat(text, F.lit(" "))))


def style_chain(styles: DataFrame, props: list[str]) -> DataFrame:
    """styles (doc_id, style_id, based_on, props ...) with each property from the nearest style of the chain that sets it. A style that the chain has met ends it.

    One pass a document over its own styles; chains may have any length.
    """
    keys = ["doc_id", "style_id"]
    own = styles.select(*keys, "based_on", *props)

    def resolve(table: pa.Table) -> pa.Table:
        rows = {r["style_id"]: r for r in table.to_pylist()}
        done: dict = {}
        for start in rows:
            path, at, met = [], start, set()
            while at in rows and at not in met and at not in done:
                path.append(at)
                met.add(at)
                at = rows[at]["based_on"]
            if at in met:  # a loop: what lies on it depends on where a chain enters
                for style in path:
                    chain, seen, k = [], set(), style
                    while k in rows and k not in seen:
                        chain.append(rows[k])
                        seen.add(k)
                        k = rows[k]["based_on"]
                    done[style] = {p: next((r[p] for r in chain if r[p] is not None), None) for p in props}
                continue
            above = done.get(at, dict.fromkeys(props))
            for style in reversed(path):
                above = {p: above[p] if rows[style][p] is None else rows[style][p] for p in props}
                done[style] = above
        doc = table.column("doc_id")[0].as_py()
        schema = pa.schema([table.schema.field(c) for c in (*keys, *props)])
        return pa.Table.from_pylist([{"doc_id": doc, "style_id": s, **done[s]} for s in rows], schema)

    return own.groupBy("doc_id").applyInArrow(resolve, own.drop("based_on").schema)


def row_spans(cells: DataFrame) -> DataFrame:
    """cells (doc_id, table_id, row, ord, span, merge: restart, continue or null) and col, row_span: rows that continue a restart of their grid column."""
    by_row = Window.partitionBy("doc_id", "table_id", "row").orderBy("ord")
    placed = cells.withColumn("col", (F.sum("span").over(by_row) - F.col("span")).cast("int"))
    down = Window.partitionBy("doc_id", "table_id", "col").orderBy("row")
    owner = F.last(F.when(F.coalesce(F.col("merge"), F.lit("")) != "continue", F.col("row")), ignorenulls=True).over(down)
    owned = placed.withColumn("_owner", owner)
    size = owned.groupBy("doc_id", "table_id", "col", F.col("_owner").alias("row")).agg(F.count("*").cast("int").alias("row_span"))
    return placed.join(size, ["doc_id", "table_id", "col", "row"])


def final_text(children: DataFrame) -> DataFrame:
    """A paragraph's children after its tracked changes: insertions are in, deletions and comment anchors out."""
    return children.where("coalesce(revision, '') <> 'delete' and kind <> 'comment'")
