"""Tables as grids: span expansion, slots, padding, used ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = "doc_id long, table_id long, row int, col int, rowspan int, colspan int, header boolean, text string"


def occupy(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(row, rowspan, colspan) in order to (row, col, rowspan, colspan): each cell takes the next free column of its row."""
    taken: set[tuple[int, int]] = set()
    out, next_col = [], {}
    for row, rows, cols in spans:
        rows, cols = max(1, rows or 1), max(1, cols or 1)
        col = next_col.get(row, 0)
        while (row, col) in taken:
            col += 1
        taken.update((r, c) for r in range(row, row + rows) for c in range(col, col + cols))
        next_col[row] = col + cols
        out.append((row, col, rows, cols))
    return out


def place_cells(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, ord, rowspan, colspan, header, text) to CELLS. Tables without spans need no fold: a cell's column is its place in its row."""
    keys = ["doc_id", "table_id"]
    spanned = cells.groupBy(*keys).agg(F.max(F.greatest("rowspan", "colspan")).alias("_most"))
    own = cells.join(spanned, keys)
    w = Window.partitionBy(*keys, "row").orderBy("ord")
    plain = own.where("_most <= 1 or _most is null").withColumn("col", (F.row_number().over(w) - 1).cast("int"))
    plain = plain.select("doc_id", "table_id", F.col("row").cast("int").alias("row"), "col", F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), "header", "text")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by table, row and ord; what is taken is known for the table at hand only."""
        at, taken, row, col = None, {}, -1, 0
        for pdf in batches:
            out = []
            for doc, table, r, rows, cols in zip(pdf["doc_id"], pdf["table_id"], pdf["row"], pdf["rowspan"].fillna(1), pdf["colspan"].fillna(1)):
                if (doc, table) != at:
                    at, taken, row = (doc, table), {}, -1
                if r != row:
                    taken = {k: v for k, v in taken.items() if v > r}  # column -> first row that is free again
                    row, col = r, 0
                rows, cols = max(1, int(rows)), max(1, int(cols))
                while col in taken:
                    col += 1
                if rows > 1:
                    taken.update((c, r + rows) for c in range(col, col + cols))
                out.append((r, col, rows, cols))
                col += cols
            own = pdf[["doc_id", "table_id", "header", "text"]].copy()
            for i, name in enumerate(("row", "col", "rowspan", "colspan")):
                own[name] = [x[i] for x in out]
            yield own[["doc_id", "table_id", "row", "col", "rowspan", "colspan", "header", "text"]]

    tables = own.where("_most > 1").drop("_most").repartition(*keys).sortWithinPartitions(*keys, "row", "ord")
    folded = tables.mapInPandas(fold, CELLS)
    return plain.unionByName(folded)


def slots(cells: DataFrame) -> DataFrame:
    """One row for each slot that a cell covers; a later cell's stamp wins. Columns of CELLS, and slot_row, slot_col."""
    spread = cells.withColumn("slot_row", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1)))
    spread = spread.withColumn("slot_col", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)))
    w = Window.partitionBy("doc_id", "table_id", "slot_row", "slot_col").orderBy(F.desc("row"), F.desc("col"))
    return spread.withColumn("_top", F.row_number().over(w)).where("_top = 1").drop("_top")


def dense(cells: DataFrame) -> DataFrame:
    """doc_id, table_id, row, values (array padded to the table's width, gaps empty): spans repeat their text, a later cell's over an earlier one's.

    Cells spread over the rows that they cover only; along a row a span stays an interval until the
    row's array is made.
    """
    keys = ["doc_id", "table_id"]
    size = cells.groupBy(*keys).agg(F.max(F.col("col") + F.col("colspan")).alias("width"), F.max(F.col("row") + F.col("rowspan")).alias("height"))
    spread = cells.withColumn("slot_row", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1)))
    rows = spread.groupBy(*keys, "slot_row").agg(F.array_sort(F.collect_list(F.struct("row", "col", "colspan", "text"))).alias("own"))
    every = size.withColumn("slot_row", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    full = every.join(rows, [*keys, "slot_row"], "left")
    empty = F.array_repeat(F.lit(""), F.col("width"))

    def stamp(done, c):
        after = c["col"] + c["colspan"]
        return F.concat(F.slice(done, F.lit(1), c["col"]), F.array_repeat(F.coalesce(c["text"], F.lit("")), c["colspan"]), F.slice(done, after + 1, F.greatest(F.col("width") - after, F.lit(0))))

    values = F.when(F.col("own").isNull(), empty).otherwise(F.aggregate("own", empty, stamp))
    return full.select(*keys, F.col("slot_row").alias("row"), values.alias("values"))


def used_range(cells: DataFrame) -> DataFrame:
    return cells.groupBy("doc_id", "table_id").agg(F.max(F.col("row") + F.col("rowspan")).alias("rows"), F.max(F.col("col") + F.col("colspan")).alias("cols"))
