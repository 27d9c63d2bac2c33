"""Rules over cells: conditional formats, merges, running strings, sections, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: dots an inch where none are asked for
DEFAULT_DPI = 150.0


def conditional_winners(hits: DataFrame, keys: list[str]) -> DataFrame:
    """hits (keys, priority, stop): those that apply: by priority, none after one that stops."""
    w = Window.partitionBy(*keys).orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(F.col("stop").cast("int")).over(w), F.lit(0))
    return hits.withColumn("_stopped", stopped).where("_stopped = 0").drop("_stopped")


def uncovered(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells (doc_id, sheet, r, c) that no merge (r0, c0, r1, c1) covers but as its origin."""
    a, m = cells.alias("a"), merges.alias("m")
    inside = (F.col("a.doc_id") == F.col("m.doc_id")) & (F.col("a.sheet") == F.col("m.sheet")) & F.col("a.r").between(F.col("m.r0"), F.col("m.r1")) & F.col("a.c").between(F.col("m.c0"), F.col("m.c1"))
    return a.join(m, inside & ~((F.col("a.r") == F.col("m.r0")) & (F.col("a.c") == F.col("m.c0"))), "left_anti")


def carried(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """rows and running: the last value so far, carried over rows without one."""
    return rows.withColumn("running", F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order)))


def sections(blocks: DataFrame, starts: Column, keys: list[str], order: str) -> DataFrame:
    """blocks and section: how many starts there are up to each; what stands before the first is in section 0."""
    return blocks.withColumn("section", F.sum(F.coalesce(starts.cast("int"), F.lit(0))).over(Window.partitionBy(*keys).orderBy(order)).cast("int"))


def islands(rows: DataFrame, flag: Column, keys: list[str], order: str) -> DataFrame:
    """rows and island: runs of neighbours with equal flags, numbered from 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_flag", flag).withColumn("island", F.sum(F.coalesce((F.col("_flag") != F.lag("_flag").over(w)).cast("int"), F.lit(0))).over(w).cast("int")).drop("_flag")


def fit_scale(width: Column, height: Column, page_width: Column, page_height: Column, dpi: Column) -> Column:
    """Dots an inch so that a page (in points) fits a box (in pixels): the tighter side wins, a positive dpi is a ceiling.

    A side of the box that is not positive does not bind; where neither does, dpi holds, DEFAULT_DPI
    if it is not positive. A scale whose rounded-up pixels pass the box steps down to the next
    double, four times at most.
    """
    scale = F.least(F.when(width > 0, width / page_width), F.when(height > 0, height / page_height), F.when(dpi > 0, dpi / 72))
    for _ in range(4):
        over = F.coalesce((width > 0) & (F.ceil(page_width * scale) > width), F.lit(False)) | F.coalesce((height > 0) & (F.ceil(page_height * scale) > height), F.lit(False))
        scale = F.when(over, scale * (1 - 2.0**-53)).otherwise(scale)
    return F.when((width > 0) | (height > 0), scale * 72).when(dpi > 0, dpi).otherwise(F.lit(DEFAULT_DPI))


def page_numbers(spec: Column, count: Column) -> Column:
    """Sorted page numbers of a range such as 1-3,5 or all; those past the last are left out."""
    part = F.transform(F.split(F.regexp_replace(spec, r"\s", ""), ","), lambda p: F.when(
        F.contains(p, F.lit("-")), F.sequence(F.split(p, "-")[0].try_cast("int"), F.greatest(F.split(p, "-")[1].try_cast("int"), F.split(p, "-")[0].try_cast("int")))
    ).otherwise(F.array(p.try_cast("int"))))
    chosen = F.filter(F.array_sort(F.array_distinct(F.flatten(part))), lambda n: n.isNotNull() & (n >= 1) & (n <= count))
    return F.when(F.lower(spec).isin("all", ""), F.sequence(F.lit(1), count)).otherwise(chosen)
