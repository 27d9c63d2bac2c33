"""Computed pivot tables: eleven aggregations, row and column fields, grand totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The aggregations of a pivot table's value field
AGGREGATIONS = ("sum", "count", "average", "max", "min", "product", "countNums", "stdDev", "stdDevp", "var", "varp")


def aggregate(kind: str, value: Column) -> Column:
    number = value.cast("double")
    return {
        "sum": F.sum(number), "count": F.count(value), "average": F.avg(number), "max": F.max(number), "min": F.min(number), "product": F.product(number),
        "countNums": F.count(number), "stdDev": F.stddev_samp(number), "stdDevp": F.stddev_pop(number), "var": F.var_samp(number), "varp": F.var_pop(number),
    }[kind]


def display_name(kind: str, field: str) -> str:
    """The name that a value field has by default."""
    titles = {"sum": "Sum", "count": "Count", "average": "Average", "max": "Max", "min": "Min", "product": "Product", "countNums": "Count Nums", "stdDev": "StdDev", "stdDevp": "StdDevp", "var": "Var", "varp": "Varp"}
    return f"{titles[kind]} of {field}"


def check_fields(df: DataFrame, *names: str) -> None:
    for n in names:
        if n not in df.columns:
            raise ValueError(f"no field {n!r} among {df.columns}")


def pivot_long(df: DataFrame, rows: list[str], columns: list[str], values: list[tuple[str, str]], row_totals: bool = True, column_totals: bool = True) -> DataFrame:
    """One row for each combination of row and column items, with a column a value (named kind_field).

    Totals have null items and grand_row / grand_column set. One pass of grouping sets: no group is
    collected, and partial sums are made before the shuffle.
    """
    check_fields(df, *rows, *columns, *[f for _, f in values])
    sets = [[*rows, *columns]]
    if row_totals and columns:
        sets.append(list(rows))
    if column_totals and rows:
        sets.append(list(columns))
    if row_totals and column_totals and rows and columns:
        sets.append([])
    keys = [F.col(c) for c in (*rows, *columns)]
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *keys)
    aggs = [aggregate(kind, F.col(field)).alias(f"{kind}_{field}") for kind, field in values]
    grand = lambda own: F.greatest(*[F.grouping(c).cast("int") for c in own]) if len(own) > 1 else (F.grouping(own[0]).cast("int") if own else F.lit(0))
    return out.agg(*aggs, (grand(rows) == 1).alias("grand_row"), (grand(columns) == 1).alias("grand_column"))


def pivot_wide(df: DataFrame, rows: list[str], column: str, items: list, values: list[tuple[str, str]]) -> DataFrame:
    """One row for each combination of row items, a column for each item and value. Items are given, so there is no pass to find them."""
    check_fields(df, *rows, column, *[f for _, f in values])
    return df.groupBy(*rows).pivot(column, items).agg(*[aggregate(kind, F.col(field)).alias(f"{kind}_{field}") for kind, field in values])
