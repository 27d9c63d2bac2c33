"""Colour components, from 0 to 1, to eight bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp8(value: Column) -> Column:
    """0 to 255, halves up; what lies outside takes the nearer end, nulls are 0."""
    inside = F.least(F.greatest(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.floor(inside * 255 + 0.5).cast("int")


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(clamp8(r).alias("r"), clamp8(g).alias("g"), clamp8(b).alias("b"))


def gray(value: Column) -> Column:
    return rgb(value, value, value)


def cmyk(c: Column, m: Column, y: Column, k: Column) -> Column:
    """The plain device conversion: what an ink and black leave of the light."""
    return rgb(*[(1 - ink) * (1 - k) for ink in (c, m, y)])


def hex_of(colour: Column) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(colour[x]), 2, "0") for x in "rgb"]))
