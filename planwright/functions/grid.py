"""Square cells as equi-join keys for neighbours in a plane: one side stands in its own cell, the other in all that it may meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size)


def at(df: DataFrame, x: Column, y: Column, size: float) -> DataFrame:
    """``df`` with the cell (cx, cy) of the point (x, y)."""
    return df.withColumns({"cx": cell(x, size), "cy": cell(y, size)})


def within(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    """``df`` once for each cell (gx, gy) that the box meets; boxes with null sides are in none."""
    over = lambda a, b: F.sequence(cell(F.least(a, b), size), cell(F.greatest(a, b), size))
    return df.withColumn("gx", F.explode(over(x0, x1))).withColumn("gy", F.explode(over(y0, y1)))


def near(df: DataFrame, x: Column, y: Column, radius: float, size: float | None = None) -> DataFrame:
    """``df`` once for each cell that may hold a point within ``radius`` of (x, y)."""
    return within(df, x - radius, y - radius, x + radius, y + radius, size or radius)
