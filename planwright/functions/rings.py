"""Rings by Arrow-batched helpers: simplifying, and the order of border pieces.  Only numbers of corners come back from Python."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tasks carry these functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIMPLIFY = 0.01
RIGHT, DOWN, LEFT, UP = range(4)


def kept_corners(x: list[float], y: list[float], share: float) -> list[int]:
    """The corners of a closed ring that Douglas and Peucker's rule keeps, in order."""
    n = len(x)
    if n < 4:
        return list(range(n))
    step = [math.hypot(x[i] - x[i - 1], y[i] - y[i - 1]) for i in range(n)]
    limit = share * math.fsum(step)
    far = max(range(1, n), key=lambda i: ((x[i] - x[0]) ** 2 + (y[i] - y[0]) ** 2, -i))
    stack, kept = [(far, n), (0, far)], [0]
    while stack:
        a, b = stack.pop()
        dx, dy = x[b % n] - x[a], y[b % n] - y[a]
        wide, worst, at = math.hypot(dx, dy), limit, None
        for i in range(a + 1, b):
            d = abs(dx * (y[i] - y[a]) - dy * (x[i] - x[a])) / wide if wide else math.hypot(x[i] - x[a], y[i] - y[a])
            if d > worst:
                worst, at = d, i
        if at is None:
            kept.append(b)
        else:
            stack += [(at, b), (a, at)]
    return kept[:-1]


def walked(x1: list[float], y1: list[float], x2: list[float], y2: list[float], way: list[int]) -> list[int]:
    """The pieces of a region's outer border in order, from the topmost, leftmost that goes right; where two begin, the one to the right.

    A piece that goes straight on has no corner and is left out."""
    begins = {(x, y, w): k for k, (x, y, w) in enumerate(zip(x1, y1, way, strict=True))}
    first = k = min((k for k, w in enumerate(way) if w == RIGHT), key=lambda k: (y1[k], x1[k]))
    out = []
    while not out or k != first:
        if not out or way[k] != before:
            out.append(k)
        before = way[k]
        turns = (begins.get((x2[k], y2[k], (before + t) % 4)) for t in (1, 0, 3))
        k = next(t for t in turns if t is not None)
    return out


def _each(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(v is None for v in row) else f(*(list(v) for v in row)) for row in zip(*columns, strict=True)], dtype=object)


def simplify(ring: Column, share: float = SIMPLIFY) -> Column:
    """A closed ring by Douglas and Peucker: corners nearer than ``share`` of the perimeter to the line between kept ones go.

    The first corner and the one farthest from it (the first of equals) stay; a range is cut at its corner farthest
    from the line through its ends (the first of equals).  Rings of fewer than four corners and null come back as they are."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return _each(lambda a, b: kept_corners(a, b, share), x, y)

    kept = F.pandas_udf(run, "array<int>")(F.transform(ring, lambda p: p["x"].cast("double")), F.transform(ring, lambda p: p["y"].cast("double")))
    return F.transform(kept, lambda i: F.get(ring, i))


def outer_ring(border: Column) -> Column:
    """The outer ring of the border pieces (array of struct<x1, y1, x2, y2, way>) of a region, clockwise as seen."""

    def run(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series, way: pd.Series) -> pd.Series:
        return _each(walked, x1, y1, x2, y2, way)

    # Not to be repeated: conditions on what it gives would be moved before it, with a call of their own.
    order = F.pandas_udf(run, "array<int>").asNondeterministic()(*[border[c] for c in ("x1", "y1", "x2", "y2", "way")])  # a field of an array of structs is an array
    return F.transform(order, lambda i: F.struct(F.get(border, i)["x1"].alias("x"), F.get(border, i)["y1"].alias("y")))
