"""Column helpers for segments and rings of struct<x, y>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HORIZONTAL, VERTICAL = "horizontal", "vertical"
AXIS_TOLERANCE = 10.0  # degrees


def length(x1, y1, x2, y2) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def angle(x1, y1, x2, y2) -> Column:
    return F.degrees(F.atan2(y2 - y1, x2 - x1))


def orientation(degrees: Column, tolerance: float = AXIS_TOLERANCE) -> Column:
    """Horizontal, vertical or null; bounds included."""
    a = F.pmod(degrees, F.lit(180.0))
    return F.when((a <= tolerance) | (a >= 180 - tolerance), HORIZONTAL).when(a.between(90 - tolerance, 90 + tolerance), VERTICAL)


def _next(ring: Column, i: Column) -> Column:
    return F.get(ring, ((i + 1) % F.size(ring)).cast("int"))


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is strictly inside an open ring: even-odd, the boundary excluded."""
    at = F.sequence(F.lit(0), F.size(ring) - 1)

    def crosses(acc, i):
        p, q = F.get(ring, i), _next(ring, i)
        where = p["x"] + F.try_divide((y - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"])
        return acc != (((p["y"] > y) != (q["y"] > y)) & F.coalesce(x < where, F.lit(False)))

    def on(i):
        p, q = F.get(ring, i), _next(ring, i)
        cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        return (cross == 0) & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    return (F.size(ring) >= 3) & F.aggregate(at, F.lit(False), crosses) & ~F.exists(at, on)


def area(ring: Column) -> Column:
    """Shoelace area of an open ring."""
    at = F.sequence(F.lit(0), F.size(ring) - 1)
    twice = F.aggregate(at, F.lit(0.0), lambda a, i: a + F.get(ring, i)["x"] * _next(ring, i)["y"] - _next(ring, i)["x"] * F.get(ring, i)["y"])
    return F.abs(twice) / 2


def perimeter(ring: Column) -> Column:
    at = F.sequence(F.lit(0), F.size(ring) - 1)
    return F.aggregate(at, F.lit(0.0), lambda a, i: a + F.hypot(_next(ring, i)["x"] - F.get(ring, i)["x"], _next(ring, i)["y"] - F.get(ring, i)["y"]))


def bounds(ring: Column) -> Column:
    """The box of a ring as struct<x0, y0, x1, y1>; nulls for an empty ring."""
    of = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    return F.struct(of(F.array_min, "x").alias("x0"), of(F.array_min, "y").alias("y0"), of(F.array_max, "x").alias("x1"), of(F.array_max, "y").alias("y1"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))
