"""Binary images as runs of ink: rows (plan_id, y, x0, x1) for the pixels x0 up to, not including, x1 of line y, or as boxes
(plan_id, y0, y1, x0, x1) where lines y0 up to y1 are alike.

Set algebra by running sums over ends, long strokes of either direction, and the thickness of walls.  A plan is cut into
slabs at the ends of its boxes, so lines that are alike are one row until the result is laid out by line; pixels are
never rows.  Rows are dealt out by plan once, before they multiply; all that follows stays within a plan's task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid
from .spreading import spread

LONGEST_DETAIL = 70  # shorter runs are no walls
PROBE = 25  # pixels to either side of a wall's middle
UNMEASURED = 4.0
BIN = 64.0
BOX = ("plan_id", "y0", "y1", "x0", "x1")


def stroke_boxes(strokes: DataFrame) -> DataFrame:
    """Strokes along an axis (plan_id, orient, perp, a0, a1, thickness) as boxes of ink, which may overlap."""
    wide = F.greatest(F.lit(1), F.round("thickness").cast("long"))
    low = F.round(F.col("perp") - F.col("thickness") / 2).cast("long")
    a0, a1 = F.round("a0").cast("long"), F.round("a1").cast("long")
    pick = lambda h, v: F.when(F.col("orient") == "h", h).otherwise(v)
    return strokes.select("plan_id", pick(low, a0).alias("y0"), pick(low + wide, a1).alias("y1"), pick(a0, low).alias("x0"), pick(a1, low + wide).alias("x1")).where("x0 < x1 and y0 < y1")


def drawn(strokes: DataFrame) -> DataFrame:
    """The runs of strokes along an axis (plan_id, orient, perp, a0, a1, thickness); runs of different strokes may overlap."""
    return by_line(stroke_boxes(strokes))


def by_line(boxes: DataFrame) -> DataFrame:
    """Boxes as runs of their lines."""
    return boxes.select("plan_id", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), "x0", "x1")


def _boxes(ink: DataFrame) -> DataFrame:
    """Runs, each a box one line high, or boxes; those of no size go."""
    own = ink.select("plan_id", F.col("y").alias("y0"), (F.col("y") + 1).alias("y1"), "x0", "x1") if "y" in ink.columns else ink.select(*BOX)
    return own.where("x0 < x1 and y0 < y1")


def _turned(boxes: DataFrame) -> DataFrame:
    """Boxes with x and y exchanged."""
    return boxes.select("plan_id", F.col("x0").alias("y0"), F.col("x1").alias("y1"), F.col("y0").alias("x0"), F.col("y1").alias("x1"))


def _combined(boxes: DataFrame, rule) -> DataFrame:
    """Boxes (BOX, a, b: whether in a, in b, 1 or 0) as the boxes of the pixels for which ``rule(in a, in b)`` holds.

    A slab lies between neighbouring distinct y of a plan's boxes.  Its number is the rank of its upper side; each box
    stands in the slabs that it covers and tells the sides that it has in common with them by rows without x, which come first."""
    ranked = boxes.withColumn("y", F.explode(F.array("y0", "y1"))).withColumn("k", F.dense_rank().over(Window.partitionBy("plan_id").orderBy("y")))
    placed = ranked.groupBy(*BOX, "a", "b").agg(F.min("k").alias("from"), F.max("k").alias("to"))
    null = F.lit(None).cast("long")

    def event(k, x=null, sign=0, upper=null, lower=null):
        return F.struct(k.alias("k"), x.cast("long").alias("x"), (F.col("a") * sign).alias("a"), (F.col("b") * sign).alias("b"), upper.cast("long").alias("upper"), lower.cast("long").alias("lower"))

    covered = F.sequence("from", F.col("to") - 1)
    inner = F.flatten(F.transform(covered, lambda k: F.array(event(k, F.col("x0"), 1), event(k, F.col("x1"), -1))))
    sides = F.array(event(F.col("from"), upper=F.col("y0")), event(F.col("from") - 1, lower=F.col("y0")), event(F.col("to"), upper=F.col("y1")), event(F.col("to") - 1, lower=F.col("y1")))
    events = placed.select("plan_id", F.explode(F.concat(sides, inner)).alias("e")).select("plan_id", "e.*")
    along = Window.partitionBy("plan_id", "k").orderBy("x")
    met = events.groupBy("plan_id", "k", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("upper").alias("upper"), F.max("lower").alias("lower"))
    met = met.select("plan_id", "k", "x", rule(F.sum("a").over(along) > 0, F.sum("b").over(along) > 0).alias("in"), F.max("upper").over(along).alias("y0"), F.max("lower").over(along).alias("y1"))
    turns = met.withColumn("was", F.lag("in", 1, False).over(along)).where(F.col("in") != F.col("was"))
    return turns.withColumn("x1", F.lead("x").over(along)).where("in").select("plan_id", "y0", "y1", F.col("x").alias("x0"), "x1")


def combined_boxes(a: DataFrame, b: DataFrame | None, rule) -> DataFrame:
    """The boxes of the pixels for which ``rule(in a, in b)`` holds; it must not hold for pixels in neither.

    Those of a slab are apart and as wide as can be.  Both must be dealt out by plan for it to stay in a plan's task."""
    marked = lambda ink, of_a, of_b: ink.select(*BOX, F.lit(of_a).alias("a"), F.lit(of_b).alias("b"))
    return _combined(marked(a, 1, 0) if b is None else marked(a, 1, 0).unionByName(marked(b, 0, 1)), rule)


def combined(a: DataFrame, b: DataFrame | None, rule) -> DataFrame:
    """The runs of the pixels for which ``rule(in a, in b)`` holds; it must not hold for pixels in neither.  Runs come out apart and as long as can be."""
    dealt = lambda ink: None if ink is None else spread(_boxes(ink), "plan_id")
    return by_line(combined_boxes(dealt(a), dealt(b), rule))


def _either(x: Column, y: Column) -> Column:
    return x | y


def _only(x: Column, y: Column) -> Column:
    return x & ~y


def union(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """The pixels of either; of ``a`` alone, its runs without overlaps."""
    return combined(a, b, _either)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The pixels of ``a`` that are not in ``b``."""
    return combined(a, b, _only)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return combined(a, b, lambda x, y: x & y)


def _apart(ink: DataFrame) -> DataFrame:
    """Boxes of ``ink`` without overlaps, dealt out by plan; within a slab as wide as can be."""
    return combined_boxes(spread(_boxes(ink), "plan_id"), None, _either)


def _wide(apart: DataFrame, least: int) -> DataFrame:
    return apart.where(F.col("x1") - F.col("x0") >= least)


def _tall(apart: DataFrame, least: int) -> DataFrame:
    """Strips of ``least`` lines or more: boxes that stand on each other are one between neighbouring x."""
    return _turned(_wide(combined_boxes(_turned(apart), None, _either), least))


def long_rows(ink: DataFrame, least: int = LONGEST_DETAIL) -> DataFrame:
    """The runs of ``least`` pixels or more along lines."""
    return by_line(_wide(_apart(ink), least))


def long_columns(ink: DataFrame, least: int = LONGEST_DETAIL) -> DataFrame:
    """The pixels in columns of ``least`` or more, one above the other; runs may touch."""
    return by_line(_tall(_apart(ink), least))


def _walls(apart: DataFrame, least: int) -> DataFrame:
    return combined_boxes(_wide(apart, least), _tall(apart, least), _either)


def wall_mask(ink: DataFrame, least: int = LONGEST_DETAIL) -> DataFrame:
    """The ink of strokes of ``least`` pixels or more along either axis."""
    return by_line(_walls(_apart(ink), least))


def detail_mask(ink: DataFrame, least: int = LONGEST_DETAIL) -> DataFrame:
    """The ink that is no wall, where stairs are looked for."""
    apart = _apart(ink)
    long = _wide(apart, least).unionByName(_tall(apart, least))
    return by_line(combined_boxes(apart, long, _only))


def _middle(c: Column) -> Column:
    return F.bround(c).cast("long")


def thickness(walls: DataFrame, ink: DataFrame) -> DataFrame:
    """(plan_id, wall_id, thickness): the ink within PROBE pixels across the middle of each wall (plan_id, wall_id, orient, s, e, fixed).

    Walls without any have UNMEASURED.  Probes and boxes of ink meet by squares of BIN pixels and are cut at them, so
    each pixel counts once.  Joins are by sorting: files tell too little of rows that multiply for one side to be sent to all."""
    along, across = _middle((F.col("s") + F.col("e")) / 2), _middle(F.col("fixed"))
    pick = lambda h, v: F.when(F.col("orient") == "h", h).otherwise(v)
    probes = walls.select("plan_id", "wall_id", pick(across - PROBE, along).alias("y0"), pick(across + PROBE, along).alias("y1"), pick(along, across - PROBE).alias("x0"), pick(along, across + PROBE).alias("x1"))
    probes = grid.within(probes, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), BIN)
    size = int(BIN)
    boxes = grid.within(_apart(ink), F.col("x0"), F.col("y0"), F.col("x1") - 1, F.col("y1") - 1, BIN)
    boxes = boxes.select(
        F.col("plan_id").alias("p"), F.col("gx").alias("bx"), F.col("gy").alias("by"), F.greatest("x0", F.col("gx") * size).alias("u0"), F.least(F.col("x1"), (F.col("gx") + 1) * size).alias("u1"),
        F.greatest("y0", F.col("gy") * size).alias("v0"), F.least(F.col("y1"), (F.col("gy") + 1) * size).alias("v1"),
    )
    meet = (F.col("u0") <= F.col("x1")) & (F.col("u1") > F.col("x0")) & (F.col("v0") <= F.col("y1")) & (F.col("v1") > F.col("y0"))
    met = probes.join(boxes.hint("merge"), (F.col("plan_id") == F.col("p")) & (F.col("gx") == F.col("bx")) & (F.col("gy") == F.col("by")) & meet)
    side = lambda a0, a1, b0, b1: F.least(F.col(a1) - 1, b1) - F.greatest(a0, b0) + 1
    inked = met.groupBy(F.col("plan_id").alias("p"), F.col("wall_id").alias("w")).agg(F.sum(side("u0", "u1", "x0", "x1") * side("v0", "v1", "y0", "y1")).alias("n"))
    out = walls.select("plan_id", "wall_id").join(inked.hint("merge"), (F.col("plan_id") == F.col("p")) & (F.col("wall_id") == F.col("w")), "left")
    return out.select("plan_id", "wall_id", F.when(F.col("n") > 0, F.col("n").cast("double")).otherwise(UNMEASURED).alias("thickness"))
