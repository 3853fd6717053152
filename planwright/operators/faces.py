"""Room outlines from walls: the free regions between walls that are drawn as thick bars.

1. Every wall is a bar: its line, wider by half its thickness on all sides; bars along one line are joined.  The distinct
   coordinates of a plan's bars across y cut the plan into slabs; in a slab the bars leave free intervals, and those of one
   width in slabs that follow each other are a cell (windows and aggregates in the partitions that plans are dealt out to).
   A bar knows its slabs by the rank of its two coordinates, so work grows with bars times the slabs that each one covers.
2. Cells that overlap across a line are linked; components by the least cell that each one reaches, contracted in
   tasks by chunks of bounded size, then by rounds of joins where a plan has more.
3. A region of one cell is a rectangle.  The border of others: along each line, where cells of the region lie on one side only
   (running sums over their ends), with the region to the right hand.  Its pieces are traced from the topmost, leftmost one, at
   touching corners always to the right, so inner borders are left out.  The outline is as long as the result itself.
"""

from __future__ import annotations

import itertools
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, rings
from ..functions.rings import DOWN, LEFT, RIGHT, UP
from .checkpoints import cut
from .spreading import spread

# Tasks carry these functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 500_000
LEAST_AREA = 2000.0
MOST_OF_PLAN = 0.5  # a region at the border of the plan that is larger than this is the ground around the building
LEAST_POINTS = 3
BORDER = 1.0
THICKNESS, THINNEST = 4.0, 2.0
SLACK = 1e-9


def bars(walls: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, x0, x1, y0, y1, width, height): walls (plan_id, orient, s, e, fixed, thickness) as bars within the plan.

    Bars along one line that are equally thick and overlap or touch are one, so copies of walls multiply nothing.  Rows are dealt out by plan, as all that follows needs them."""
    half = F.greatest(F.lit(THINNEST), F.round(F.coalesce("thickness", F.lit(THICKNESS)))) / 2
    along, across = (F.col("s") - half, F.col("e") + half), (F.col("fixed") - half, F.col("fixed") + half)
    flat = F.col("orient") == "h"
    clip = lambda c, top: F.greatest(F.lit(0.0), F.least(c, top))
    size = plans.select(F.col("plan_id").alias("p"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    out = spread(walls.where("s is not null and e is not null and fixed is not null").select("plan_id", "orient", "s", "e", "fixed", "thickness"), "plan_id")
    out = out.join(size.hint("merge"), F.col("plan_id") == F.col("p")).withColumn("flat", F.coalesce(flat, F.lit(False)))
    pick = lambda a, b: F.when(F.col("flat"), F.col(a)).otherwise(F.col(b))
    far, wide = pick("width", "height"), pick("height", "width")
    box = {"a0": clip(along[0], far), "a1": clip(along[1], far), "c0": clip(across[0], wide), "c1": clip(across[1], wide)}
    out = out.select("plan_id", "flat", *[c.alias(n) for n, c in box.items()], "width", "height").where("a0 < a1 and c0 < c1")
    line = ["plan_id", "flat", "c0", "c1", "width", "height"]
    w = Window.partitionBy(*line).orderBy("a0", "a1")
    out = out.withColumn("end", F.max("a1").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    out = out.withColumn("nth", F.count(F.when(F.col("a0") > F.col("end"), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.groupBy(*line, "nth").agg(F.min("a0").alias("a0"), F.max("a1").alias("a1"))
    sides = ((pick("a0", "c0"), "x0"), (pick("a1", "c1"), "x1"), (pick("c0", "a0"), "y0"), (pick("c1", "a1"), "y1"))
    return out.select("plan_id", *[c.alias(n) for c, n in sides], "width", "height")


def cells(solid: DataFrame) -> DataFrame:
    """(plan_id, n, x0, x1, y0, y1, width, height): the free cells between ``bars``, numbered within the plan from the top left.

    A cell is as wide as it is free in its slab and goes on through slabs where it is just as wide."""
    own = ["plan_id", "width", "height"]
    by_y = Window.partitionBy(*own).orderBy("y")
    ends = solid.select(*own, "x0", "x1", "y0", "y1", F.explode(F.array("y0", "y1")).alias("y"))
    ends = ends.select(*own, "x0", "x1", "y0", "y1", "y", F.dense_rank().over(by_y).alias("k"), F.coalesce(F.lag("y").over(by_y), F.lit(0.0)).alias("before"), F.lead("y").over(by_y).alias("next"))
    of = lambda *c: F.struct(*[F.col(x).alias(n) if isinstance(x, str) else x.alias(n) for x, n in zip(c, ("x0", "x1", "y0", "y1", "k"), strict=True)])
    # A bar knows the slabs at its two sides; each slab has a bar of no width at the plan's right side, which knows the slab's own sides.
    slab = F.when(F.col("before") < F.col("y"), of("width", "width", "before", "y", F.col("k") - 1))
    last = F.when(F.col("next").isNull() & (F.col("y") < F.col("height")), of("width", "width", "y", "height", "k"))
    ends = ends.select(*own, F.explode(F.array_compact(F.array(of("x0", "x1", "y0", "y1", "k"), slab, last))).alias("end")).select(*own, "end.*")
    ends = ends.groupBy(*own, "x0", "x1", "y0", "y1").agg(F.min("k").alias("from"), F.max("k").alias("to"))
    filled = ends.select(*own, F.explode(F.sequence("from", F.greatest(F.col("from"), F.col("to") - 1))).alias("k"), "x0", "x1", *[F.when(F.col("x0") == F.col("x1"), F.col(y)).alias(y) for y in ("y0", "y1")])
    along = Window.partitionBy(*own, "k").orderBy("x0", "x1")
    every = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    end = F.coalesce(F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = filled.withColumns({"end": end, "top": F.max("y0").over(every), "low": F.max("y1").over(every)}).where(F.col("x0") > F.col("end"))
    free = free.select(*own, "k", F.col("end").alias("x0"), F.col("x0").alias("x1"), F.col("top").alias("y0"), F.col("low").alias("y1"))
    down = Window.partitionBy(*own, "x0", "x1").orderBy("k")
    free = free.withColumn("nth", F.col("k") - F.row_number().over(down)).groupBy(*own, "x0", "x1", "nth").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return free.select("plan_id", F.row_number().over(Window.partitionBy("plan_id").orderBy("y0", "x0")).alias("n"), "x0", "x1", "y0", "y1", "width", "height")


def links(free: DataFrame) -> DataFrame:
    """(plan_id, a, b) of cells that touch across a line: each with the one that reaches farthest of those that begin before it.

    Cells on one side of a line never meet, so these links connect what all pairs would, by one window."""
    side = free.select("plan_id", "n", "x0", "x1", F.explode(F.array("y0", "y1")).alias("y"))
    w = Window.partitionBy("plan_id", "y").orderBy("x0", "n").rowsBetween(Window.unboundedPreceding, -1)
    met = side.withColumn("far", F.max(F.struct("x1", "n")).over(w)).where(F.col("far.x1") > F.col("x0"))
    return met.select("plan_id", F.col("n").alias("a"), F.col("far.n").alias("b"))


def stars(plan: pd.Series, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Links (plan, a, b), b the least node of its plan that a reaches by the links given; nodes that are least have none."""
    code, plans = pd.factorize(plan)
    # Nodes by plan and number: a plan's numbers take the range up to its greatest.
    least, most = np.full(len(plans), np.iinfo(np.int64).max), np.full(len(plans), np.iinfo(np.int64).min)
    for n in (a, b):
        np.minimum.at(least, code, n)
        np.maximum.at(most, code, n)
    shift = np.cumsum(most - least + 1) - most - 1
    nodes, at = np.unique(np.concatenate([a + shift[code], b + shift[code]]), return_inverse=True)
    i, j = np.split(at.ravel(), 2)
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    far = np.flatnonzero(label != np.arange(len(label)))
    own = np.searchsorted(most + shift, nodes[far])
    return pd.DataFrame({"plan_id": plans[own], "a": nodes[far] - shift[own], "b": nodes[label[far]] - shift[own]})


def contracted(edges: DataFrame) -> DataFrame:
    """Links (plan_id, a, b, part) with the same components: each task turns what it has, CHUNK links at a time, into stars.

    Chunks end where a plan ends; plans of more links than that are told by ``part``, and their stars are still to be joined."""

    def run(frames):
        waiting, n, parted = [], 0, None
        for f in itertools.chain(frames, [None]):
            if f is not None:
                waiting.append(f)
                n += len(f)
            if n >= CHUNK or (f is None and n):
                had = pd.concat(waiting)
                last = had["plan_id"].iloc[-1]
                whole = np.ones(len(had), bool) if f is None else (had["plan_id"] != last).to_numpy()
                if not whole.any():
                    whole, parted = ~whole, last
                done, rest = had[whole], had[~whole]
                out = stars(done["plan_id"], done["a"].to_numpy(), done["b"].to_numpy())
                yield out.assign(part=(out["plan_id"] == parted).to_numpy() if parted is not None else np.zeros(len(out), bool))
                waiting, n = [rest], len(rest)

    kind = edges.schema["plan_id"].dataType.simpleString()
    dealt = spread(edges.select("plan_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "plan_id").sortWithinPartitions("plan_id")
    return dealt.mapInPandas(run, f"plan_id {kind}, a bigint, b bigint, part boolean")


def least_reached(edges: DataFrame) -> DataFrame:
    """(plan_id, n, label): the least node of its plan that each node reaches over ``edges`` (plan_id, a, b); least nodes and lone ones have no row.

    Links are contracted in tasks first, which settles plans of up to CHUNK links.  What is left takes rounds: the
    least label of the neighbours, and then the label of that label, so the way grows by doubling."""
    star = cut(contracted(edges))
    settled = star.where("not part").select("plan_id", F.col("a").alias("n"), F.col("b").alias("label"))
    star = star.where("part").drop("part")
    own = lambda d, *c: d.select(*[F.col(x).alias(y) for x, y in zip(("plan_id", "n", "label"), c, strict=False)])
    if star.isEmpty():
        return settled
    both = cut(star.select("plan_id", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("plan_id", "e.*"))
    state = cut(both.groupBy("plan_id", F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(own(state, "p", "m", "l"), (F.col("plan_id") == F.col("p")) & (F.col("b") == F.col("m"))).groupBy(F.col("plan_id").alias("p"), F.col("a").alias("m")).agg(F.min("l").alias("l"))
        low = state.join(near, (F.col("plan_id") == F.col("p")) & (F.col("n") == F.col("m"))).select("plan_id", "n", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        state = cut(low.join(own(low, "p", "m", "l"), (F.col("plan_id") == F.col("p")) & (F.col("label") == F.col("m"))).select("plan_id", "n", "old", F.col("l").alias("label")))
        if state.where("old <> label").isEmpty():
            return settled.unionByName(state.where("n <> label").select("plan_id", "n", "label"))


def pieces(regions: DataFrame) -> DataFrame:
    """(plan_id, label, x1, y1, x2, y2, way) of the borders of regions, cells with a label; the region is to the right of each piece.

    Along x a cell's border lies where only one side of the line is free.  Along y all of it is border, as a bar is beyond."""
    end = lambda y, x, d: F.struct(F.col(y).alias("y"), F.col(x).alias("x"), F.lit(d).alias("d"))
    ends = regions.select("plan_id", "label", F.explode(F.array(end("y0", "x0", 1), end("y0", "x1", -1), end("y1", "x0", -1), end("y1", "x1", 1))).alias("e"))
    ends = ends.groupBy("plan_id", "label", "e.y", "e.x").agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy("plan_id", "label", "y").orderBy("x")
    # +1 where a cell begins there, -1 where one ends, 0 where both or none do.
    run = ends.where("d <> 0").withColumns({"is": F.sum("d").over(w), "next": F.lead("x").over(w)}).where(F.col("is") != 0)
    ahead = F.col("is") > 0
    a, b = F.when(ahead, F.col("x")).otherwise(F.col("next")), F.when(ahead, F.col("next")).otherwise(F.col("x"))
    flat = run.select("plan_id", "label", a.alias("x1"), F.col("y").alias("y1"), b.alias("x2"), F.col("y").alias("y2"), F.when(ahead, RIGHT).otherwise(LEFT).alias("way"))
    piece = lambda x, y1, y2, way: F.struct(F.col(x).alias("x1"), F.col(y1).alias("y1"), F.col(x).alias("x2"), F.col(y2).alias("y2"), F.lit(way).alias("way"))
    steep = regions.select("plan_id", "label", F.explode(F.array(piece("x1", "y0", "y1", DOWN), piece("x0", "y1", "y0", UP))).alias("s")).select("plan_id", "label", "s.*")
    return flat.unionByName(steep)


def outlines(walls: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, room_id, polygon, area) of the rooms between ``walls`` of ``plans`` (plan_id, width, height).

    Rooms are regions of LEAST_AREA at least that are not the ground around the building, numbered from the top left
    of each plan.  Rings have their corners only; ``simplified`` takes more of them away.  Plans without walls have no
    rooms; walls of unknown plans, or with null coordinates, are left out."""
    free = cut(cells(bars(walls, plans)))
    label = least_reached(links(free)).select(F.col("plan_id").alias("p"), F.col("n").alias("m"), F.col("label").alias("l"))
    met = (F.col("plan_id") == F.col("p")) & (F.col("n") == F.col("m"))
    regions = spread(free, "plan_id").join(label.hint("merge"), met, "left").withColumn("label", F.coalesce("l", F.col("n").cast("long"))).drop("p", "m", "l")
    whole = Window.partitionBy("plan_id", "label")
    box = F.struct(*[f("x0" if c == "x" else "y0").over(whole).alias(f"{c}0") for c, f in (("x", F.min), ("y", F.min))], *[F.max(f"{c}1").over(whole).alias(f"{c}1") for c in "xy"])
    regions = regions.withColumns({"cells": F.count("*").over(whole), "free": F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).over(whole), "box": box})
    at_border = (F.col("box.x0") <= BORDER) | (F.col("box.y0") <= BORDER) | (F.col("box.x1") >= F.col("width") - BORDER) | (F.col("box.y1") >= F.col("height") - BORDER)
    most = MOST_OF_PLAN * F.col("width") * F.col("height")
    # A ring takes its region's cells at least and its box at most: what is settled by these, but for rounding, is not traced.
    tiny = (F.col("box.x1") - F.col("box.x0")) * (F.col("box.y1") - F.col("box.y0")) < LEAST_AREA * (1 - SLACK)
    regions = cut(regions.where(~tiny & ~(at_border & (F.col("free") > most * (1 + SLACK)))))
    of = ["plan_id", "label", "width", "height", "box"]
    corners = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    one = regions.where("cells = 1").select(*of, geometry.rectangle(*corners).alias("polygon"), F.col("free").alias("area"))
    many = regions.where("cells > 1")
    found = pieces(many).groupBy("plan_id", "label").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2", "way")).alias("border"))
    size = many.groupBy(F.col("plan_id").alias("p"), F.col("label").alias("l")).agg(*[F.first(c).alias(c) for c in of[2:]])
    found = found.join(size.hint("merge"), (F.col("plan_id") == F.col("p")) & (F.col("label") == F.col("l"))).select(*of, rings.outer_ring(F.col("border")).alias("polygon"))
    rooms = one.unionByName(found.withColumn("area", geometry.area(F.col("polygon")))).where((F.col("area") >= LEAST_AREA) & ~(at_border & (F.col("area") > most)) & (F.size("polygon") >= LEAST_POINTS))
    number = F.row_number().over(Window.partitionBy("plan_id").orderBy("box.y0", "box.x0", "label"))
    return rooms.select("plan_id", number.alias("room_id"), "polygon", "area")


def simplified(outlines: DataFrame, share: float = rings.SIMPLIFY) -> DataFrame:
    """``outlines`` with their polygon simplified; those left with fewer than LEAST_POINTS go."""
    return outlines.withColumn("polygon", rings.simplify(F.col("polygon"), share)).where(F.size("polygon") >= LEAST_POINTS)
