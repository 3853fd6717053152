"""Doors and windows from the gaps of walls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid
from .segments import MERGE_GAP, OPENING_GAP, walls_of

LEAF_RADIUS = 30.0
APART = 0.05
SWING, NO_SWING = 0.55, 0.45


def opening_candidates(segments: DataFrame) -> DataFrame:
    """Gaps within a wall: (plan_id, orient, grp, run, gap_start, gap_end)."""
    return walls_of(segments).where((F.col("gap") > MERGE_GAP) & (F.col("gap") <= OPENING_GAP)).select("plan_id", "orient", "grp", "run", "gap_start", F.col("a0").alias("gap_end"))


def classified(walls: DataFrame, leaves: DataFrame, *kept: str) -> DataFrame:
    """Openings with kind, width, place on the wall (0 to 1) and confidence; ``walls`` hold their gaps, ``kept`` are columns of theirs to keep.

    A leaf (a segment off the axes, by its middle mx, my) within LEAF_RADIUS of either end makes a door;
    else a gap in an exterior wall is a window, in another a door.  Walls of no length have no openings.
    Ends and leaves meet by cells of LEAF_RADIUS."""
    own = ["plan_id", "orient", "grp", "run", *kept, "s", "e", "fixed", "exterior"]
    o = walls.where("e > s").select(*own, F.explode("gaps").alias("g")).select(*own, "g.*").withColumn("end", F.explode(F.array("gap_start", "gap_end")))
    across = F.col("orient") == "h"
    o = o.withColumns({"px": F.when(across, F.col("end")).otherwise(F.col("fixed")), "py": F.when(across, F.col("fixed")).otherwise(F.col("end"))})
    o = grid.at(o, F.col("px"), F.col("py"), LEAF_RADIUS)
    near = grid.near(leaves.select(F.col("plan_id").alias("p"), "mx", "my"), F.col("mx"), F.col("my"), LEAF_RADIUS)
    dist = (F.col("mx") - F.col("px")) ** 2 + (F.col("my") - F.col("py")) ** 2
    met = o.join(near.hint("merge"), (F.col("plan_id") == F.col("p")) & (F.col("cx") == F.col("gx")) & (F.col("cy") == F.col("gy")), "left")
    out = met.groupBy(*own, "gap_start", "gap_end").agg(F.coalesce(F.bool_or(dist <= LEAF_RADIUS**2), F.lit(False)).alias("swing"))
    middle = (F.col("gap_start") + F.col("gap_end")) / 2
    place = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (middle - F.col("s")) / (F.col("e") - F.col("s"))))
    kind = F.when(F.col("swing"), "door").when(F.col("exterior"), "window").otherwise("door")
    confidence = F.when(F.col("swing"), SWING).otherwise(NO_SWING)
    return out.select("plan_id", "orient", "grp", "run", *kept, "gap_start", "gap_end", (F.col("gap_end") - F.col("gap_start")).alias("width"), place.alias("position"), kind.alias("kind"), "swing", confidence.alias("confidence"))


def suppressed(openings: Column) -> Column:
    """Of an array of (position, swing), sorted: those that stay, where neighbours nearer than APART give way to one with a swing."""

    def step(kept, x):
        last = F.element_at(kept, -1)
        close = (F.size(kept) > 0) & (F.abs(x["position"] - F.get(kept, F.size(kept) - 1)["position"]) < APART)
        better = ~last["swing"] & x["swing"]
        return F.when(~close, F.concat(kept, F.array(x))).when(better, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))).otherwise(kept)

    return F.aggregate(openings, F.array().cast("array<struct<position:double,swing:boolean>>"), step)


def suppress(openings: DataFrame, keys: list[str]) -> DataFrame:
    """One opening of each bunch on a wall; a wall's openings are few, whatever the number of walls."""
    per = openings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "swing"))).alias("o"))
    return per.select(*keys, F.explode(suppressed(F.col("o"))).alias("x")).select(*keys, "x.position", "x.swing")


def stays(openings: Column) -> Column:
    """Places (from 0) of those that stay of an array of struct<position, score, ...>, sorted by position, for any number of scores.

    Each that is not out yet puts out the later ones nearer than APART that score no more than it, and is put out by
    one that scores more; it still puts out the others then.  A wall's openings are few, so the fold may look at all."""
    n = F.size(openings)

    def step(out, i):
        own = F.get(openings, i)
        later = F.when(i + 1 < n, F.sequence(i + 1, n - 1)).otherwise(F.array().cast("array<int>"))
        rivals = F.filter(later, lambda j: ~F.array_contains(out, j) & (F.abs(F.get(openings, j)["position"] - own["position"]) < APART))
        lesser = F.filter(rivals, lambda j: F.get(openings, j)["score"] <= own["score"])
        beaten = F.exists(rivals, lambda j: F.get(openings, j)["score"] > own["score"])
        return F.when(F.array_contains(out, i), out).otherwise(F.concat(out, lesser, F.when(beaten, F.array(i)).otherwise(F.array().cast("array<int>"))))

    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_except(places, F.aggregate(places, F.array().cast("array<int>"), step))


def suppress_scored(openings: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, ord, position, score) that stay of each bunch of openings on a wall; equal positions are taken in order of ord."""
    per = openings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "ord", "score"))).alias("o"))
    kept = per.select(*keys, F.explode(F.transform(stays(F.col("o")), lambda i: F.get(F.col("o"), i))).alias("x"))
    return kept.select(*keys, "x.ord", "x.position", "x.score")
