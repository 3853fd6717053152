"""Walls and stairs from line segments.

A plan's segments are told apart by key columns, always first in the partitions of windows, so one
exchange by plan serves clustering, run merging, the aggregate over both and the box of the plan.  Every window has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spreading import spread

WALL_TOLERANCE, FRAGMENT_TOLERANCE, STAIR_TOLERANCE = 8.0, 3.0, 18.0
MERGE_GAP, OPENING_GAP = 6.0, 160.0
EXTERIOR_TOLERANCE = 12.0
STAIR_LONGEST, STAIR_RATIO, STAIR_EXTENT, STAIR_IRREGULAR, STAIR_LEAST = 90.0, 1.8, 220.0, 0.5, 3


def cluster_1d(df: DataFrame, keys: list[str], value: str, tolerance, order: list[str], out: str = "grp") -> DataFrame:
    """Single linkage along ``value``: a new group where the step from the one before exceeds ``tolerance``."""
    w = Window.partitionBy(*keys).orderBy(value, *order)
    step = F.col(value) - F.lag(value).over(w)
    return df.withColumn("_new", F.when(step > tolerance, 1).otherwise(0)).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def with_runs(df: DataFrame, keys: list[str], merge: float = MERGE_GAP, opening: float = OPENING_GAP) -> DataFrame:
    """Clusters ``keys`` of intervals (a0, a1) cut into runs: ``gap`` to the furthest end so far, ``run`` its number.

    Gaps up to ``merge`` close, up to ``opening`` are openings within a run, beyond start a new run."""
    w = Window.partitionBy(*keys).orderBy("a0", "a1")
    end = F.max("a1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (
        df.withColumn("gap_start", end).withColumn("gap", F.col("a0") - end)
        .withColumn("_new", F.when(F.col("gap") > opening, 1).otherwise(0))
        .withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    )


def walls_of(segments: DataFrame) -> DataFrame:
    """Segments (plan_id, orient, perp, a0, a1) with the group and run of their wall, dealt out by plan for all that follows."""
    return with_runs(cluster_1d(spread(segments, "plan_id"), ["plan_id", "orient"], "perp", WALL_TOLERANCE, ["a0", "a1"]), ["plan_id", "orient", "grp"])


def wall_runs(segments: DataFrame, gaps: bool = False) -> DataFrame:
    """Walls with their votes and openings, the fixed coordinate of their whole cluster and, where segments have one, the mean thickness.

    With ``gaps`` a wall holds its openings too, as an array of struct<gap_start, gap_end>."""
    opening = (F.col("gap") > MERGE_GAP) & (F.col("gap") <= OPENING_GAP)
    fixed = F.avg("perp").over(Window.partitionBy("plan_id", "orient", "grp"))
    thickness = [F.avg("thickness").alias("thickness")] if "thickness" in segments.columns else []
    held = [F.collect_list(F.when(opening, F.struct("gap_start", F.col("a0").alias("gap_end")))).alias("gaps")] if gaps else []
    return walls_of(segments).withColumn("fixed", fixed).groupBy("plan_id", "orient", "grp", "run").agg(
        F.min("a0").alias("s"), F.max("a1").alias("e"), F.sum(F.col("a1") - F.col("a0")).alias("votes"), F.count("*").alias("n"), F.count_if(opening).alias("openings"), F.max("fixed").alias("fixed"), *thickness, *held
    )


def walls(segments: DataFrame, gaps: bool = False) -> DataFrame:
    """Walls with their confidence and whether they are exterior; with ``gaps`` their openings too."""
    return exterior(wall_runs(segments, gaps).withColumn("confidence", wall_confidence(F.col("votes"), F.col("e") - F.col("s"))))


def wall_confidence(votes: Column, length: Column) -> Column:
    return F.when(length <= 0, 0.5).otherwise(F.round(0.5 + 0.5 * F.least(F.lit(1.0), F.try_divide(votes, length)), 3))


def exterior(walls: DataFrame, tolerance: float = EXTERIOR_TOLERANCE) -> DataFrame:
    """Exterior: the fixed coordinate is near the least or greatest of the plan's box on its axis."""
    across = F.col("orient") == "h"  # a horizontal wall runs along x at y = fixed
    w = Window.partitionBy("plan_id")
    low = lambda a, b: F.min(F.when(across, F.col(a)).otherwise(F.col(b))).over(w)
    high = lambda a, b: F.max(F.when(across, F.col(a)).otherwise(F.col(b))).over(w)
    box = walls.withColumns({"_y0": low("fixed", "s"), "_y1": high("fixed", "e"), "_x0": low("s", "fixed"), "_x1": high("e", "fixed")})
    near = lambda a, b: (F.abs(F.col("fixed") - F.col(a)) <= tolerance) | (F.abs(F.col("fixed") - F.col(b)) <= tolerance)
    return box.withColumn("exterior", F.when(across, near("_y0", "_y1")).otherwise(near("_x0", "_x1"))).drop("_x0", "_x1", "_y0", "_y1")


def stair_clusters(segments: DataFrame) -> DataFrame:
    """Plausible flights: short treads of like length at regular steps, with their box.

    Fragments at one place across the axis are one tread first, however far apart along it."""
    short = segments.where(F.col("a1") - F.col("a0") <= STAIR_LONGEST)
    tread = cluster_1d(short, ["plan_id", "orient"], "perp", FRAGMENT_TOLERANCE, ["a0", "a1"], "frag").groupBy("plan_id", "orient", "frag").agg(F.min("a0").alias("a0"), F.max("a1").alias("a1"), F.avg("perp").alias("perp"))
    found = cluster_1d(tread, ["plan_id", "orient"], "perp", STAIR_TOLERANCE, ["frag"], "flight")
    w = Window.partitionBy("plan_id", "orient", "flight").orderBy("perp", "frag")
    n = F.col("a1") - F.col("a0")
    got = found.withColumn("gap", F.col("perp") - F.lag("perp").over(w)).groupBy("plan_id", "orient", "flight").agg(
        F.count("*").alias("treads"), F.min("a0").alias("a0"), F.max("a1").alias("a1"), F.min("perp").alias("p0"), F.max("perp").alias("p1"),
        F.max(n).alias("longest"), F.min(n).alias("shortest"), F.median("gap").alias("middle"), F.stddev_pop("gap").alias("spread"),
    )
    like = F.col("longest") <= STAIR_RATIO * F.greatest(F.col("shortest"), F.lit(1e-6))
    compact = F.greatest(F.col("a1") - F.col("a0"), F.col("p1") - F.col("p0")) <= STAIR_EXTENT
    regular = (F.col("middle") > 0) & (F.col("spread") <= STAIR_IRREGULAR * F.col("middle") + 1e-9)
    return got.where((F.col("treads") >= STAIR_LEAST) & like & compact & regular).select("plan_id", "orient", "flight", "treads", "a0", "a1", "p0", "p1")
