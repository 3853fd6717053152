"""Runs of ink against loops over pixels."""

import random
import re

import pytest
from pyspark.sql import functions as F

from planwright.operators import runs

INK = "plan_id int, y long, x0 long, x1 long"
LEAST = 7
rng = random.Random(8)
ROWS = [(p, rng.randrange(30), s := rng.randrange(40), s + rng.randrange(0, 14)) for p in (1, 2) for _ in range(260)] + [(2, y, 50, 53) for y in range(30)] + [(3, 5, 0, 7), (3, 6, 0, 6)]


def pixels(rows):
    return {(p, x, y) for p, y, x0, x1 in rows for x in range(x0, x1)}


def as_runs(dots):
    out, left = [], set(dots)
    for p, x, y in sorted(dots, key=lambda d: (d[0], d[2], d[1])):
        if (p, x - 1, y) not in left:
            end = x
            while (p, end, y) in left:
                end += 1
            out.append((p, y, x, end))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("plan_id", "y", "x0", "x1").collect())


def long(dots, dx, dy):
    out = set()
    for p, x, y in dots:
        n = {s: next(k for k in range(1, 99) if (p, x + s * k * dx, y + s * k * dy) not in dots) for s in (1, -1)}
        if n[1] + n[-1] - 1 >= LEAST:
            out.add((p, x, y))
    return out


@pytest.fixture(scope="module")
def ink(spark):
    return spark.createDataFrame(ROWS, INK)


def test_algebra_of_runs(spark, ink):
    other = [(p, y, x0 + 3, x1 + 5) for p, y, x0, x1 in ROWS[::3]] + [(9, 1, 2, 4)]
    a, b, o = pixels(ROWS), pixels(other), spark.createDataFrame(other, INK)
    assert rows(runs.union(ink)) == as_runs(a)
    assert rows(runs.union(ink, o)) == as_runs(a | b)
    assert rows(runs.difference(ink, o)) == as_runs(a - b)
    assert rows(runs.intersection(ink, o)) == as_runs(a & b)
    assert rows(runs.union(ink.limit(0))) == []


def test_masks_equal_a_loop_over_pixels(ink):
    dots = pixels(ROWS)
    wall = long(dots, 1, 0) | long(dots, 0, 1)
    assert rows(runs.long_rows(ink, LEAST)) == as_runs(long(dots, 1, 0))
    assert rows(runs.union(runs.long_columns(ink, LEAST))) == as_runs(long(dots, 0, 1))
    assert rows(runs.wall_mask(ink, LEAST)) == as_runs(wall)
    assert rows(runs.detail_mask(ink, LEAST)) == as_runs(dots - wall)


def test_thickness_counts_the_ink_across_the_middle(spark, ink):
    dots = pixels(ROWS)
    walls = [(p, f"{p}{o}{k}", o, float(rng.randrange(20)), float(rng.randrange(20, 60)), rng.randrange(60) / 2) for p in (1, 2, 4) for o in "hv" for k in range(12)]
    want = {}
    for p, i, o, s, e, f in walls:
        m, c = round((s + e) / 2), round(f)
        want[i] = sum(((p, m, c + d) if o == "h" else (p, c + d, m)) in dots for d in range(-25, 26)) or 4.0
    got = runs.thickness(spark.createDataFrame(walls, "plan_id int, wall_id string, orient string, s double, e double, fixed double"), ink)
    assert {r.wall_id: r.thickness for r in got.collect()} == want


def test_drawn_strokes(spark):
    strokes = spark.createDataFrame([(1, "h", 10.0, 0.0, 3.0, 2.0), (1, "v", 5.0, 1.0, 3.0, 3.0), (1, "h", 1.0, 4.0, 4.0, 2.0)], "plan_id int, orient string, perp double, a0 double, a1 double, thickness double")
    assert pixels(rows(runs.drawn(strokes))) == {(1, x, y) for x in range(3) for y in (9, 10)} | {(1, x, y) for x in (4, 5, 6) for y in (1, 2)}


BOXES = [(p, y := rng.randrange(40), y + rng.randrange(0, 14), x := rng.randrange(60), x + rng.randrange(0, 12)) for p in (1, 2, 3) for _ in range(40)]


def test_masks_of_boxes_equal_a_loop_over_pixels(spark):
    dots = {(p, x, y) for p, y0, y1, x0, x1 in BOXES for x in range(x0, x1) for y in range(y0, y1)}
    boxes = spark.createDataFrame(BOXES, "plan_id int, y0 long, y1 long, x0 long, x1 long")
    wall = long(dots, 1, 0) | long(dots, 0, 1)
    assert rows(runs.wall_mask(boxes, LEAST)) == as_runs(wall)
    assert rows(runs.detail_mask(boxes, LEAST)) == as_runs(dots - wall)


@pytest.mark.parametrize("mask", [runs.wall_mask, runs.detail_mask])
def test_masks_shuffle_nothing_but_strokes(spark, capsys, mask):
    """All that follows the strokes, which are few against their lines, stays where they were dealt out by plan."""
    strokes = spark.createDataFrame([(1, "v", 5.0, 1.0, 90.0, 3.0)], "plan_id int, orient string, perp double, a0 double, a1 double, thickness double")
    mask(runs.stroke_boxes(strokes)).explain()
    dealt = re.findall(r"Exchange (\w+)\((\w+)#.*?, (\w+),? ", capsys.readouterr().out)
    assert dealt and {d[:2] for d in dealt} == {("hashpartitioning", "plan_id")} and {d[2] for d in dealt} == {"REPARTITION_BY_NUM"}, dealt


def test_thickness_sends_no_side_to_all(spark, tmp_path, capsys):
    """Files of few bytes give many rows of ink and walls."""
    strokes = spark.createDataFrame([(1, "h", 5.0, 1.0, 90.0, 3.0)], "plan_id int, orient string, perp double, a0 double, a1 double, thickness double")
    strokes.write.parquet(str(tmp_path / "s"))
    strokes = spark.read.parquet(str(tmp_path / "s"))
    walls = strokes.select("plan_id", F.lit("w").alias("wall_id"), "orient", F.col("a0").alias("s"), F.col("a1").alias("e"), F.col("perp").alias("fixed"))
    found = runs.thickness(walls, runs.drawn(strokes))
    found.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert [r.thickness for r in found.collect()] == [3.0]
