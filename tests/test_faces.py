"""Room outlines from walls against flooded pixels, simplified rings against recursion, and neighbours by grid cells."""

import math
import random

import pytest
from pyspark.sql import functions as F

from planwright.functions import grid, rings
from planwright.operators import faces, openings, rooms

WALLS = "plan_id int, orient string, s double, e double, fixed double, thickness double"
PLANS = "plan_id int, width int, height int"


def flooded(walls, width, height):
    """The free regions of at least LEAST_AREA as sets of pixels, without the ground around."""
    solid = set()
    for orient, s, e, fixed, t in walls:
        h = max(2, round(t)) // 2
        for a in range(max(0, int(s) - h), int(e) + h):
            for b in range(max(0, int(fixed) - h), int(fixed) + h):
                solid.add((a, b) if orient == "h" else (b, a))
    free = {(x, y) for x in range(width) for y in range(height)} - solid
    out = []
    while free:
        todo, seen = [free.pop()], set()
        while todo:
            x, y = todo.pop()
            seen.add((x, y))
            for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if p in free:
                    free.remove(p)
                    todo.append(p)
        out.append(seen)
    return out


def filled(ring, width, height):
    """The pixels whose middle is inside a ring."""
    out = set()
    for y in range(height):
        xs = sorted(a[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if a[0] == b[0] and min(a[1], b[1]) <= y + 0.5 <= max(a[1], b[1]))
        for x0, x1 in zip(xs[::2], xs[1::2], strict=True):
            out |= {(x, y) for x in range(int(x0), int(x1))}
    return out


@pytest.mark.parametrize("chunk", [500_000, 3])
def test_outlines_equal_flooded_pixels(spark, monkeypatch, chunk):
    monkeypatch.setattr(faces, "CHUNK", chunk)
    monkeypatch.setattr(faces, "LEAST_AREA", 0.0)
    monkeypatch.setattr(faces, "MOST_OF_PLAN", 2.0)
    rng = random.Random(2)
    width = height = 60
    plans = {k: [(rng.choice("hv"), float(s := 6 * rng.randrange(8)), float(s + 6 * rng.randrange(1, 6)), float(6 * rng.randrange(1, 10)), float(rng.choice((2, 4)))) for _ in range(14)] for k in range(5)}
    plans[9] = [("h", 0.0, 60.0, 30.0, 2.0), ("v", 0.0, 60.0, 30.0, 2.0)]
    plans[10] = [("h", 10.0, 30.0, 20.0, 2.0), ("v", 20.0, 40.0, 30.0, 2.0), ("h", 30.0, 50.0, 40.0, 2.0), ("v", 20.0, 40.0, 10.0, 2.0), ("h", 10.0, 30.0, 40.0, 2.0)]
    rows = [(k, *w) for k, ws in plans.items() for w in ws] + [(77, "h", 0.0, 9.0, 5.0, 2.0), (0, "h", None, 5.0, 5.0, 2.0)]
    got = {}
    for r in faces.outlines(spark.createDataFrame(rows, WALLS), spark.createDataFrame([(k, width, height) for k in [*plans, 50]], PLANS)).collect():
        got.setdefault(r.plan_id, []).append(([(p.x, p.y) for p in r.polygon], r.area))
    assert set(got) == set(plans)
    for k, ws in plans.items():
        regions = flooded(ws, width, height)
        assert len(regions) == len(got[k])
        for ring, area in got[k]:
            inside = filled(ring, width, height)
            assert len(inside) == area and all(a[0] == b[0] or a[1] == b[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
            own = max(regions, key=lambda r: len(r & inside))
            assert own <= inside and any(inside - own <= set().union(*(regions[:i] + regions[i + 1 :])) | (inside - set().union(*regions)) for i in range(len(regions)))


def test_small_regions_and_the_ground_are_no_rooms(spark):
    box = [("h", 100.0, 300.0, 100.0, 4.0), ("h", 100.0, 300.0, 300.0, 4.0), ("v", 100.0, 300.0, 100.0, 4.0), ("v", 100.0, 300.0, 300.0, 4.0), ("v", 100.0, 300.0, 140.0, None), ("h", 100.0, 140.0, 130.0, None)]
    walls = spark.createDataFrame([(1, *w) for w in box], WALLS)
    got = faces.outlines(walls, spark.createDataFrame([(1, 500, 400)], PLANS)).collect()
    assert [(r.room_id, r.area, len(r.polygon)) for r in got] == [(1, 156.0 * 196, 4), (2, 36.0 * 166, 4)]
    none = faces.outlines(walls.where("plan_id = 2"), spark.createDataFrame([(1, 500, 400)], PLANS))
    assert none.count() == 0


def test_copies_of_walls_are_one_bar_and_rings_are_walked_once(spark, capsys):
    box = [("h", 100.0, 300.0, 100.0, 4.0), ("h", 100.0, 300.0, 300.0, 4.0), ("v", 100.0, 300.0, 100.0, 4.0), ("v", 100.0, 300.0, 300.0, 4.0)]
    stubs = [("v", float(y), float(y + 6), 50.0, 4.0) for y in range(104, 290, 12)]  # beside the room, whose height they must not cut
    rows = [(1, *w) for w in 60 * box + 9 * stubs] + [(1, "h", 100.0, 180.0, 100.0, 4.0), (1, "h", 180.0, 320.0, 100.0, 4.0)]
    walls, plans = spark.createDataFrame(rows, WALLS), spark.createDataFrame([(1, 500, 400)], PLANS)
    solid = faces.bars(walls, plans)
    assert solid.count() == 4 + len(stubs)
    assert faces.cells(solid).where("x0 = 102 and x1 = 298").count() == 1
    found = faces.outlines(walls, plans)
    found.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    assert [(r.room_id, r.area) for r in found.collect()] == [(1, 196.0 * 196)]


def kept(points, share):
    n = len(points)
    if n < 4:
        return points
    limit = share * sum(math.dist(points[i], points[i - 1]) for i in range(n))
    closed = [*points, points[0]]

    def off(i, a, b):
        (x, y), (ax, ay), (bx, by) = closed[i], closed[a], closed[b]
        wide = math.hypot(bx - ax, by - ay)
        return abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / wide if wide else math.hypot(x - ax, y - ay)

    def between(a, b):
        far = max(range(a + 1, b), key=lambda i: (off(i, a, b), -i), default=None)
        if far is None or off(far, a, b) <= limit:
            return [a]
        return between(a, far) + between(far, b)

    far = max(range(1, n), key=lambda i: ((points[i][0] - points[0][0]) ** 2 + (points[i][1] - points[0][1]) ** 2, -i))
    return [closed[i] for i in between(0, far) + between(far, n)]


def test_simplified_rings_equal_recursion(spark):
    rng = random.Random(4)
    polygons = [[], [(1.0, 1.0)], [(0.0, 0.0), (9.0, 0.0), (0.0, 9.0)], [(5.0, 5.0)] * 6, [(float(i), 0.0) for i in range(9)]]
    for n in (5, 30, 200):
        polygons += [[(100 * math.cos(6.28 * i / n) + rng.random() * j, 100 * math.sin(6.28 * i / n) + rng.random() * j) for i in range(n)] for j in (0, 3, 40)]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(polygons)] + [(99, None)], "id int, p array<struct<x:double,y:double>>")
    for share in (0.01, 0.05):
        got = {r.id: r.p for r in df.withColumn("p", rings.simplify(F.col("p"), share)).collect()}
        assert got[99] is None
        assert all([tuple(x) for x in got[k]] == kept(p, share) for k, p in enumerate(polygons))
    assert len(kept(polygons[-3], 0.01)) < 200


def test_grid_gives_every_neighbour_once(spark):
    rng = random.Random(6)
    points = [(k, rng.uniform(-90, 90), rng.uniform(-90, 90)) for k in range(200)]
    df = spark.createDataFrame([*points, (999, None, 1.0)], "k int, x double, y double")
    a = grid.at(df, F.col("x"), F.col("y"), 10.0).alias("a")
    b = grid.near(df.withColumnsRenamed({"k": "j", "x": "u", "y": "v"}), F.col("u"), F.col("v"), 10.0).alias("b")
    met = a.join(b, (F.col("cx") == F.col("gx")) & (F.col("cy") == F.col("gy"))).where(F.hypot(F.col("x") - F.col("u"), F.col("y") - F.col("v")) <= 10)
    got = sorted((r.k, r.j) for r in met.collect())
    assert got == sorted((i, j) for i, x, y in points for j, u, v in points if math.hypot(x - u, y - v) <= 10)


def test_candidates_are_linear_on_a_plan_of_a_hundred_thousand_elements(spark):
    n = 100_000
    side = 316
    spot = spark.range(n).select(F.lit(1).alias("plan_id"), F.col("id"), (F.col("id") % side * 30).cast("double").alias("x"), (F.floor(F.col("id") / side) * 30).cast("double").alias("y"))
    texts = spot.select("plan_id", F.col("id").alias("ord"), "x", "y", F.lit("t").alias("label"))
    lines = spot.select("plan_id", F.col("id").alias("line_id"), (F.col("x") - 5).alias("x1"), F.col("y").alias("y1"), (F.col("x") + 5).alias("x2"), F.col("y").alias("y2"))
    assert n <= rooms.lines_by_cell(texts, lines).count() <= 40 * n
    point = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    boxes = spot.select("plan_id", F.col("id").alias("room_id"), F.array(point(0, 0), point(25, 0), point(25, 25), point(0, 25)).alias("polygon"))
    assert rooms.labels_by_box(boxes, texts).count() <= 60 * n
    walls = spark.range(2000).select(F.lit(1).alias("plan_id"), F.lit("h").alias("orient"), (F.col("id") * 30).cast("double").alias("fixed"), F.col("id").cast("string").alias("wall_id"))
    assert rooms.beside(boxes, walls).count() <= 12 * n
    wide = spark.range(n).select(F.lit(1).alias("plan_id"), F.lit("h").alias("orient"), F.col("id").alias("grp"), F.lit(0).alias("run"), F.lit(0.0).alias("s"), F.lit(900.0).alias("e"), (F.col("id") * 40).cast("double").alias("fixed"), F.lit(False).alias("exterior"),
                                  F.array(F.struct(F.lit(100.0).alias("gap_start"), F.lit(150.0).alias("gap_end"))).alias("gaps"))
    leaves = wide.select("plan_id", F.lit(110.0).alias("mx"), (F.col("fixed") + 12).alias("my"))
    found = openings.classified(wide, leaves)
    assert found.where("swing").count() == n
