import os
import random

import pytest
from conftest import compare
from pyspark.sql import functions as F

from planwright.functions import geometry, text
from planwright.operators import openings, projects, rooms, segments, validation
from planwright.plans.queries import ORACLES, QUERIES
from planwright.sources.plans import DDL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    compare(spark, name, QUERIES[name], ORACLES[name], SF)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("label", "value"), [("24 ft", 24), ("24", 24), ("3.5m", 3.5), ("12'-6\"", 12.5), ("24'-0\"", 24), ("Bedroom", None), ("12ft 6in", None), (".5m", None), ("", None)])
def test_dimension(spark, label, value):
    assert one(spark, text.dimension_value(F.lit(label))) == value


def test_room_types_in_order(spark):
    assert [one(spark, text.room_type(F.lit(t))) for t in ("Master Bedroom", "WC", "hall", "den")] == ["bedroom", "bathroom", "hallway", None]


def test_inside_excludes_the_boundary(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4))])
    rows = spark.range(100).select((F.col("id") % 10 / 2).alias("x"), (F.floor(F.col("id") / 10) / 2).alias("y"))
    for r in rows.select("x", "y", geometry.inside(ring, F.col("x"), F.col("y")).alias("i")).collect():
        assert r["i"] == ((0 < r["x"] < 4 and 0 < r["y"] < 2) or (0 < r["x"] < 2 and 0 < r["y"] < 4)), r


def test_runs_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.choice("hv"), float(rng.randrange(60)), float(a := rng.randrange(900)), float(a + rng.randrange(1, 90))) for _ in range(400)]
    want = []
    for key in {r[:2] for r in rows}:
        groups, last = [], None
        for r in sorted(x[2:] for x in rows if x[:2] == key):
            if last is None or r[0] - last > 8:
                groups.append([])
            groups[-1].append(r[1:])
            last = r[0]
        for g, spans in enumerate(groups):
            run, start, end, n = 0, None, None, 0
            for a0, a1 in sorted(spans):
                if end is not None and a0 - end > 160:
                    want.append((*key, g, run, start, end, n))
                    run, start, end, n = run + 1, None, None, 0
                start, end, n = (a0 if start is None else start), (a1 if end is None else max(end, a1)), n + 1
            want.append((*key, g, run, start, end, n))
    df = spark.createDataFrame(rows, "plan_id int, orient string, perp double, a0 double, a1 double")
    got = segments.wall_runs(df).select("plan_id", "orient", "grp", "run", "s", "e", "n").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_suppression_keeps_the_better_neighbour(spark):
    rows = [(1, 0.10, False), (1, 0.12, True), (1, 0.16, False), (1, 0.30, False)]
    got = openings.suppress(spark.createDataFrame(rows, "w int, position double, swing boolean"), ["w"]).collect()
    assert sorted((r.position, r.swing) for r in got) == [(0.12, True), (0.30, False)]  # 0.16 is near the kept 0.12


def test_calibration_fallbacks(spark):
    plans = spark.createDataFrame([(1,), (2,), (3,)], "plan_id int")
    dims = spark.createDataFrame([(1, 24.0, 480.0, True), (2, 0.0, 5.0, True)], "plan_id int, value double, pixels double, matched boolean")
    walls = spark.createDataFrame([(2, 0.0, 600.0, True)], "plan_id int, s double, e double, exterior boolean")
    got = {r.plan_id: (r.pixels_per_unit, r.source) for r in rooms.calibration(plans, dims, walls).collect()}
    assert got == {1: (20.0, "ocr_dimension_match"), 2: (20.0, "longest_wall_fallback"), 3: (1.0, "uncalibrated")}


DOC = {
    "project_id": "P", "units": "feet",
    "rooms": [{"id": "r1", "name": "A", "polygon": [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}], "confidence": 0.9}],
    "walls": [{"id": "w1", "start": {"x": 0.0, "y": 0.0}, "end": {"x": 1.0, "y": 0.0}, "thickness": 0.5}],
    "doors": [{"id": "d1", "wall_id": "w1", "position": 0.5, "width": 3.0}],
    "dimensions": [{"id": "m1", "start": {"x": 0.0, "y": 0.0}, "end": {"x": 1.0, "y": 0.0}, "value": 1.0}],
    "furniture": [{"id": "f1", "furniture_type": "bed", "position": {"x": 0.0, "y": 0.0}, "room_id": "r1"}],
}


@pytest.mark.parametrize(("change", "error"), [
    (lambda d: d, None), (lambda d: d.update(project_id=" "), "project_id"), (lambda d: d["rooms"][0].update(polygon=[]), "rooms.0.polygon"),
    (lambda d: d["rooms"][0].update(confidence=1.5), "rooms.0.confidence"), (lambda d: d["walls"][0].update(thickness=-0.5), "walls.0.thickness"), (lambda d: d["doors"][0].pop("width"), "doors.0.width"),
    (lambda d: d["dimensions"][0].update(value=0.0), "dimensions.0.value"), (lambda d: d["rooms"][0].update(id="w1"), "Duplicate element id 'w1' found in 'walls'."),
    (lambda d: d["doors"][0].update(wall_id="no"), "Door 'd1' references unknown wall_id 'no'."), (lambda d: d["furniture"][0].update(room_id="no"), "Furniture 'f1' references unknown room_id 'no'."),
])
def test_validation(spark, tmp_path, change, error):
    import copy
    import json

    from planwright.sources.plans import read_documents

    doc = copy.deepcopy(DOC)
    change(doc)
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    got = validation.validate(read_documents(spark, str(tmp_path))).first()
    assert got["is_valid"] == (error is None) and (error is None or any(error in e for e in got["errors"])), got


def test_structure_equals_a_loop(spark):
    """Repeated ids and lost references of random documents, against a loop; one has 20,000 walls and doors."""
    rng = random.Random(5)
    name = lambda: f"e{rng.randrange(9)}"
    wall = lambda i: {"id": i, "start": {"x": 0.0, "y": 0.0}, "end": {"x": 1.0, "y": 0.0}}
    door = lambda i, w: {"id": i, "wall_id": w, "position": 0.5, "width": 1.0}
    rows = [{"project_id": f"p{k}", "walls": [wall(name()) for _ in range(rng.randrange(4))], "doors": [door(name(), name()) for _ in range(rng.randrange(4))]} for k in range(60)]
    rows.append({"project_id": "large", "walls": [wall(f"w{i}") for i in range(20_000)], "doors": [door(f"d{i}", f"w{i}") for i in range(20_000)]})
    rows.append({"project_id": "none"})
    got = {r["project_id"]: r["errors"] for r in validation.validate(spark.createDataFrame(rows, DDL)).collect()}
    for r in rows:
        seen, want = set(), []
        for kind in ("walls", "doors"):
            for e in r.get(kind, []):
                want += [f"Duplicate element id '{e['id']}' found in '{kind}'."] if e["id"] in seen else []
                seen.add(e["id"])
        known = {w["id"] for w in r.get("walls", [])}
        want += [f"Door '{d['id']}' references unknown wall_id '{d['wall_id']}'." for d in r.get("doors", []) if d["wall_id"] not in known]
        assert got[r["project_id"]] == want, r


def test_failed_run_keeps_the_document(spark):
    p = spark.createDataFrame([("a", "old", "complete", None), ("b", None, "not_started", None)], "id string, floorplan_data string, detection_status string, detection_error string")
    d = spark.createDataFrame([("a", None, "broken")], "id string, floorplan_data string, error string")
    got = {r.id: tuple(r)[1:] for r in projects.save_documents(p, d).collect()}
    assert got == {"a": ("old", "failed", "broken"), "b": (None, "not_started", None)}


def test_page_bounds(spark):
    with pytest.raises(ValueError, match="limit"):
        projects.page(spark.createDataFrame([], "id int, created_at timestamp"), 501)


def test_wall_stream(spark, tmp_path):
    from planwright.streaming.detection import wall_stream

    df = spark.createDataFrame([(1, "h", 0.0, 0.0, 10.0), (1, "h", 2.0, 12.0, 20.0)], "plan_id long, orient string, perp double, a0 double, a1 double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    wall_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.s, r.e, r.n) for r in got] == [(0.0, 20.0, 2)]


def test_uploads(spark, tmp_path):
    from planwright.sources.plans import uploads

    (tmp_path / "a.PNG").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    assert {os.path.basename(r.path): r.error_code for r in uploads(spark, str(tmp_path)).collect()} == {"a.PNG": None, "b.txt": 415}


def test_schema_is_declared():
    assert "furniture" in DDL
