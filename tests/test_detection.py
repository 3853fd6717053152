"""The two drawings, as strokes and words, from raw segments to documents."""

import pytest
from pyspark.sql import functions as F

from planwright.functions import geometry
from planwright.operators import detection, documents, projects, runs, validation

SEGMENTS = "plan_id string, seg_id int, x1 double, y1 double, x2 double, y2 double, thickness double, src string"
TEXTS = "plan_id string, ord int, text string, cx double, cy double, min_x double, max_x double, confidence double"


def line(plan, x1, y1, x2, y2, width=4.0, src="wall"):
    return (plan, 0, float(x1), float(y1), float(x2), float(y2), float(width), src)


COTTAGE = [
    line("cottage", 100, 100, 172, 100), line("cottage", 232, 100, 580, 100), line("cottage", 100, 420, 580, 420), line("cottage", 100, 100, 100, 420),
    line("cottage", 580, 100, 580, 212), line("cottage", 580, 272, 580, 420), line("cottage", 380, 100, 380, 244), line("cottage", 380, 300, 380, 420),
    line("cottage", 172, 100, 190, 118, 2, "detail"), line("cottage", 100, 445, 580, 445, 1), *[line("cottage", 510, y, 565, y, 2, "detail") for y in range(324, 375, 10)],
]
STUDIO = [line("studio", 80, 80, 192, 80), line("studio", 242, 80, 360, 80), line("studio", 80, 280, 360, 280), line("studio", 80, 80, 80, 280), line("studio", 360, 80, 360, 280), line("studio", 192, 80, 208, 96, 2, "detail")]
WORDS = [("cottage", 0, "Living Room", 170.0, 135.0, 130.0, 210.0, 0.9), ("cottage", 1, "Bedroom", 430.0, 135.0, 400.0, 460.0, 0.9), ("cottage", 2, "24 ft", 340.0, 455.0, 320.0, 360.0, 0.8), ("studio", 0, "Studio", 200.0, 200.0, 180.0, 220.0, 0.9)]


def box(plan, k, x0, y0, x1, y1):
    return (plan, k, [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


@pytest.fixture(scope="module")
def found(spark):
    plans = spark.createDataFrame([("cottage", "c.png", 800, 682), ("studio", "s.png", 800, 655), ("empty", None, 900, 900)], "plan_id string, image string, width int, height int")
    raw = spark.createDataFrame(COTTAGE + STUDIO, SEGMENTS)
    rooms = spark.createDataFrame([box("cottage", 1, 100, 100, 380, 420), box("cottage", 2, 380, 100, 580, 420), box("studio", 1, 80, 80, 360, 280)], "plan_id string, room_id int, polygon array<struct<x:double,y:double>>")
    return detection.detect(plans, raw, rooms, spark.createDataFrame(WORDS, TEXTS)).cache()


def test_drawings(found):
    got = {r.project_id: r for r in found.collect()}
    size = lambda r: tuple(len(r[k]) for k in ("rooms", "walls", "doors", "windows", "stairs", "dimensions"))
    c, s = got["cottage"], got["studio"]
    assert size(c) == (2, 5, 2, 1, 1, 1) and size(s)[:2] == (1, 4) and size(s)[2:5] == (1, 0, 0) and size(got["empty"]) == (0,) * 6
    assert sum(w.wall_type == "exterior" for w in c.walls) == sum(w.wall_type == "exterior" for w in s.walls) == 4
    x = [p for w in c.walls for p in (w.start.x, w.end.x)]
    assert abs(max(x) - min(x) - 24) <= 2
    assert [(r.name, r.room_type) for r in c.rooms] == [("Living Room", "living_room"), ("Bedroom", "bedroom")] and s.rooms[0].name == "Studio"
    assert (c.dimensions[0].value, c.dimensions[0].label) == (24.0, "24 ft")
    assert sorted((d.swing or "", d.confidence) for d in c.doors) == [("", 0.45), ("left", 0.55)] and c.stairs[0].confidence == 0.5
    assert c.metadata.extra["calibration_source"] == "ocr_dimension_match" and "resolution" in c.metadata.notes
    assert s.metadata.extra["calibration_source"] == "fallback_default_assumption" and "uncalibrated" in got["empty"].metadata.notes
    assert all(v == 0.2 for v in (w.thickness for w in c.walls))


def test_rooms_come_from_the_walls_where_no_outlines_are_given(spark, found):
    plans = spark.createDataFrame([("cottage", "c.png", 800, 682), ("studio", "s.png", 800, 655), ("empty", None, 900, 900)], "plan_id string, image string, width int, height int")
    own = detection.detect(plans, spark.createDataFrame(COTTAGE + STUDIO, SEGMENTS), None, spark.createDataFrame(WORDS, TEXTS))
    got, given = ({r.project_id: r for r in d.collect()} for d in (own, found))
    assert {k: len(r.rooms) for k, r in got.items()} == {"cottage": 2, "studio": 1, "empty": 0}
    assert [(r.name, r.room_type, r.confidence) for r in got["cottage"].rooms] == [(r.name, r.room_type, r.confidence) for r in given["cottage"].rooms]
    for k in got:
        assert got[k].asDict() | {"rooms": 0} == given[k].asDict() | {"rooms": 0}
        for a, b in zip(got[k].rooms, given[k].rooms, strict=True):  # half a wall within the given outlines
            assert all(abs(p.x - q.x) <= 0.25 and abs(p.y - q.y) <= 0.25 for p, q in zip(a.polygon, b.polygon, strict=True))


def test_thickness_comes_from_the_ink(spark, found):
    plans = spark.createDataFrame([("cottage", "c.png", 800, 682)], "plan_id string, image string, width int, height int")
    # The probe reaches 25 pixels, as far as the wall is from the dimension line: the line is moved away from it.
    raw = spark.createDataFrame([(*r[:3], r[3] + 10, r[4], r[5] + 10, *r[6:]) if r[3] == 445 else r for r in COTTAGE], SEGMENTS)
    ink = runs.drawn(detection.oriented(raw))
    own = detection.detect(plans, raw.drop("thickness"), None, spark.createDataFrame(WORDS, TEXTS), ink=ink).first()
    given = found.where("project_id = 'cottage'").first()
    assert len(own.rooms) == 2 and [(d.value, d.confidence) for d in own.dimensions] == [(24.0, 0.8)]
    assert [(w.start, w.end, w.wall_type, w.thickness) for w in own.walls] == [(w.start, w.end, w.wall_type, w.thickness) for w in given.walls]


def test_detected_documents_are_valid_and_saved(spark, found):
    assert validation.validate(found).where("not is_valid").count() == 0
    none = spark.createDataFrame([], "id string, name string, description string, status string, floorplan_data string, detection_status string, detection_error string, created_at timestamp, updated_at timestamp")
    new = spark.createDataFrame([("cottage", "A", None), ("studio", "B", "b"), ("x", "", None), ("y", "n" * 201, "d" * 2001)], "id string, name string, description string")
    table, refused = projects.insert(none, new)
    assert {r.id: r.errors for r in refused.collect()} == {"x": ["name"], "y": ["name", "description"]}
    assert {(r.status, r.detection_status) for r in table.collect()} == {("created", "not_started")}
    table = projects.start(table, new)
    assert {r.detection_status for r in table.collect()} == {"processing"}
    bad = found.where("project_id = 'studio'").withColumn("units", F.lit("cubits"))
    saved = {r.id: r for r in projects.save_valid(table, found.where("project_id = 'cottage'").unionByName(bad)).collect()}
    assert saved["cottage"].detection_status == "complete" and saved["studio"].detection_status == "failed" and "units" in saved["studio"].detection_error and saved["studio"].floorplan_data is None
    kept = spark.createDataFrame(list(saved.values()), table.schema)
    codes = {r.id: r.error_code for r in projects.get(kept, spark.createDataFrame([("cottage",), ("studio",), ("z",)], "id string")).collect()}
    assert codes == {"cottage": None, "studio": 409, "z": 404}
    assert documents.from_json(kept.where("id = 'cottage'")).first().project_id == "cottage"


def test_units(spark):
    got = spark.createDataFrame([(40.0, 20.0), (40.0, 0.0), (40.0, -1.0)], "a double, b double").select(detection.to_units(F.col("a"), F.col("b")).alias("u")).collect()
    assert [r.u for r in got] == [2.0, 40.0, 40.0]


def test_skew_and_bounds(spark):
    raw = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (1, 0.0, 0.0, 0.0, 10.0), (1, 0.0, 0.0, 10.0, 10.0), (2, 0.0, 0.0, 10.0, 10.0)], "plan_id int, x1 double, y1 double, x2 double, y2 double")
    plans = spark.createDataFrame([(1,), (2,), (3,)], "plan_id int")
    assert {r.plan_id: r.skew for r in detection.skew(plans, raw).collect()} == {1: 0.0, 2: -45.0, 3: 0.0}
    rings = spark.createDataFrame([([(1.0, 5.0), (4.0, 2.0), (3.0, 9.0)],), ([],)], "p array<struct<x:double,y:double>>")
    assert [tuple(r.b) for r in rings.select(geometry.bounds(F.col("p")).alias("b")).collect()] == [(1.0, 2.0, 4.0, 9.0), (None,) * 4]
