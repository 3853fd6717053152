"""Raw documents, uploads, the stream of statuses, and small operators that no query covers."""

import copy
import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from planwright.operators import documents, openings, projects, raw_documents, rooms, validation
from planwright.sources import plans, uploads
from planwright.streaming import status

DOC = {
    "project_id": "P", "units": "feet",
    "rooms": [{"id": "r1", "name": "A", "polygon": [{"x": 0, "y": 0}, {"x": 1.5, "y": 0}, {"x": 1, "y": 1}], "confidence": 0.9, "room_type": None}],
    "walls": [{"id": "w1", "start": {"x": 0, "y": 0}, "end": {"x": 1, "y": 0}, "thickness": 0.5}],
    "doors": [{"id": "d1", "wall_id": "w1", "position": 0.5, "width": 3}],
    "windows": [{"id": "n1", "wall_id": "w1", "position": 1, "width": 3, "sill_height": 0}],
    "stairs": [{"id": "s1", "polygon": [{"x": 0, "y": 0}, {"x": 1, "y": 0}, {"x": 1, "y": 1}], "step_count": 9}],
    "dimensions": [{"id": "m1", "start": {"x": 0, "y": 0}, "end": {"x": 1, "y": 0}, "value": 1}],
    "furniture": [{"id": "f1", "furniture_type": "bed", "position": {"x": 0, "y": 0}, "room_id": "r1"}], "metadata": {"extra": {"a": "b"}},
}


GONE = object()


def put(path, value=GONE):
    def change(d):
        *way, last = path.split(".")
        for k in way:
            d = d[int(k)] if k.isdigit() else d[k]
        last = int(last) if last.isdigit() else last
        if value is GONE:
            del d[last]
        else:
            d[last] = value

    return change


CASES = [
    (None, []), (put("units"), []), (put("stairs"), []), (put("metadata"), []), (put("project_id"), ["project_id: missing"]), (put("project_id", None), ["project_id: null"]), (put("project_id", 3), ["project_id: not text"]),
    (put("doors.0.width"), ["doors.0.width: missing"]), (put("doors.0.width", None), ["doors.0.width: null"]), (put("doors.0.width", "3"), ["doors.0.width: not a number"]), (put("doors.0.width", True), ["doors.0.width: not a number"]),
    (put("doors.0.width", -1), ["doors.0.width: invalid"]), (put("walls.0.thickness", None), []), (put("walls.0.start.y", "a"), ["walls.0.start.y: not a number"]), (put("walls.0.start", None), ["walls.0.start: null"]),
    (put("walls.0.start", [1, 2]), ["walls.0.start: not an object"]), (put("walls", {}), ["walls: not a list"]), (put("walls", None), ["walls: null"]), (put("walls.0", 7), ["walls.0: not an object"]), (put("walls.0", None), ["walls.0: null"]),
    (put("rooms.0.polygon.1.x"), ["rooms.0.polygon.1.x: missing"]), (put("rooms.0.polygon.2", 5), ["rooms.0.polygon.2: not an object"]), (put("rooms.0.polygon", []), ["rooms.0.polygon: invalid"]), (put("rooms.0.source", None), ["rooms.0.source: null"]),
    (put("stairs.0.step_count", 2.5), ["stairs.0.step_count: not a whole number"]), (put("stairs.0.step_count", 0), ["stairs.0.step_count: invalid"]), (put("metadata", 3), ["metadata: not an object"]), (put("furniture.0.position"), ["furniture.0.position: missing"]),
    (put("windows.0.position", 1.5), ["windows.0.position: invalid"]), (put("windows.0.sill_height", -1), ["windows.0.sill_height: invalid"]), (put("doors.0.swing", "double"), ["doors.0.swing: invalid"]), (put("doors.0.swing", "none"), []),
    (put("walls.0.wall_type", "brick"), ["walls.0.wall_type: invalid"]), (put("furniture.0.depth", 0), ["furniture.0.depth: invalid"]), (put("rooms.0.source", "robot"), ["rooms.0.source: invalid"]), (put("rooms.0.name", ""), ["rooms.0.name: invalid"]),
    (put("dimensions.0.value", 0), ["dimensions.0.value: invalid"]), (put("units", "cubits"), ["units: unknown"]), (put("rooms.0.id", "w1"), ["Duplicate element id 'w1' found in 'walls'.", "Furniture 'f1' references unknown room_id 'r1'."]),
]


def test_missing_null_and_wrong_types_are_told_apart(spark):
    rows, want = [], {}
    for k, (change, errors) in enumerate(CASES):
        d = copy.deepcopy(DOC)
        if change:
            change(d)
        rows.append((k, json.dumps(d)))
        want[k] = errors
    rows += [(900, None), (901, "{"), (902, "[]"), (903, "")]
    want |= {k: ["document: not an object"] for k in range(900, 904)}
    df = spark.createDataFrame(rows, "id int, floorplan_data string")
    got = {r.id: r for r in raw_documents.checked(df).collect()}
    assert {k: r.errors for k, r in got.items()} == want
    assert got[0].document.walls[0].thickness == 0.5 and got[7].document is None
    assert raw_documents.parsed(df.where("id < 4")).count() == 4
    with pytest.raises(Exception, match="doors.0.width: null"):
        raw_documents.parsed(df.where("id = 8")).collect()
    with pytest.raises(ValueError, match="exist"):
        raw_documents.checked(df.withColumn("walls", F.lit(1)))


def test_uploads_are_stored_once_and_refused_ones_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(uploads, "MOST_BYTES", 10)
    rows = [("a", "x.PNG", b"12"), ("a", "again.png", b"12"), ("b", "y.pdf", b"3"), ("a", None, b"1"), ("a", "", b"1"), ("a", "z.gif", b"1"), ("a", "w.jpg", b"1" * 11), ("c", "n.jpeg", None)]
    df = spark.createDataFrame(rows, "project_id string, filename string, content binary")
    out = str(tmp_path / "store")

    def stored():
        return sorted(p.removeprefix(out).rsplit("/", 1)[0] for p in glob.glob(f"{out}/*/*/*.parquet"))

    refused = uploads.save(df, out)
    assert sorted((r.project_id, r.filename or "", r.error_code) for r in refused.collect()) == [("a", "", 415), ("a", "", 415), ("a", "w.jpg", 413), ("a", "z.gif", 415)]
    first = stored()
    assert len(first) == 3 and sum("project_id=a" in p for p in first) == 1
    uploads.save(df.where("project_id = 'a'"), out)
    assert stored() == first
    uploads.save(spark.createDataFrame([("a", "q.png", b"9")], df.schema), out)
    assert len(stored()) == 4


def test_status_stream_over_split_plans(spark, tmp_path):
    schema = "plan_id string, orient string, perp double, a0 double, a1 double"
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    table = spark.createDataFrame([(k, "old" if k == "bad" else None, "not_started", None) for k in ("p", "q", "bad", "idle")], "id string, floorplan_data string, detection_status string, detection_error string")

    def detect(segments):
        per = segments.groupBy("plan_id").agg(F.count("*").alias("n"), F.sum("a1").alias("s"))
        good = F.col("plan_id") != "bad"
        return per.where("plan_id <> 'lost'").select(F.col("plan_id").alias("id"), F.when(good, F.concat_ws("/", "n", "s")).alias("floorplan_data"), F.when(~good, "broken").alias("error"))

    def feed(rows, run=detect, checkpoint="cp"):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        status.status_stream(spark, source, sink, str(tmp_path / checkpoint), schema, run).awaitTermination()
        return {r.id: tuple(r)[1:] for r in status.projects_now(table, sink).collect()}

    assert {r.id: tuple(r)[1:] for r in status.projects_now(table, sink).collect()}["p"] == (None, "not_started", None)
    got = feed([("p", "h", 0.0, 0.0, 10.0), ("bad", "h", 0.0, 0.0, 1.0), ("lost", "h", 0.0, 0.0, 1.0)])
    assert got == {"p": ("1/10.0", "complete", None), "q": (None, "not_started", None), "bad": ("old", "failed", "broken"), "idle": (None, "not_started", None)}
    got = feed([("p", "h", 2.0, 12.0, 20.0), ("q", "h", 0.0, 0.0, 3.0)])  # the rest of p comes in another file
    assert got["p"] == ("2/30.0", "complete", None) and got["q"] == ("1/3.0", "complete", None)

    def fails(_):
        raise RuntimeError("no model")

    got = feed([("q", "h", 0.0, 0.0, 4.0)], fails)
    assert got["q"] == ("1/3.0", "failed", "no model") and got["p"][0] == "2/30.0"
    # A batch that runs again, here all files as one batch 0, replaces what it wrote: later folders still follow it.
    before = spark.read.parquet(f"{sink}/changes").where("batch > 0").count()
    got = feed([("q", "h", 0.0, 0.0, 5.0)], checkpoint="again")
    assert spark.read.parquet(f"{sink}/changes").where("batch > 0").count() == before
    # A run that was cut off is processing.
    spark.createDataFrame([("p", None, None)], status.CHANGES).write.parquet(f"{sink}/changes/batch=99/step=0")
    now = {r.id: tuple(r)[1:] for r in status.projects_now(table, sink).collect()}
    assert now["p"][1:] == ("processing", None) and now["p"][0] is not None


def loop(rows):
    """The quadratic rule: each that is not out yet against all later ones."""
    rows, out = sorted(rows), set()
    for i in range(len(rows)):
        if i in out:
            continue
        for j in range(i + 1, len(rows)):
            if j not in out and abs(rows[i][0] - rows[j][0]) < 0.05:
                out.add(j if rows[i][2] >= rows[j][2] else i)
    return [r for k, r in enumerate(rows) if k not in out]


def test_suppression_for_any_scores_equals_the_quadratic_loop(spark):
    rng = random.Random(9)
    walls = {w: [(rng.randrange(60) / 128, k, rng.randrange(9) / 8) for k in range(rng.randrange(1, 25))] for w in range(80)}
    df = spark.createDataFrame([(w, p, k, s) for w, rows in walls.items() for p, k, s in rows], "w int, position double, ord int, score double")
    got = {}
    for r in openings.suppress_scored(df, ["w"]).collect():
        got.setdefault(r.w, []).append((r.position, r.ord, r.score))
    assert {w: sorted(x) for w, x in got.items()} == {w: loop(rows) for w, rows in walls.items()}


def test_first_backend_that_answered(spark):
    quads = spark.createDataFrame([(1, 0, [(0, 0), (4, 1), (4, 3), (0, 2)], " Hall ", 0.5)], "plan_id int, ord int, quad array<struct<x:int,y:int>>, text string, confidence float")
    a = rooms.quad_blocks(quads)
    assert tuple(a.first()) == (1, 0, "Hall", 2.0, 1.5, 0.0, 0.0, 4.0, 3.0, 0.5)
    blocks = a.withColumn("backend", F.lit("quads")).unionByName(a.withColumns({"backend": F.lit("words"), "plan_id": F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))}))
    answers = spark.createDataFrame([(1, "quads", 0), (1, "words", 1), (2, "words", 1), (3, "quads", 0), (3, "words", 1)], "plan_id int, backend string, rank int")
    chosen, kept = rooms.first_backend(spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "plan_id int"), answers, blocks)
    assert {r.plan_id: r.backend for r in chosen.collect()} == {1: "quads", 2: "words", 3: "quads", 4: "none"}  # quads answered for 3 with no text
    assert {(r.plan_id, r.backend) for r in kept.collect()} == {(1, "quads"), (2, "words")}


def test_word_confidence_that_is_no_number(spark):
    words = spark.createDataFrame([(1, 0, 0, 0, 5, 5, "90", "a"), (1, 1, 7, 0, 5, 5, "x", "b"), (1, 2, 14, 0, 5, 5, "-1", "c"), (2, 0, 0, 0, 5, 5, None, "d")], "line int, word_idx int, left int, top int, width int, height int, conf string, text string")
    assert {r.line: (r.text, r.confidence) for r in rooms.text_blocks(words, ["line"]).collect()} == {1: ("a b c", 0.9), 2: ("d", 0.5)}


def test_summary_with_scale_and_notes(spark):
    d = DOC | {"metadata": {"notes": "n", "extra": {"calibration_source": "c"}}}
    rows = spark.createDataFrame([(json.dumps(d),), (json.dumps({"project_id": "Q"}),)], "floorplan_data string")
    got = {r.project_id: tuple(r)[1:] for r in documents.summary(documents.from_json(rows), told=True).collect()}
    assert got == {"P": (1, 1, 1, 1, 1, 1, "c", "n"), "Q": (0, 0, 0, 0, 0, 0, None, None)}


def test_patch_moves_updated_at_of_what_it_touches(spark):
    import datetime as dt

    old, new = dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)
    p = spark.createDataFrame([("a", "A", old), ("b", "B", old)], "id string, name string, updated_at timestamp")
    got = projects.patch(p, spark.createDataFrame([("a", None)], "id string, name string"), ["name"], now=new)
    assert {r.id: (r.name, r.updated_at) for r in got.collect()} == {"a": ("A", new), "b": ("B", old)}


def test_documents_of_unknown_projects_are_told(spark):
    p = spark.createDataFrame([("P", None, "not_started", None)], "id string, floorplan_data string, detection_status string, detection_error string")
    rows = spark.createDataFrame([(json.dumps(DOC | {"project_id": k}),) for k in ("P", "Z")], "floorplan_data string")
    docs = documents.from_json(rows)
    assert [(r.id, r.error_code) for r in projects.unknown(p, docs).collect()] == [("Z", 404)]
    assert validation.validate(docs).where("is_valid").count() == 2 and projects.save_valid(p, docs).first().detection_status == "complete"


def test_asked_files_that_are_missing_are_told(spark, tmp_path):
    for name in ("a.png", "b.txt"):
        (tmp_path / name).write_bytes(b"x")
    paths = [f"{tmp_path}/a.png", f"file://{tmp_path}/a.png", f"{tmp_path}/b.txt", f"{tmp_path}/c.png", f"{tmp_path}/c.png", None]
    got = plans.asked(spark.createDataFrame([(p,) for p in paths], "path string"), plans.uploads(spark, str(tmp_path)))
    assert sorted(((r.path, r.length, r.error_code) for r in got.collect()), key=str) == sorted(zip(paths, (1, 1, 1, None, None, None), (None, None, 415, 404, 404, 404), strict=True), key=str)
