"""Copies of rooms, labels and lines multiply nothing, and no side is sent to all by what its file tells."""

import re

from planwright.operators import detection, rooms, segments

N = 60
RING = [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0)]
LABELS = "plan_id int, ord int, label string, x double, y double"


def counted(monkeypatch, name):
    """How many rows each call of a join of ``rooms`` gives."""
    seen, join = [], getattr(rooms, name)

    def run(*a):
        out = join(*a)
        seen.append(out.count())
        return out

    monkeypatch.setattr(rooms, name, run)
    return seen


def test_copies_of_rooms_and_labels_meet_once(spark, monkeypatch):
    seen = counted(monkeypatch, "labels_by_box")
    boxes = spark.createDataFrame([(1, k, RING) for k in range(N)] + [(1, N, None)], "plan_id int, room_id int, polygon array<struct<x:double,y:double>>")
    labels = spark.createDataFrame([(1, k, f"l{k}", 20.0, 20.0) for k in range(5, N)] + [(1, 2, None, 0.0, 20.0), (1, 3, "three", 30.0, 30.0), (1, None, "none", 30.0, 30.0)], LABELS)
    got = {r.room_id: r.label for r in rooms.label_in_room(boxes, labels).collect()}
    assert got == {k: "three" for k in range(N)} | {N: None}
    assert seen[0] < 10


def test_copies_of_texts_and_lines_meet_once(spark, monkeypatch):
    seen = counted(monkeypatch, "lines_by_cell")
    texts = spark.createDataFrame([(1, k, 10.0, 10.0, 4.0, 0.5) for k in range(N)] + [(1, N, None, 0.0, 4.0, 0.5)], "plan_id int, ord int, x double, y double, width double, confidence double")
    lines = spark.createDataFrame([(1, k, 0.0, 0.0, 20.0 + k % 2 * 2, 20.0) for k in range(N, 0, -1)], "plan_id int, line_id int, x1 double, y1 double, x2 double, y2 double")
    got = {r.ord: (r.line_id, r.x2, r.matched) for r in rooms.nearest_line(texts, lines).collect()}
    assert got == {k: (2, 20.0, True) for k in range(N)} | {N: (None, None, False)}
    assert seen[0] < 10


def test_rooms_and_walls_meet_by_sorting(spark, tmp_path, capsys):
    spark.createDataFrame([(1, 1, RING)], "plan_id int, room_id int, polygon array<struct<x:double,y:double>>").write.parquet(str(tmp_path / "r"))
    spark.createDataFrame([(1, "h", 2.0, "h-0", 0.9)], "plan_id int, orient string, fixed double, wall_id string, confidence double").write.parquet(str(tmp_path / "w"))
    r, w = spark.read.parquet(str(tmp_path / "r")), spark.read.parquet(str(tmp_path / "w"))
    found = rooms.room_confidence(r, rooms.boundary(r, w), w)
    found.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert [x.confidence for x in found.collect()] == [0.9]


def test_detection_sends_no_side_to_all(spark, tmp_path, monkeypatch, capsys):
    """Plans and outlines grow with the input, however small their files are; no step is run here."""
    spark.createDataFrame([("1", None, 900, 900)], "plan_id string, image string, width int, height int").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([("1", 1, RING)], "plan_id string, room_id int, polygon array<struct<x:double,y:double>>").write.parquet(str(tmp_path / "o"))
    raw = spark.createDataFrame([], "plan_id string, seg_id int, x1 double, y1 double, x2 double, y2 double, thickness double, src string")
    texts = spark.createDataFrame([], "plan_id string, ord int, text string, cx double, cy double, min_x double, max_x double, confidence double")
    parts = []
    monkeypatch.setattr(detection, "cut", lambda df: parts.append(df) or spark.createDataFrame([], df.schema))
    parts.append(detection.detect(spark.read.parquet(str(tmp_path / "p")), raw, spark.read.parquet(str(tmp_path / "o")), texts))
    for df in parts:
        df.explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_walls_are_dealt_out_once(spark, capsys):
    """By plan, in a fixed number of partitions: the bytes of a shuffle tell too little of the memory of its sort."""
    s = spark.createDataFrame([(1, "h", 2.0, 0.0, 9.0)], "plan_id int, orient string, perp double, a0 double, a1 double")
    segments.walls(s, gaps=True).explain()
    out = capsys.readouterr().out
    assert re.findall(r"Exchange \w+", out) == ["Exchange hashpartitioning"] and "REPARTITION_BY_NUM" in out, out
