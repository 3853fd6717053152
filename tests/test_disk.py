"""What steps of detection leave on the disks: rows as dealt, no shuffles, no rows that nothing reads any more."""

import os
import time

import pytest
from pyspark.sql import functions as F

from planwright.operators import detection
from planwright.operators.checkpoints import cut_in_place, drop
from planwright.operators.spreading import spread

RING = [(0.0, 0.0), (200.0, 0.0), (200.0, 100.0), (0.0, 100.0)]
N = 12


def shuffles(spark, most):
    """The shuffle files on the disks; they go a little after the step, so some time is given until there are ``most``."""
    folders = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    for _ in range(50):
        got = {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
        if len(got) <= most:
            break
        time.sleep(0.1)
    return got


def test_a_step_keeps_rows_as_dealt_and_no_shuffle(spark, capsys):
    names = ("spark.sql.adaptive.enabled", "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rows, conf, before = spark.range(1000).select((F.col("id") % 7).alias("plan_id"), F.col("id").alias("v")), [spark.conf.get(n, None) for n in names], shuffles(spark, 0)
    a, b = (cut_in_place(spread(rows, "plan_id")) for _ in range(2))
    assert shuffles(spark, len(before)) <= before and [spark.conf.get(n, None) for n in names] == conf
    capsys.readouterr()
    both = a.groupBy("plan_id", "v").agg(F.count("*").alias("n")).groupBy("plan_id").agg(F.sum("n").alias("n")).join(b.hint("merge"), "plan_id")
    both.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert both.agg(F.count("*"), F.sum("n")).first() == (1000, sum(len(range(k, 1000, 7)) ** 2 for k in range(7)))
    drop(b, rows)
    assert a.count() == rows.count() == 1000
    with pytest.raises(Exception, match="(?i)exist|checkpoint"):
        b.count()


def test_detection_shuffles_each_input_once_and_leaves_none(spark, capsys):
    """Documents are put together where their parts lie; copies of one drawing give copies of its document."""
    plans = spark.createDataFrame([(k, None, 900, 900) for k in range(N)], "plan_id int, image string, width int, height int")
    sides = [(0.0, 0.0, 60.0, 0.0), (120.0, 0.0, 200.0, 0.0), (0.0, 100.0, 200.0, 100.0), (0.0, 0.0, 0.0, 100.0), (200.0, 0.0, 200.0, 100.0)]
    raw = [(k, i, *s, 4.0, "wall") for k in range(N) for i, s in enumerate(sides)] + [(k, 9, 60.0, 0.0, 75.0, 15.0, 2.0, "detail") for k in range(N)]
    raw += [(k, 7, 0.0, 120.0, 200.0, 120.0, 1.0, "wall") for k in range(N)]
    raw = spark.createDataFrame(raw, "plan_id int, seg_id int, x1 double, y1 double, x2 double, y2 double, thickness double, src string")
    words = [(k, *w) for k in range(N) for w in ((1, "Kitchen", 50.0, 50.0, 40.0, 60.0, 0.9), (2, "20 ft", 100.0, 125.0, 90.0, 110.0, 0.8), (3, "note", 9.0, 9.0, 8.0, 10.0, 0.7))]
    words = spark.createDataFrame(words, "plan_id int, ord int, text string, cx double, cy double, min_x double, max_x double, confidence double")
    outlines = spark.createDataFrame([(k, 1, RING) for k in range(N)], "plan_id int, room_id int, polygon array<struct<x:double,y:double>>")
    before = shuffles(spark, 0)
    found = detection.detect(plans, raw, outlines, words)
    assert shuffles(spark, len(before)) <= before
    capsys.readouterr()
    found.explain()
    assert "Exchange" not in capsys.readouterr().out
    got = found.collect()
    assert sorted(r.project_id for r in got) == sorted(map(str, range(N)))
    told = {tuple(len(r[c]) for c in ("rooms", "walls", "doors", "windows", "stairs", "dimensions")) + (r.rooms[0].name, r.dimensions[0].value, r.dimensions[0].confidence, r.metadata.extra["calibration_source"]) for r in got}
    assert told == {(1, 4, 1, 0, 0, 1, "Kitchen", 20.0, 0.8, "ocr_dimension_match")}
