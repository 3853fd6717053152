"""From raw segments, words and room outlines to plan documents.

Raw segments have plan_id, seg_id, x1, y1, x2, y2, thickness and src: ``wall`` for long strokes, ``detail`` for
leaves and treads.  Inputs are dealt out by plan; texts, walls, openings, spans and outlines are each written once to the
checkpoint folder, as dealt, and read from there, until the last step that needs them.  So joins, on the plan and, between
neighbours in it, on cells of a grid, move no rows, however often these multiply, and a step leaves no shuffle on the disks.  All
are by sorting: each side grows with the plans, and Spark would send one to all by what the file of the plans tells, through the
memory of the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text
from . import faces, openings, rooms, runs, segments
from .checkpoints import cut_in_place as cut
from .checkpoints import drop
from .documents import assemble
from .spreading import spread

THINNEST = 2.5
STAIR_CONFIDENCE = 0.5
LEAST_SIDE = 800
LOW_RESOLUTION = "The image is smaller than detection needs; at this resolution confidences are less to be trusted."
# Fixed values of documents.
VERSION = "phase2-tier2-v1"
MATCHED, FALLBACK = "ocr_dimension_match", "fallback_default_assumption"


def oriented(raw: DataFrame) -> DataFrame:
    """Segments along an axis, with orient (h or v), the mean coordinate across it (perp) and the interval along it (a0, a1)."""
    x = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    along = geometry.orientation(geometry.angle(*x))
    flat = F.col("orient") == "h"
    pick = lambda h, v: F.when(flat, h).otherwise(v)
    out = raw.withColumn("orient", F.when(along == geometry.HORIZONTAL, "h").when(along == geometry.VERTICAL, "v")).where("orient is not null")
    return out.select(
        *[c for c in raw.columns if c not in ("x1", "y1", "x2", "y2")], "orient", pick((x[1] + x[3]) / 2, (x[0] + x[2]) / 2).alias("perp"),
        pick(F.least("x1", "x2"), F.least("y1", "y2")).alias("a0"), pick(F.greatest("x1", "x2"), F.greatest("y1", "y2")).alias("a1"),
    )


def leaves(raw: DataFrame) -> DataFrame:
    """The middles (mx, my) of segments along no axis."""
    x = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    slant = raw.where(geometry.orientation(geometry.angle(*x)).isNull())
    return slant.select("plan_id", ((x[0] + x[2]) / 2).alias("mx"), ((x[1] + x[3]) / 2).alias("my"))


def skew(plans: DataFrame, raw: DataFrame) -> DataFrame:
    """(plan_id, skew): the median angle of a plan's segments to the nearest axis, from -45 up to 45 degrees; 0 without segments."""
    off = F.pmod(geometry.angle(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]) + 45, F.lit(90.0)) - 45
    middle = raw.groupBy("plan_id").agg(F.median(off).alias("skew"))
    return plans.select("plan_id").join(middle.hint("merge"), "plan_id", "left").select("plan_id", F.coalesce("skew", F.lit(0.0)).alias("skew"))


def to_units(pixels: Column, per_unit: Column) -> Column:
    """Pixels as units; unchanged where there is no scale."""
    return F.when(per_unit <= 0, pixels).otherwise(F.try_divide(pixels, per_unit))


def numbered(df: DataFrame, prefix: str, out: str, *order) -> DataFrame:
    """``df`` with ids of its rows within the plan, ``prefix-1`` the first, and their place ``ord``."""
    n = F.row_number().over(Window.partitionBy("plan_id").orderBy(*order))
    return df.withColumn("ord", n).withColumn(out, F.concat(F.lit(f"{prefix}-"), F.col("ord").cast("string")))


def split_walls(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Walls, and those thinner than THINNEST, which are lines of dimensions; only walls make the box that tells which are exterior."""
    thin = F.col("thickness") < THINNEST
    return segments.exterior(every.where(~F.coalesce(thin, F.lit(False))).drop("exterior")), every.where(thin).drop("exterior")


def ends(df: DataFrame) -> DataFrame:
    """Walls as lines x1, y1, x2, y2."""
    flat = F.col("orient") == "h"
    at = lambda h, v: F.when(flat, F.col(h)).otherwise(F.col(v))
    return df.withColumns({"x1": at("s", "fixed"), "y1": at("fixed", "s"), "x2": at("e", "fixed"), "y2": at("fixed", "e")})


def detect(plans: DataFrame, raw: DataFrame, outlines: DataFrame | None, texts: DataFrame, backend: str = "none", ink: DataFrame | None = None) -> DataFrame:
    """A plan document for each row of ``plans`` (plan_id, image, width, height).

    ``outlines`` has plan_id, room_id, polygon in pixels; without it rooms are what the walls enclose.  ``texts`` has plan_id, ord, text, cx, cy, min_x, max_x, confidence.
    With ``ink`` (runs of the image's ink) walls are as thick as the ink across their middle; raw segments need no thickness then.
    Plans without any element give a document with empty collections.  Heights, step counts and directions cannot
    be seen from above and are null; dimensions without a value are left out."""
    plans = cut(spread(plans, "plan_id"))
    # By kind, and not dealt out in these steps: texts may come from a shuffle for their order, and the disk holds that beside what is written.
    told = texts.withColumns({"kind": text.kind(F.col("text")), "value": text.dimension_value(F.col("text")), "label": F.col("text"), "x": F.col("cx"), "y": F.col("cy")})
    spans = cut(told.where("kind = 'dimension'").select("plan_id", "ord", "label", "x", "y", "value", (F.col("max_x") - F.col("min_x")).alias("width"), "confidence"))
    labels = cut(told.where("kind = 'room_label'").select("plan_id", "ord", "label", "x", "y"))
    every = segments.walls(oriented(raw.where("src = 'wall'")), gaps=True).drop("votes", "n", "openings", "exterior")
    if ink is not None:
        keys = ["plan_id", "orient", "grp", "run"]
        bare = cut(every.drop("thickness").withColumn("wall_id", F.concat_ws("/", *[F.col(k).cast("string") for k in keys[1:]])))
        every = bare.join(runs.thickness(bare, ink).hint("merge"), ["plan_id", "wall_id"]).drop("wall_id")
    every = cut(every)
    walls, thin = split_walls(every)

    lines = ends(numbered(thin, "line", "line_id", "orient", "fixed", "s")).select("plan_id", "line_id", "x1", "y1", "x2", "y2")
    dims = rooms.nearest_line(spread(spans, "plan_id"), lines, "value", "label")
    dims = cut(dims.withColumn("pixels", geometry.length(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))))
    drop(spans)
    walls = cut(numbered(walls, "wall", "wall_id", "orient", "fixed", "s"))
    drop(every)
    walls = ends(walls)
    scale = cut(rooms.calibration(plans, dims, walls))

    if outlines is None:
        outlines = faces.simplified(faces.outlines(walls, plans)).select("plan_id", "room_id", "polygon")
    outlines = cut(spread(outlines, "plan_id"))  # a small file is few tasks, and a room is twelve rows later
    score = cut(rooms.room_confidence(outlines, rooms.boundary(outlines, walls), walls))
    named = cut(outlines.join(rooms.label_in_room(outlines, spread(labels, "plan_id")).hint("merge"), ["plan_id", "room_id"]).join(score.hint("merge"), ["plan_id", "room_id"]))
    drop(labels, outlines, score)

    seen = cut(openings.classified(walls, spread(leaves(raw.where("src = 'detail'")), "plan_id"), "wall_id"))
    # Of a bunch of openings on a wall one stays.
    stays = openings.suppress(seen.select("plan_id", "wall_id", "position", "swing"), ["plan_id", "wall_id"])
    found = cut(seen.join(stays.hint("merge"), ["plan_id", "wall_id", "position", "swing"], "left_semi"))
    drop(seen)
    stairs = cut(segments.stair_clusters(spread(oriented(raw.where("src = 'detail'")).select("plan_id", "orient", "perp", "a0", "a1"), "plan_id")))

    per = scale.select("plan_id", F.col("pixels_per_unit").alias("ppu"))
    unit = lambda c: F.round(to_units(c, F.col("ppu")), 3)
    point = lambda x, y: F.struct(unit(x).alias("x"), unit(y).alias("y"))
    ring = lambda c: F.transform(c, lambda p: point(p["x"], p["y"]))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    detected = F.lit("ai_detection").alias("source")
    empty = F.create_map().cast("map<string,string>").alias("metadata")

    def element(df, kind, *own):
        got = df.join(per.hint("merge"), "plan_id").select("plan_id", "ord", F.struct(F.col("id"), F.col("confidence").cast("double").alias("confidence"), detected, empty, *own).alias("element"))
        return {kind: got}

    span = (point(F.col("x1"), F.col("y1")).alias("start"), point(F.col("x2"), F.col("y2")).alias("end"))
    on_wall = (F.col("wall_id"), F.round("position", 3).alias("position"), unit(F.col("width")).alias("width"), null("double", "height"))
    is_door = F.col("kind") == "door"
    parts = element(numbered(named, "room", "id", "room_id"), "rooms", F.coalesce("label", F.lit("Unnamed Room")).alias("name"), ring(F.col("polygon")).alias("polygon"), text.room_type(F.col("label")).alias("room_type"))
    parts |= element(walls.withColumn("id", F.col("wall_id")), "walls", *span, unit(F.col("thickness")).alias("thickness"), null("double", "height"), F.when(F.col("exterior"), "exterior").otherwise("interior").alias("wall_type"))
    parts |= element(numbered(found.where(is_door), "door", "id", "wall_id", "position"), "doors", *on_wall, F.when(F.col("swing"), "left").alias("swing"))
    parts |= element(numbered(found.where(~is_door), "window", "id", "wall_id", "position"), "windows", *on_wall, null("double", "sill_height"))
    flat = F.col("orient") == "h"
    across = lambda h, v: F.when(flat, F.col(h)).otherwise(F.col(v))
    box = geometry.rectangle(across("a0", "p0"), across("p0", "a0"), across("a1", "p1"), across("p1", "a1"))
    parts |= element(numbered(stairs.withColumn("confidence", F.lit(STAIR_CONFIDENCE)), "stair", "id", "orient", "flight"), "stairs", ring(box).alias("polygon"), null("int", "step_count"), null("string", "direction"))
    parts |= element(numbered(dims.where("value is not null"), "dim", "id", "y1", "x1", "label", "ord"), "dimensions", *span, F.col("value"), F.col("label"))

    documents = assemble(plans.select("plan_id", F.lit("feet").alias("units")), parts, "plan_id").join(metadata(plans, scale, backend).hint("merge"), "plan_id")
    return documents.select(F.col("plan_id").cast("string").alias("project_id"), *documents.columns[1:])


def metadata(plans: DataFrame, scale: DataFrame, backend: str) -> DataFrame:
    """(plan_id, metadata): where the scale comes from, and what to mind about it and the image."""
    note = F.when(F.col("source") == "longest_wall_fallback", "No dimension text matched; scale estimated from the longest exterior wall.").when(F.col("source") == "uncalibrated", "Scale is uncalibrated: coordinates are pixels.")
    low = F.when((F.col("width") < LEAST_SIDE) | (F.col("height") < LEAST_SIDE), LOW_RESOLUTION)
    own = F.struct(
        F.lit(None).cast("string").alias("building_name"), F.lit(VERSION).alias("detection_version"), F.col("image").alias("source_image_reference"), F.nullif(F.concat_ws(" ", note, low), F.lit("")).alias("notes"),
        F.create_map(F.lit("calibration_source"), F.when(F.col("source") == MATCHED, MATCHED).otherwise(FALLBACK), F.lit("ocr_backend"), F.lit(backend)).alias("extra"),
    )
    return plans.join(scale.hint("merge"), "plan_id").select("plan_id", own.alias("metadata"))
