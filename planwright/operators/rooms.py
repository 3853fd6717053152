"""Rooms: boundary walls, confidence, labels; texts beside lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid
from ..functions.geometry import bounds, inside

BOUNDARY = 12.0
UNKNOWN = 0.7
NEAR_LINE = 40.0
ROOM_CELL = 100.0


def edges(rooms: DataFrame) -> DataFrame:
    """(plan_id, room_id, edge, orient, fixed) of each ring's edges; as steep as wide counts as vertical."""
    e = rooms.select("plan_id", "room_id", F.col("polygon"), F.posexplode("polygon").alias("edge", "p"))
    e = e.withColumn("q", F.get("polygon", ((F.col("edge") + 1) % F.size("polygon")).cast("int")))
    flat = F.abs(F.col("p.y") - F.col("q.y")) < F.abs(F.col("p.x") - F.col("q.x"))
    return e.select("plan_id", "room_id", "edge", F.when(flat, "h").otherwise("v").alias("orient"), F.when(flat, (F.col("p.y") + F.col("q.y")) / 2).otherwise((F.col("p.x") + F.col("q.x")) / 2).alias("fixed"))


def beside(rooms: DataFrame, walls: DataFrame) -> DataFrame:
    """Edges of rooms with each wall of their direction that is less than BOUNDARY away, by bins of that width.

    A room is twelve rows here, of which its file tells nothing, so the join is by sorting: neither side is sent to all."""
    w = walls.select(F.col("plan_id").alias("p"), F.col("orient").alias("o"), F.col("fixed").alias("f"), grid.cell(F.col("fixed"), BOUNDARY).alias("b"), "wall_id")
    own = grid.cell(F.col("fixed"), BOUNDARY)
    e = edges(rooms).withColumn("bin", F.explode(F.array(own - 1, own, own + 1)))
    return e.join(w.hint("merge"), (F.col("plan_id") == F.col("p")) & (F.col("orient") == F.col("o")) & (F.col("bin") == F.col("b"))).withColumn("away", F.abs(F.col("f") - F.col("fixed")))


def boundary(rooms: DataFrame, walls: DataFrame) -> DataFrame:
    """(plan_id, room_id, wall_id): the nearest wall of each edge's direction, less than BOUNDARY away; the least wall_id of equals.

    Walls of one line are not told apart along it."""
    met = beside(rooms, walls).where(F.col("away") < BOUNDARY)
    near = met.groupBy("plan_id", "room_id", "edge").agg(F.min_by("wall_id", F.struct("away", "wall_id")).alias("wall_id"))
    return near.select("plan_id", "room_id", "wall_id").distinct()


def room_confidence(rooms: DataFrame, bounds: DataFrame, walls: DataFrame) -> DataFrame:
    score = bounds.join(walls.select("plan_id", "wall_id", "confidence").hint("merge"), ["plan_id", "wall_id"]).groupBy("plan_id", "room_id").agg(F.sum(F.round(F.col("confidence") * 1000).cast("long")).alias("s"), F.count("*").alias("k"))
    # The mean in thousandths, half up, in whole numbers: the same on every plan of execution.
    score = score.select("plan_id", "room_id", (F.floor((2 * F.col("s") + F.col("k")) / (2 * F.col("k"))) / 1000).alias("c"))
    return rooms.select("plan_id", "room_id").join(score.hint("merge"), ["plan_id", "room_id"], "left").select("plan_id", "room_id", F.coalesce("c", F.lit(UNKNOWN)).alias("confidence"))


def labels_by_box(rooms: DataFrame, labels: DataFrame) -> DataFrame:
    """Rooms with each label in a cell of ROOM_CELL pixels that their box meets."""
    box = rooms.select("plan_id", "room_id", "polygon", bounds(F.col("polygon")).alias("box")).select("plan_id", "room_id", "polygon", "box.*")
    box = grid.within(box, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), ROOM_CELL)
    t = grid.at(labels.select(F.col("plan_id").alias("p"), "ord", "label", "x", "y"), F.col("x"), F.col("y"), ROOM_CELL)
    met = (F.col("plan_id") == F.col("p")) & (F.col("gx") == F.col("cx")) & (F.col("gy") == F.col("cy")) & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return box.join(t.hint("merge"), met).drop("x0", "y0", "x1", "y1")


def label_in_room(rooms: DataFrame, labels: DataFrame) -> DataFrame:
    """Rooms with the first label (least ord) strictly inside; null without one.

    Rooms of one outline have the same label, and of labels at one point only the first is ever taken, so outlines
    meet points: copies of either multiply nothing."""
    shapes = rooms.groupBy("plan_id", "polygon").agg(F.min("room_id").alias("room_id"))
    points = labels.where("ord is not null").groupBy("plan_id", "x", "y").agg(F.min(F.struct("ord", "label")).alias("l")).select("plan_id", "x", "y", "l.*")
    hit = labels_by_box(shapes, points).where(inside(F.col("polygon"), F.col("x"), F.col("y")))
    first = hit.groupBy("plan_id", "polygon").agg(F.min_by("label", "ord").alias("label"))
    return rooms.select("plan_id", "room_id", "polygon").join(first.hint("merge"), ["plan_id", "polygon"], "left").select("plan_id", "room_id", "label")


def lines_by_cell(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """Texts with each line whose middle is in their cell of NEAR_LINE pixels or beside it."""
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    m = grid.near(lines.select(F.col("plan_id").alias("p"), "line_id", "x1", "y1", "x2", "y2", mx.alias("mx"), my.alias("my")), F.col("mx"), F.col("my"), NEAR_LINE)
    t = grid.at(texts, F.col("x"), F.col("y"), NEAR_LINE)
    met = t.join(m.hint("merge"), (F.col("plan_id") == F.col("p")) & (F.col("cx") == F.col("gx")) & (F.col("cy") == F.col("gy")))
    return met.withColumn("away", (F.col("mx") - F.col("x")) ** 2 + (F.col("my") - F.col("y")) ** 2)


def nearest_line(texts: DataFrame, lines: DataFrame, *kept: str) -> DataFrame:
    """Texts (plan_id, ord, x, y, width, confidence, and columns ``kept``) with the line whose middle is nearest, under NEAR_LINE away; the least line_id of equals.

    Without one the span is centred on the text, ten pixels to either side at least, at six tenths of the confidence.
    The points of texts meet the middles of lines, each once and with its least line: copies of either multiply nothing."""
    middle = {"mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2}
    least = lines.withColumns(middle).groupBy("plan_id", "mx", "my").agg(F.min(F.struct("line_id", "x1", "y1", "x2", "y2")).alias("l")).select("plan_id", "l.*")
    met = lines_by_cell(texts.select("plan_id", "x", "y").distinct(), least).where(F.col("away") < NEAR_LINE**2)
    near = met.groupBy("plan_id", "x", "y").agg(F.min_by(F.struct("line_id", "x1", "y1", "x2", "y2"), F.struct("away", "line_id")).alias("l"))
    half = F.greatest(F.lit(10.0), F.col("width") / 2)
    at = lambda c, other: F.coalesce(F.col(f"l.{c}"), other)
    return texts.join(near.hint("merge"), ["plan_id", "x", "y"], "left").select(
        "plan_id", "ord", F.col("l.line_id").alias("line_id"), at("x1", F.col("x") - half).alias("x1"), at("y1", F.col("y")).alias("y1"), at("x2", F.col("x") + half).alias("x2"), at("y2", F.col("y")).alias("y2"),
        F.round(F.col("confidence") * F.when(F.col("l").isNull(), 0.6).otherwise(1.0), 3).alias("confidence"), F.col("l").isNotNull().alias("matched"), *kept,
    )


def calibration(plans: DataFrame, dimensions: DataFrame, walls: DataFrame, typical: float = 30.0) -> DataFrame:
    """Pixels a unit of every plan: the median of matched spans over positive values; else the longest exterior wall over ``typical`` units; else 1."""
    by_text = dimensions.where("matched and value > 0").groupBy("plan_id").agg(F.median(F.col("pixels") / F.col("value")).alias("m"))
    by_wall = walls.where("exterior").groupBy("plan_id").agg(F.max(F.col("e") - F.col("s")).alias("w"))
    wall = F.when(F.col("w") > 0, F.col("w") / typical)
    source = F.when(F.col("m").isNotNull(), "ocr_dimension_match").when(wall.isNotNull(), "longest_wall_fallback").otherwise("uncalibrated")
    return plans.select("plan_id").distinct().join(by_text.hint("merge"), "plan_id", "left").join(by_wall.hint("merge"), "plan_id", "left").select("plan_id", F.coalesce("m", wall, F.lit(1.0)).alias("pixels_per_unit"), source.alias("source"))


def text_blocks(words: DataFrame, line: list[str]) -> DataFrame:
    """Words (line keys, word_idx, left, top, width, height, conf, text) joined into blocks; a conf that is no number counts for none.

    Blank words go; a line is cut where the space from the word before exceeds max(50, 2.5 median heights)."""
    sure = F.col("conf").try_cast("double")
    own = words.where(F.trim("text") != "")
    whole, order = Window.partitionBy(*line), Window.partitionBy(*line).orderBy("left", "word_idx")
    space = F.col("left") - F.lag(F.col("left") + F.col("width")).over(order)
    cutoff = F.greatest(F.lit(50.0), 2.5 * F.median("height").over(whole))
    cut = own.withColumn("_new", F.when(space > cutoff, 1).otherwise(0)).withColumn("block", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy(*line, "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "word_idx", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("text"),
        F.min("left").alias("min_x"), F.min("top").alias("min_y"), F.max(F.col("left") + F.col("width")).alias("max_x"), F.max(F.col("top") + F.col("height")).alias("max_y"),
        F.coalesce(F.avg(F.when(sure >= 0, sure)) / 100, F.lit(0.5)).alias("confidence"),
    ).withColumns({"cx": (F.col("min_x") + F.col("max_x")) / 2, "cy": (F.col("min_y") + F.col("max_y")) / 2})


def quad_blocks(quads: DataFrame) -> DataFrame:
    """Texts found with their four corners (plan_id, ord, quad, text, confidence) as blocks: the middle is the mean of the corners."""
    x, y = (F.transform("quad", lambda p: p["x"].cast("double")), F.transform("quad", lambda p: p["y"].cast("double")))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size("quad")
    return quads.select(
        "plan_id", "ord", F.trim("text").alias("text"), mean(x).alias("cx"), mean(y).alias("cy"), F.array_min(x).alias("min_x"), F.array_min(y).alias("min_y"),
        F.array_max(x).alias("max_x"), F.array_max(y).alias("max_y"), F.col("confidence").cast("double").alias("confidence"),
    )


def first_backend(plans: DataFrame, answers: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each plan's backend and the blocks that it gave.

    ``answers`` (plan_id, backend, rank) has a row for each backend that answered for a plan, with or without texts;
    the least rank is taken, ``none`` where no backend answered.  ``blocks`` have plan_id and backend."""
    best = answers.groupBy("plan_id").agg(F.min_by("backend", F.struct("rank", "backend")).alias("backend"))
    chosen = plans.select("plan_id").distinct().join(best, "plan_id", "left").select("plan_id", F.coalesce("backend", F.lit("none")).alias("backend"))
    return chosen, blocks.join(chosen, ["plan_id", "backend"])
