"""Named queries of the plan engine, on inputs derived from the driver's tables, and their DuckDB SQL.

A derived input is one SQL text for both engines; the operators on it are DataFrame functions here and
windows, joins or recursion in the SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..functions.geometry import rectangle
from ..operators import detection, documents, faces, openings, projects, raw_documents, rooms, runs, segments, validation

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations", "documents", "labels")


def read(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived input over the tables that its text names in braces."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES})


SEGMENTS = """SELECT l_partkey AS plan_id, CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'v' END AS orient,
  CAST(50 * (l_orderkey % 6) + l_suppkey % 13 AS DOUBLE) AS perp, CAST((l_orderkey * 7 + l_linenumber * 113) % 900 AS DOUBLE) AS a0,
  CAST((l_orderkey * 7 + l_linenumber * 113) % 900 AS DOUBLE) + l_quantity * 4 AS a1 FROM {lineitem}"""
THICK = SEGMENTS.replace(" FROM", ", CAST(l_linenumber AS DOUBLE) AS thickness FROM")
RAW = """SELECT l_orderkey AS plan_id, l_linenumber AS seg_id, CAST(l_quantity AS DOUBLE) AS x1, CAST(l_linenumber AS DOUBLE) AS y1,
  CAST(l_suppkey % 50 AS DOUBLE) AS x2, CAST(l_partkey % 40 AS DOUBLE) AS y2 FROM {lineitem}"""
LEAVES = """SELECT l_partkey AS plan_id, CAST((l_orderkey * 3) % 900 AS DOUBLE) AS mx, CAST(50 * (l_suppkey % 6) + l_orderkey % 13 AS DOUBLE) AS my
  FROM {lineitem}"""
LABELS = """SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN CAST(p_size AS STRING) || ' ft' WHEN 1 THEN CAST(p_size AS STRING) || '''-6"'
  WHEN 2 THEN CAST(p_size AS STRING) || '.5m' WHEN 3 THEN 'Master Bedroom ' || CAST(p_size AS STRING) WHEN 4 THEN 'Hallway' WHEN 5 THEN CAST(p_size AS STRING)
  WHEN 6 THEN 'BATH ' || p_brand ELSE p_name END AS label FROM {part}"""
EVENTS = "SELECT user_id, event_id, CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS DOUBLE) / 1000000 AS t FROM {events}"
BOX = "CAST((s_suppkey * 37) % 200 AS DOUBLE) AS x0, CAST((s_suppkey * 53) % 200 AS DOUBLE) AS y0"
ROOMS = f"SELECT s_nationkey AS plan_id, s_suppkey AS room_id, {BOX} FROM {{supplier}}"
POINTS = """SELECT c_nationkey AS plan_id, c_custkey AS ord, c_name AS label, CAST((c_custkey * 29) % 260 AS DOUBLE) AS x, CAST((c_custkey * 31) % 260 AS DOUBLE) AS y,
  CAST(c_custkey % 50 AS DOUBLE) AS width, CAST(c_custkey % 11 AS DOUBLE) / 16 AS confidence FROM {customer}"""
PART_ROOMS = """SELECT p_partkey AS plan_id, p_partkey AS room_id, CAST((p_partkey * 17) % 300 AS DOUBLE) AS x0, CAST((p_size * 7) % 250 AS DOUBLE) AS y0,
  CAST((p_partkey * 17) % 300 + 100 + p_size AS DOUBLE) AS x1, CAST((p_size * 7) % 250 + 80 AS DOUBLE) AS y1 FROM {part}"""
DIMENSIONS = """SELECT l_partkey AS plan_id, CASE WHEN l_suppkey % 5 = 0 THEN 0.0 ELSE l_quantity END AS value, l_quantity * 20 + l_suppkey % 3 AS pixels,
  l_orderkey % 23 = 0 AS matched FROM {lineitem}"""
OPENINGS = """SELECT l_partkey AS wall_id, CAST((l_orderkey * 7) % 100 AS DOUBLE) / 100 AS position, l_linenumber % 2 = 0 AS swing FROM {lineitem}"""
ELEMENTS = """SELECT CAST(l_orderkey AS STRING) AS project_id, l_linenumber AS ord, 'wall-' || CAST(l_linenumber AS STRING) AS id,
  l_discount * 12 AS confidence, l_quantity - 3 AS thickness FROM {lineitem}"""
PROJECTS = """SELECT CAST(o_orderkey AS STRING) AS project_id, CASE WHEN o_orderkey % 10 = 0 THEN 'cubits' ELSE 'feet' END AS units FROM {orders}"""

GRID_PLANS = "SELECT DISTINCT l_partkey AS plan_id, 500 AS width, 480 AS height FROM {lineitem}"
GRID_WALLS = """SELECT l_partkey AS plan_id, CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'v' END AS orient, CAST(60 * (1 + l_orderkey % 6) AS DOUBLE) AS fixed,
  CAST(60 * (1 + l_suppkey % 4) AS DOUBLE) AS s, CAST(60 * (1 + l_suppkey % 4) AS DOUBLE) + 60 * (1 + l_quantity % 4) AS e, CAST(2 + l_partkey % 5 AS DOUBLE) AS thickness FROM {lineitem}"""
RINGS = """SELECT ring_id, i - 1 AS k, CAST(CASE WHEN 2 * i <= n THEN 20 * i ELSE 20 * (n - i) END AS DOUBLE) AS x, CASE WHEN 2 * i <= n THEN CAST(jolt AS DOUBLE) ELSE 200 + q END AS y FROM (
  SELECT l_partkey AS ring_id, l_suppkey % 25 AS jolt, l_quantity AS q, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS i, count(*) OVER (PARTITION BY l_partkey) AS n FROM {lineitem})"""

STROKES = """SELECT DISTINCT o_custkey AS plan_id, CASE WHEN o_orderkey % 2 = 0 THEN 'h' ELSE 'v' END AS orient, CAST(10 * (o_orderkey % 7) + o_orderkey % 5 AS DOUBLE) AS perp,
  CAST(5 * (o_orderkey % 11) AS DOUBLE) AS a0, CAST(5 * (o_orderkey % 11) + 20 + (o_orderkey * 7) % 90 AS DOUBLE) AS a1, CAST(2 * (1 + o_orderkey % 3) AS DOUBLE) AS thickness FROM {orders}"""

SCORED = """SELECT l_partkey AS wall_id, l_orderkey * 10 + l_linenumber AS ord, CAST((l_orderkey * 7) % 100 AS DOUBLE) / 128 AS position, CAST(l_suppkey % 5 AS DOUBLE) / 8 AS score FROM {lineitem}"""
QUADS = """SELECT l_orderkey AS plan_id, l_linenumber AS ord, l_quantity AS x, CAST(l_suppkey % 90 AS DOUBLE) AS y, CAST(l_partkey % 30 AS DOUBLE) AS w, CAST(l_linenumber AS DOUBLE) AS tilt, l_discount * 8 AS confidence, l_shipdate IS NOT NULL AS ok FROM {lineitem}"""
TEXTS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 19 = 0 THEN '[1]' WHEN o_orderkey % 23 = 0 THEN '{{' ELSE '{{"project_id":' || CASE o_orderkey % 5 WHEN 0 THEN 'null' WHEN 1 THEN '3' ELSE '"P"' END
  || CASE o_orderkey % 7 WHEN 0 THEN ',"rooms":null' WHEN 1 THEN ',"rooms":7' ELSE '' END || ',"walls":[{{"id":"w1","start":{{"x":1,"y":' || CASE o_custkey % 6 WHEN 0 THEN '"3"' WHEN 1 THEN 'null' ELSE '2.5' END || '}},"end":{{"x":4,"y":2}},"thickness":null}}]'
  || ',"doors":[{{"id":"d1","wall_id":"w1","position":0.5' || CASE o_custkey % 4 WHEN 0 THEN ',"width":null' WHEN 1 THEN ',"width":"3"' WHEN 2 THEN '' ELSE ',"width":3' END || '}}]}}' END AS floorplan_data FROM {orders}"""

# Whole drawings: each part is a plan of walls, leaves off the axes and treads twelve pixels apart, with words and one outline.
DRAWINGS = "SELECT p_partkey AS plan_id, p_name AS image, CAST(500 + p_partkey % 600 AS INT) AS width, CAST(900 - p_size AS INT) AS height FROM {part}"
DRAWN = f"""SELECT plan_id, seg_id, thickness, src, CASE WHEN orient = 'h' THEN a0 ELSE perp END AS x1, CASE WHEN orient = 'h' THEN perp ELSE a0 END AS y1,
  CASE WHEN leaf THEN CASE WHEN orient = 'h' THEN a0 ELSE perp END + 20 WHEN orient = 'h' THEN a1 ELSE perp END AS x2, CASE WHEN leaf THEN CASE WHEN orient = 'h' THEN perp ELSE a0 END + 20 WHEN orient = 'h' THEN perp ELSE a1 END AS y2
  FROM (SELECT plan_id, seg_id, thickness, CASE WHEN part_of % 2 = 0 THEN 'detail' ELSE 'wall' END AS src, part_of % 8 = 0 AS leaf, CASE WHEN part_of % 2 = 0 AND part_of % 8 <> 0 THEN 'h' ELSE orient END AS orient,
    CASE WHEN part_of % 2 = 0 AND part_of % 8 <> 0 THEN 400 + 12 * thickness ELSE perp END AS perp, CASE WHEN part_of % 2 = 0 AND part_of % 8 <> 0 THEN 600 + part_of % 3 ELSE a0 END AS a0, CASE WHEN part_of % 2 = 0 AND part_of % 8 <> 0 THEN 650 + part_of % 9 ELSE a1 END AS a1
    FROM ({THICK.replace(" AS thickness", " AS thickness, l_orderkey * 10 + l_linenumber AS seg_id, l_suppkey AS part_of")}))"""
WRITTEN = """SELECT l_partkey AS plan_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_discount) AS ord, CASE l_orderkey % 4 WHEN 0 THEN CAST(CAST(l_quantity AS INT) AS STRING) || ' ft' WHEN 1 THEN 'Master Bedroom ' || CAST(l_linenumber AS STRING) WHEN 2 THEN 'Kitchen' ELSE 'note' END AS text,
  CAST((l_orderkey * 7) % 400 AS DOUBLE) AS cx, CAST((l_orderkey * 11 + l_suppkey) % 330 AS DOUBLE) AS cy, CAST((l_orderkey * 7) % 400 - 12 AS DOUBLE) AS min_x, CAST((l_orderkey * 7) % 400 + 12 AS DOUBLE) AS max_x, l_discount * 8 AS confidence FROM {lineitem}"""


def _segments(spark, sf_dir):
    return read(spark, sf_dir, SEGMENTS)


def _walls(spark, sf_dir):
    return segments.walls(_segments(spark, sf_dir))


def segment_geometry(spark, sf_dir):
    x = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    a = geometry.angle(*x)
    return read(spark, sf_dir, RAW).select("plan_id", "seg_id", F.round(geometry.length(*x), 6).alias("length"), F.round(a, 6).alias("angle"), geometry.orientation(a).alias("orientation"))


def event_sessions(spark, sf_dir):
    e = segments.cluster_1d(read(spark, sf_dir, EVENTS), ["user_id"], "t", 3600.0, ["event_id"])
    return e.groupBy("user_id", "grp").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def cluster_1d(spark, sf_dir):
    g = segments.cluster_1d(_segments(spark, sf_dir), ["plan_id", "orient"], "perp", segments.WALL_TOLERANCE, ["a0", "a1"])
    return g.groupBy("plan_id", "orient", "grp").agg(F.count("*").alias("n"), F.avg("perp").alias("fixed"))


def exterior_walls(spark, sf_dir):
    return _walls(spark, sf_dir).select("plan_id", "orient", "grp", "run", "fixed", "s", "e", "confidence", "exterior")


def openings_classified(spark, sf_dir):
    return openings.classified(segments.walls(_segments(spark, sf_dir), gaps=True), read(spark, sf_dir, LEAVES)).withColumn("position", F.round("position", 9))


def opening_kinds(spark, sf_dir):
    return openings_classified(spark, sf_dir).groupBy("kind", "swing").agg(F.count("*").alias("n"), F.sum("width").alias("width"))


def text_blocks(spark, sf_dir):
    w = read(spark, sf_dir, "SELECT conv_id, turn, text FROM {conversations}").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("word_idx", "text"))
    n = F.length("text")
    w = w.select("conv_id", "turn", "word_idx", "text", (F.col("word_idx") * 60 + (n * 13) % 90).alias("left"), (F.lit(10) + n % 3).alias("top"), (n * 6).alias("width"), (F.lit(8) + n % 5).alias("height"), ((n * 7) % 120 - 10).alias("conf"))
    long = {c: F.col(c).cast("long") for c in ("min_x", "min_y", "max_x", "max_y")}
    return rooms.text_blocks(w, ["conv_id", "turn"]).withColumns({**long, "confidence": F.round("confidence", 9)})


def dimension_parse(spark, sf_dir):
    return read(spark, sf_dir, LABELS).select("id", text.dimension_value(F.col("label")).alias("value"))


def room_type_classify(spark, sf_dir):
    return read(spark, sf_dir, LABELS).select("id", text.kind(F.col("label")).alias("kind"), text.room_type(F.col("label")).alias("room_type"))


def _boxes(spark, sf_dir, sql):
    r = read(spark, sf_dir, sql)
    x1, y1 = (F.col("x1"), F.col("y1")) if "x1" in r.columns else (F.col("x0") + 60, F.col("y0") + 40)
    return r.select("plan_id", "room_id", rectangle(F.col("x0"), F.col("y0"), x1, y1).alias("polygon"))


def label_in_room(spark, sf_dir):
    return rooms.label_in_room(_boxes(spark, sf_dir, ROOMS), read(spark, sf_dir, POINTS))


def room_measures(spark, sf_dir):
    return _boxes(spark, sf_dir, PART_ROOMS).select("room_id", geometry.area(F.col("polygon")).alias("area"), geometry.perimeter(F.col("polygon")).alias("perimeter"))


def nearest_line(spark, sf_dir):
    lines = read(spark, sf_dir, ROOMS).select("plan_id", F.col("room_id").alias("line_id"), F.col("x0").alias("x1"), F.col("y0").alias("y1"), (F.col("x0") + 80).alias("x2"), (F.col("y0") + F.col("room_id") % 7).alias("y2"))
    return rooms.nearest_line(read(spark, sf_dir, POINTS), lines)


def calibration(spark, sf_dir):
    return rooms.calibration(read(spark, sf_dir, "SELECT p_partkey AS plan_id FROM {part}"), read(spark, sf_dir, DIMENSIONS), _walls(spark, sf_dir))


def _named(spark, sf_dir):
    return _walls(spark, sf_dir).withColumn("wall_id", F.concat_ws("-", "orient", F.col("grp").cast("string"), F.col("run").cast("string")))


def room_boundary(spark, sf_dir):
    return rooms.boundary(_boxes(spark, sf_dir, PART_ROOMS), _named(spark, sf_dir))


def room_confidence(spark, sf_dir):
    r, w = _boxes(spark, sf_dir, PART_ROOMS), _named(spark, sf_dir)
    return rooms.room_confidence(r, rooms.boundary(r, w), w)


def duplicate_ids(spark, sf_dir):
    part = lambda k, m: read(spark, sf_dir, f"SELECT o_custkey AS plan_id, CAST(o_orderkey % {m} AS STRING) AS id, {k} AS collection, o_orderkey AS ord FROM {{orders}} WHERE o_orderkey % 2 = {k}")
    return validation.duplicate_ids(part(0, 6), part(1, 9)).select("plan_id", "id", F.col("collection").cast("long").alias("collection"), "ord", F.col("nth").cast("long").alias("nth"))


def dangling_refs(spark, sf_dir):
    o, n = read(spark, sf_dir, "SELECT o_orderkey FROM {orders}"), read(spark, sf_dir, "SELECT l_orderkey FROM {lineitem}")
    return validation.dangling(o, "o_orderkey", n, "l_orderkey")


def project_page(spark, sf_dir):
    rows = read(spark, sf_dir, "SELECT o_orderkey AS id, o_orderdate AS created_at, o_orderstatus AS status FROM {orders}")
    return projects.page(rows, 100, 20).select("id", "status")


def project_patch(spark, sf_dir):
    rows = read(spark, sf_dir, "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS description FROM {customer}")
    new = read(spark, sf_dir, "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'renamed' END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'changed' END AS description FROM {customer} WHERE c_custkey % 7 = 0")
    gone = read(spark, sf_dir, "SELECT c_custkey AS id FROM {customer} WHERE c_custkey % 11 = 0")
    return projects.remove(projects.patch(rows, new, ["name", "description"]), gone)


def _documents(spark, sf_dir):
    e = read(spark, sf_dir, ELEMENTS)
    point = lambda k: F.struct((F.col("ord") * k).cast("double").alias("x"), F.lit(0.0).alias("y"))
    wall = F.struct("id", "confidence", F.lit("ai_detection").alias("source"), F.create_map().cast("map<string,string>").alias("metadata"), point(1).alias("start"), point(2).alias("end"), "thickness", F.lit(None).cast("double").alias("height"), F.lit("exterior").alias("wall_type"))
    return documents.assemble(read(spark, sf_dir, PROJECTS), {"walls": e.select("project_id", "ord", wall.alias("element"))})


def doc_roundtrip(spark, sf_dir):
    back = documents.from_json(documents.as_json(_documents(spark, sf_dir)))
    return documents.elements(back, "walls").select("project_id", "id", "confidence", "thickness")


def doc_summary(spark, sf_dir):
    return documents.summary(_documents(spark, sf_dir))


def segments_oriented(spark, sf_dir):
    return detection.oriented(read(spark, sf_dir, RAW)).select("plan_id", "seg_id", "orient", "perp", "a0", "a1")


def leaf_middles(spark, sf_dir):
    return detection.leaves(read(spark, sf_dir, RAW))


def plan_skew(spark, sf_dir):
    plans = read(spark, sf_dir, "SELECT o_orderkey AS plan_id FROM {orders}")
    return detection.skew(plans, read(spark, sf_dir, RAW)).withColumn("skew", F.round("skew", 6))


def ring_bounds(spark, sf_dir):
    return _boxes(spark, sf_dir, PART_ROOMS).select("room_id", geometry.bounds(F.col("polygon")).alias("b")).select("room_id", "b.*")


def px_to_units(spark, sf_dir):
    rows = read(spark, sf_dir, "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS px, CAST(p_partkey % 5 - 1 AS DOUBLE) AS per_unit FROM {part}")
    return rows.select("id", F.round(detection.to_units(F.col("px"), F.col("per_unit")), 3).alias("units"))


def thin_walls(spark, sf_dir):
    return detection.split_walls(segments.walls(read(spark, sf_dir, THICK)))[1].select("plan_id", "orient", "grp", "run", "s", "e", "thickness")


def thick_walls(spark, sf_dir):
    return detection.split_walls(segments.walls(read(spark, sf_dir, THICK)))[0].select("plan_id", "orient", "grp", "run", "fixed", "exterior")


def project_names(spark, sf_dir):
    rows = read(spark, sf_dir, "SELECT o_orderkey AS id, repeat('n', CAST(o_orderkey % 250 AS INT)) AS name, repeat('d', CAST(o_custkey * 7 % 2500 AS INT)) AS description FROM {orders}")
    return rows.select("id", F.array_join(projects.name_errors(F.col("name"), F.col("description")), ",").alias("errors"))


def range_rules(spark, sf_dir):
    return validation.validate(_documents(spark, sf_dir)).select("project_id", "is_valid", F.size("errors").cast("long").alias("n_errors"))


def _corners(ring):
    """A ring as text, in half pixels."""
    return F.array_join(F.transform(ring, lambda p: F.concat_ws(",", F.floor(2 * p["x"] + 0.5), F.floor(2 * p["y"] + 0.5))), ";")


def room_faces(spark, sf_dir):
    found = faces.outlines(read(spark, sf_dir, GRID_WALLS), read(spark, sf_dir, GRID_PLANS))
    return found.select("plan_id", "area", geometry.bounds(F.col("polygon")).alias("box"), _corners(F.col("polygon")).alias("corners")).select("plan_id", "area", "box.*", "corners")


def suppress_scored(spark, sf_dir):
    return openings.suppress_scored(read(spark, sf_dir, SCORED), ["wall_id"])


def quad_blocks(spark, sf_dir):
    q = read(spark, sf_dir, QUADS)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, t = (F.col(c) for c in ("x", "y", "w", "tilt"))
    return rooms.quad_blocks(q.select("plan_id", "ord", F.array(point(x, y), point(x + w, y + t), point(x + w - t, y + t + 8), point(x - t, y + 8)).alias("quad"), F.lit(" a b ").alias("text"), "confidence"))


def raw_document_errors(spark, sf_dir):
    return raw_documents.checked(read(spark, sf_dir, TEXTS)).select("id", F.array_join("errors", "; ").alias("errors"))


def wall_mask(spark, sf_dir):
    return runs.wall_mask(runs.stroke_boxes(read(spark, sf_dir, STROKES)))


def detail_mask(spark, sf_dir):
    return runs.detail_mask(runs.stroke_boxes(read(spark, sf_dir, STROKES)))


def wall_thickness(spark, sf_dir):
    strokes = read(spark, sf_dir, STROKES)
    walls = strokes.select("plan_id", "orient", F.col("a0").alias("s"), F.col("a1").alias("e"), F.col("perp").alias("fixed")).distinct()
    walls = walls.withColumn("wall_id", F.concat_ws("/", "orient", *[F.col(c).cast("long").cast("string") for c in ("fixed", "s", "e")]))
    return runs.thickness(walls, runs.stroke_boxes(strokes))


def _rings(spark, sf_dir):
    rows = read(spark, sf_dir, RINGS).groupBy("ring_id").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("p"))
    return rows.select("ring_id", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("polygon"))


def ring_simplify(spark, sf_dir):
    return faces.simplified(_rings(spark, sf_dir)).select("ring_id", F.size("polygon").cast("long").alias("n"), _corners(F.col("polygon")).alias("corners"))


def ring_measures(spark, sf_dir):
    p = F.col("polygon")
    return _rings(spark, sf_dir).select("ring_id", F.round(geometry.area(p), 6).alias("area"), F.round(geometry.perimeter(p), 6).alias("perimeter"), geometry.bounds(p).alias("box")).select("ring_id", "area", "perimeter", "box.*")


def detect_document(spark, sf_dir):
    """Whole detection, its documents laid out by element: the places and sizes of each as v1 to v5, and a row for the document itself."""
    found = detection.detect(read(spark, sf_dir, DRAWINGS), read(spark, sf_dir, DRAWN), _boxes(spark, sf_dir, PART_ROOMS), read(spark, sf_dir, WRITTEN))

    def row(kind, id_, confidence, what, *v):
        v = [*v, *[F.lit(None)] * (5 - len(v))]
        return F.struct(F.lit(kind).alias("kind"), id_.alias("id"), confidence.cast("double").alias("confidence"), what.cast("string").alias("what"), *[x.cast("double").alias(f"v{k}") for k, x in enumerate(v, 1)])

    def rows(kind, what, *values):
        return F.transform(kind + "s", lambda e: row(kind, e["id"], e["confidence"], what(e), *[f(e) for f in values]))

    ends = [lambda e, a=a, c=c: e[a][c] for a in ("start", "end") for c in ("x", "y")]
    corners = [lambda e, k=k, c=c: F.get(e["polygon"], F.lit(k))[c] for k in (0, 2) for c in ("x", "y")]
    on_wall = [lambda e: e["position"], lambda e: e["width"]]
    place = lambda e: F.concat_ws(" ", e["wall_id"], e["swing"])
    parts = [
        rows("room", lambda e: F.concat_ws("/", e["name"], e["room_type"]), *corners), rows("wall", lambda e: e["wall_type"], *ends, lambda e: e["thickness"]),
        rows("door", place, *on_wall), rows("window", lambda e: e["wall_id"], *on_wall), rows("stair", lambda e: F.lit(None), *corners), rows("dimension", lambda e: e["label"], *ends, lambda e: e["value"]),
        F.array(row("document", F.col("metadata.extra")["calibration_source"], F.lit(None), F.col("metadata.notes"))),
    ]
    return found.select("project_id", F.explode(F.concat(*parts)).alias("x")).select("project_id", "x.*")


QUERIES = {
    "wall_runs": lambda spark, sf_dir: segments.wall_runs(_segments(spark, sf_dir)).drop("fixed"),
    "opening_candidates": lambda spark, sf_dir: openings.opening_candidates(_segments(spark, sf_dir)),
    "suppress_openings": lambda spark, sf_dir: openings.suppress(read(spark, sf_dir, OPENINGS), ["wall_id"]),
    "stair_clusters": lambda spark, sf_dir: segments.stair_clusters(_segments(spark, sf_dir)),
} | {
    f.__name__: f
    for f in (segment_geometry, event_sessions, cluster_1d, exterior_walls, openings_classified, opening_kinds, text_blocks, dimension_parse, room_type_classify, label_in_room, room_measures,
              nearest_line, calibration, room_boundary, room_confidence, duplicate_ids, dangling_refs, project_page, project_patch, doc_roundtrip, doc_summary, range_rules,
              segments_oriented, leaf_middles, plan_skew, ring_bounds, px_to_units, thin_walls, thick_walls, project_names, room_faces, ring_simplify, ring_measures, wall_mask, detail_mask, wall_thickness, suppress_scored, quad_blocks, raw_document_errors, detect_document)
}

_A = f"""a AS (SELECT *, degrees(atan2(y2 - y1, x2 - x1)) AS d FROM ({RAW})), b AS (SELECT *, CASE WHEN d < 0 THEN d + 180 WHEN d >= 180 THEN d - 180 ELSE d END AS m FROM a)"""
_G = f"""seg AS ({SEGMENTS}),
g0 AS (SELECT *, lag(perp) OVER (PARTITION BY plan_id, orient ORDER BY perp, a0, a1) AS pp FROM seg),
g AS (SELECT *, CAST(sum(CASE WHEN perp - pp > 8.0 THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id, orient ORDER BY perp, a0, a1 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM g0)"""
_R = f"""{_G},
r0 AS (SELECT *, max(a1) OVER (PARTITION BY plan_id, orient, grp ORDER BY a0, a1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM g),
r AS (SELECT *, CAST(sum(CASE WHEN a0 - pe > 160.0 THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id, orient, grp ORDER BY a0, a1 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM r0)"""
_W = f"""{_R},
runs AS (SELECT plan_id, orient, grp, run, min(a0) AS s, max(a1) AS e, sum(a1 - a0) AS votes FROM r GROUP BY ALL),
fx AS (SELECT plan_id, orient, grp, avg(perp) AS fixed FROM g GROUP BY ALL),
w0 AS (SELECT *, CASE WHEN e - s <= 0 THEN 0.5 ELSE round(0.5 + 0.5 * least(1.0::DOUBLE, votes / (e - s)), 3) END AS confidence,
  CASE WHEN orient = 'h' THEN fixed ELSE s END AS ya, CASE WHEN orient = 'h' THEN fixed ELSE e END AS yb, CASE WHEN orient = 'h' THEN s ELSE fixed END AS xa, CASE WHEN orient = 'h' THEN e ELSE fixed END AS xb
  FROM runs JOIN fx USING (plan_id, orient, grp)),
w1 AS (SELECT *, CASE WHEN orient = 'h' THEN min(ya) OVER p ELSE min(xa) OVER p END AS lo, CASE WHEN orient = 'h' THEN max(yb) OVER p ELSE max(xb) OVER p END AS hi FROM w0 WINDOW p AS (PARTITION BY plan_id)),
walls AS (SELECT plan_id, orient, grp, run, s, e, fixed, confidence, abs(fixed - lo) <= 12 OR abs(fixed - hi) <= 12 AS exterior, orient || '-' || grp || '-' || run AS wall_id FROM w1)"""
_O = f"""{_W}, leaves AS ({LEAVES}),
o AS (SELECT r.plan_id, r.orient, r.grp, r.run, pe AS gap_start, a0 AS gap_end, s, e, fixed, exterior FROM r JOIN walls USING (plan_id, orient, grp, run) WHERE a0 - pe > 6 AND a0 - pe <= 160 AND e > s),
c AS (SELECT o.*, EXISTS (SELECT 1 FROM leaves l WHERE l.plan_id = o.plan_id AND least(pow(mx - CASE WHEN orient = 'h' THEN gap_start ELSE fixed END, 2) + pow(my - CASE WHEN orient = 'h' THEN fixed ELSE gap_start END, 2),
  pow(mx - CASE WHEN orient = 'h' THEN gap_end ELSE fixed END, 2) + pow(my - CASE WHEN orient = 'h' THEN fixed ELSE gap_end END, 2)) <= 900) AS swing FROM o),
opening AS (SELECT plan_id, orient, grp, run, gap_start, gap_end, gap_end - gap_start AS width, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((gap_start + gap_end) / 2 - s) / (e - s))), 9) AS position,
  CASE WHEN swing THEN 'door' WHEN exterior THEN 'window' ELSE 'door' END AS kind, swing, CASE WHEN swing THEN 0.55::DOUBLE ELSE 0.45::DOUBLE END AS confidence FROM c)"""
_DIM = text.DIMENSION.replace("'", "''")
_TYPE = "CASE " + " ".join(f"WHEN contains(lower(label), '{p}') THEN '{k}'" for p, k in text.ROOM_TYPES.items()) + " END"
_VALUE = f"CASE WHEN regexp_matches(label, '{_DIM}') THEN CAST(regexp_extract(label, '{_DIM}', 1) AS DOUBLE) + coalesce(TRY_CAST(nullif(regexp_extract(label, '{_DIM}', 2), '') AS DOUBLE), 0.0::DOUBLE) / 12 END"
_EDGES = f"""room AS ({PART_ROOMS}),
edge AS (SELECT plan_id, room_id, 0 AS k, 'h' AS orient, y0 AS f FROM room UNION ALL SELECT plan_id, room_id, 1, 'v', x1 FROM room UNION ALL SELECT plan_id, room_id, 2, 'h', y1 FROM room UNION ALL SELECT plan_id, room_id, 3, 'v', x0 FROM room),
met AS (SELECT edge.plan_id, room_id, k, wall_id, row_number() OVER (PARTITION BY edge.plan_id, room_id, k ORDER BY abs(fixed - f), wall_id) AS nth FROM edge JOIN walls w ON w.plan_id = edge.plan_id AND w.orient = edge.orient AND abs(fixed - f) < 12),
bound AS (SELECT DISTINCT plan_id, room_id, wall_id FROM met WHERE nth = 1)"""
# A full grid of cells over the bars' coordinates, flooded by least labels; its outer sides are walked edge by edge.
_FACES = f"""WITH RECURSIVE wall AS (SELECT w.*, greatest(2, round(thickness)) / 2 AS h, p.width, p.height FROM ({GRID_WALLS}) w JOIN ({GRID_PLANS}) p USING (plan_id)),
raw AS (SELECT plan_id, CASE WHEN orient = 'h' THEN s - h ELSE fixed - h END AS x0, CASE WHEN orient = 'h' THEN e + h ELSE fixed + h END AS x1, CASE WHEN orient = 'h' THEN fixed - h ELSE s - h END AS y0, CASE WHEN orient = 'h' THEN fixed + h ELSE e + h END AS y1 FROM wall),
bar AS (SELECT plan_id, greatest(x0, 0) AS x0, least(x1, 500) AS x1, greatest(y0, 0) AS y0, least(y1, 480) AS y1 FROM raw),
xs AS (SELECT plan_id, x0 AS x FROM bar UNION SELECT plan_id, x1 FROM bar UNION SELECT plan_id, unnest([0, 500]) FROM bar), ys AS (SELECT plan_id, y0 AS y FROM bar UNION SELECT plan_id, y1 FROM bar UNION SELECT plan_id, unnest([0, 480]) FROM bar),
xi AS (SELECT plan_id, x AS x0, lead(x) OVER w AS x1, row_number() OVER w AS i FROM xs WINDOW w AS (PARTITION BY plan_id ORDER BY x)), yi AS (SELECT plan_id, y AS y0, lead(y) OVER w AS y1, row_number() OVER w AS j FROM ys WINDOW w AS (PARTITION BY plan_id ORDER BY y)),
cell AS MATERIALIZED (SELECT plan_id, i, j, 1000 * j + i AS c, x0, x1, y0, y1 FROM xi JOIN yi USING (plan_id) WHERE x1 IS NOT NULL AND y1 IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM bar b WHERE b.plan_id = xi.plan_id AND b.x0 <= xi.x0 AND b.x1 >= xi.x1 AND b.y0 <= yi.y0 AND b.y1 >= yi.y1)),
edge AS MATERIALIZED (SELECT a.plan_id, a.c AS a, b.c AS b FROM cell a JOIN cell b ON a.plan_id = b.plan_id AND abs(a.i - b.i) + abs(a.j - b.j) = 1 AND b.c IN (a.c - 1, a.c + 1, a.c - 1000, a.c + 1000)),
lab(plan_id, c, label) USING KEY (plan_id, c) AS (SELECT plan_id, c, c FROM cell UNION
  SELECT e.plan_id, e.b, min(r.label) FROM lab r JOIN edge e ON e.plan_id = r.plan_id AND e.a = r.c JOIN recurring.lab o ON o.plan_id = e.plan_id AND o.c = e.b WHERE r.label < o.label GROUP BY ALL),
own AS (SELECT cell.*, label FROM cell JOIN lab USING (plan_id, c)),
side AS (SELECT plan_id, label, x0 AS xa, y0 AS ya, x1 AS xb, y0 AS yb, 0 AS way FROM own o WHERE NOT EXISTS (SELECT 1 FROM cell n WHERE n.plan_id = o.plan_id AND n.c = o.c - 1000)
  UNION ALL SELECT plan_id, label, x1, y0, x1, y1, 1 FROM own o WHERE NOT EXISTS (SELECT 1 FROM cell n WHERE n.plan_id = o.plan_id AND n.c = o.c + 1)
  UNION ALL SELECT plan_id, label, x1, y1, x0, y1, 2 FROM own o WHERE NOT EXISTS (SELECT 1 FROM cell n WHERE n.plan_id = o.plan_id AND n.c = o.c + 1000)
  UNION ALL SELECT plan_id, label, x0, y1, x0, y0, 3 FROM own o WHERE NOT EXISTS (SELECT 1 FROM cell n WHERE n.plan_id = o.plan_id AND n.c = o.c - 1)),
nxt AS MATERIALIZED (SELECT a.plan_id, a.label, a.xa, a.ya, a.way, b.xa AS xn, b.ya AS yn, b.way AS wn FROM side a JOIN side b ON b.plan_id = a.plan_id AND b.label = a.label AND b.xa = a.xb AND b.ya = a.yb
  QUALIFY row_number() OVER (PARTITION BY a.plan_id, a.label, a.xa, a.ya, a.way ORDER BY CASE (b.way - a.way + 4) % 4 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) = 1),
start AS (SELECT plan_id, label, arg_min(xa, (ya, xa)) AS sx, min(ya) AS sy FROM side WHERE way = 0 GROUP BY ALL),
walk AS (SELECT plan_id, label, 0 AS step, sx AS x, sy AS y, 0 AS way, 3 AS before, sx, sy FROM start UNION ALL
  SELECT w.plan_id, w.label, step + 1, xn, yn, wn, w.way, sx, sy FROM walk w JOIN nxt n ON n.plan_id = w.plan_id AND n.label = w.label AND n.xa = w.x AND n.ya = w.y AND n.way = w.way WHERE NOT (xn = sx AND yn = sy AND wn = 0)),
corner AS (SELECT *, coalesce(lead(x) OVER w, sx) AS xn, coalesce(lead(y) OVER w, sy) AS yn FROM walk WHERE way <> before WINDOW w AS (PARTITION BY plan_id, label ORDER BY step)),
face AS (SELECT plan_id, label, abs(sum(x * yn - xn * y)) / 2 AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, string_agg(CAST(2 * x AS BIGINT) || ',' || CAST(2 * y AS BIGINT), ';' ORDER BY step) AS corners FROM corner GROUP BY ALL)
SELECT plan_id, area, x0, y0, x1, y1, corners FROM face WHERE area >= 2000 AND NOT ((x0 <= 1 OR y0 <= 1 OR x1 >= 499 OR y1 >= 479) AND area > 0.5 * 500 * 480)"""
_RING = f"""p AS ({RINGS}), m AS (SELECT *, count(*) OVER r AS n, coalesce(lead(x) OVER w, first(x) OVER w) AS xn, coalesce(lead(y) OVER w, first(y) OVER w) AS yn FROM p WINDOW w AS (PARTITION BY ring_id ORDER BY k), r AS (PARTITION BY ring_id))"""
# Pixels of the strokes; long columns and rows by counting neighbours, and runs of what is asked.
_PIXELS = f"""st AS ({STROKES}), low AS (SELECT *, CAST(perp - thickness / 2 AS BIGINT) AS lo, CAST(thickness AS BIGINT) AS n, CAST(a0 AS BIGINT) AS b0, CAST(a1 AS BIGINT) AS b1 FROM st),
long AS (SELECT plan_id, orient, lo, n, unnest(range(b0, b1)) AS t FROM low), dot AS (SELECT plan_id, orient, t, unnest(range(lo, lo + n)) AS u FROM long),
px AS MATERIALIZED (SELECT DISTINCT plan_id, CASE WHEN orient = 'h' THEN t ELSE u END AS x, CASE WHEN orient = 'h' THEN u ELSE t END AS y FROM dot)"""
_MASK = f"""{_PIXELS}, isl AS (SELECT *, x - row_number() OVER (PARTITION BY plan_id, y ORDER BY x) AS r, y - row_number() OVER (PARTITION BY plan_id, x ORDER BY y) AS c FROM px),
big AS (SELECT plan_id, x, y, count(*) OVER (PARTITION BY plan_id, y, r) >= 70 OR count(*) OVER (PARTITION BY plan_id, x, c) >= 70 AS wall FROM isl)"""
_RUNS = "SELECT plan_id, y, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY plan_id, y ORDER BY x) AS g FROM big WHERE {}) GROUP BY plan_id, y, g"

ORACLES = {k: duck(v) for k, v in {
    "suppress_scored": f"""WITH RECURSIVE w AS (SELECT wall_id, list(ord ORDER BY position, ord) AS o, list(position ORDER BY position, ord) AS p, list(score ORDER BY position, ord) AS s, count(*) AS n FROM ({SCORED}) GROUP BY wall_id),
r AS (SELECT wall_id, 1 AS i, CAST([] AS BIGINT[]) AS gone FROM w UNION ALL
  SELECT r.wall_id, i + 1, CASE WHEN list_contains(gone, i) THEN gone ELSE list_concat(gone, [j FOR j IN range(i + 1, n + 1) IF NOT list_contains(gone, j) AND abs(p[i] - p[j]) < 0.05 AND s[j] <= s[i]],
    CASE WHEN len([j FOR j IN range(i + 1, n + 1) IF NOT list_contains(gone, j) AND abs(p[i] - p[j]) < 0.05 AND s[j] > s[i]]) > 0 THEN [CAST(i AS BIGINT)] ELSE CAST([] AS BIGINT[]) END) END FROM r JOIN w USING (wall_id) WHERE i <= n),
k AS (SELECT w.*, unnest(range(1, n + 1)) AS i, gone FROM w JOIN r USING (wall_id) WHERE r.i = n + 1)
SELECT wall_id, o[i] AS ord, p[i] AS position, s[i] AS score FROM k WHERE NOT list_contains(gone, i)""",
    "quad_blocks": f"""SELECT plan_id, ord, 'a b' AS text, (x + x + w + x + w - tilt + x - tilt) / 4 AS cx, (y + y + tilt + y + tilt + 8 + y + 8) / 4 AS cy, x - tilt AS min_x, y AS min_y,
x + w AS max_x, y + tilt + 8 AS max_y, confidence FROM ({QUADS})""",
    "raw_document_errors": f"""WITH t AS ({TEXTS}), v AS (SELECT id, CASE WHEN json_valid(floorplan_data) THEN CAST(floorplan_data AS JSON) END AS j FROM t) SELECT id, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'document: not an object' ELSE concat_ws('; ',
  CASE json_type(j, '$.project_id') WHEN 'NULL' THEN 'project_id: null' ELSE CASE WHEN json_type(j, '$.project_id') IS NULL THEN 'project_id: missing' WHEN json_type(j, '$.project_id') NOT IN ('VARCHAR') THEN 'project_id: not text' END END, CASE json_type(j, '$.rooms') WHEN 'NULL' THEN 'rooms: null' ELSE CASE WHEN json_type(j, '$.rooms') IS NULL THEN NULL WHEN json_type(j, '$.rooms') NOT IN ('ARRAY') THEN 'rooms: not a list' END END, CASE json_type(j, '$.walls[0].start.y') WHEN 'NULL' THEN 'walls.0.start.y: null' ELSE CASE WHEN json_type(j, '$.walls[0].start.y') IS NULL THEN 'walls.0.start.y: missing' WHEN json_type(j, '$.walls[0].start.y') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'walls.0.start.y: not a number' END END, CASE json_type(j, '$.doors[0].width') WHEN 'NULL' THEN 'doors.0.width: null' ELSE CASE WHEN json_type(j, '$.doors[0].width') IS NULL THEN 'doors.0.width: missing' WHEN json_type(j, '$.doors[0].width') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'doors.0.width: not a number' END END) END AS errors FROM v""",
    "wall_mask": f"WITH {_MASK} " + _RUNS.replace("{}", "wall"),
    "detail_mask": f"WITH {_MASK} " + _RUNS.replace("{}", "NOT wall"),
    "wall_thickness": f"""WITH {_PIXELS}, w AS (SELECT DISTINCT plan_id, orient, orient || '/' || CAST(perp AS BIGINT) || '/' || b0 || '/' || b1 AS wall_id, CAST(round_even((b0 + b1) / 2, 0) AS BIGINT) AS m, CAST(perp AS BIGINT) AS f FROM low),
c AS (SELECT w.plan_id, w.wall_id, count(*) AS n FROM w JOIN px ON px.plan_id = w.plan_id AND CASE WHEN orient = 'h' THEN px.x ELSE px.y END = m AND abs(CASE WHEN orient = 'h' THEN px.y ELSE px.x END - f) <= 25 GROUP BY ALL)
SELECT plan_id, wall_id, coalesce(n, 4)::DOUBLE AS thickness FROM w LEFT JOIN c USING (plan_id, wall_id)""",
    "room_faces": _FACES,
    "ring_measures": f"WITH {_RING} SELECT ring_id, round(abs(sum(x * yn - xn * y)) / 2, 6) AS area, round(sum(sqrt(pow(xn - x, 2) + pow(yn - y, 2))), 6) AS perimeter, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM m GROUP BY ring_id",
    "ring_simplify": f"""WITH RECURSIVE {_RING}, lim AS (SELECT ring_id, max(n) AS n, 0.01::DOUBLE * sum(sqrt(pow(xn - x, 2) + pow(yn - y, 2))) AS eps FROM m GROUP BY ring_id),
far AS (SELECT a.ring_id, arg_max(b.k, (pow(b.x - a.x, 2) + pow(b.y - a.y, 2), -b.k)) AS far FROM p a JOIN p b ON a.ring_id = b.ring_id AND a.k = 0 AND b.k > 0 GROUP BY a.ring_id),
q AS (SELECT ring_id, k, x, y FROM p UNION ALL SELECT ring_id, n, x, y FROM p JOIN lim USING (ring_id) WHERE k = 0),
s AS (SELECT ring_id, 0 AS a, far AS b FROM far UNION ALL SELECT ring_id, far, n FROM far JOIN lim USING (ring_id) UNION ALL
  SELECT ring_id, unnest([a, k]), unnest([k, b]) FROM (SELECT t.ring_id, t.a, t.b, arg_max(k, (d, -k)) AS k FROM (
    SELECT s.ring_id, s.a, s.b, c.k, CASE WHEN f.x = e.x AND f.y = e.y THEN sqrt(pow(c.x - e.x, 2) + pow(c.y - e.y, 2)) ELSE abs((f.x - e.x) * (c.y - e.y) - (f.y - e.y) * (c.x - e.x)) / sqrt(pow(f.x - e.x, 2) + pow(f.y - e.y, 2)) END AS d
    FROM s JOIN q e ON e.ring_id = s.ring_id AND e.k = s.a JOIN q f ON f.ring_id = s.ring_id AND f.k = s.b JOIN q c ON c.ring_id = s.ring_id AND c.k > s.a AND c.k < s.b) t JOIN lim USING (ring_id) GROUP BY t.ring_id, t.a, t.b HAVING max(d) > any_value(eps)) u),
kept AS (SELECT ring_id, a AS k FROM s UNION SELECT ring_id, k FROM p JOIN lim USING (ring_id) WHERE n < 4)
SELECT ring_id, count(*) AS n, string_agg(CAST(round(2 * x) AS BIGINT) || ',' || CAST(round(2 * y) AS BIGINT), ';' ORDER BY k) AS corners FROM kept JOIN p USING (ring_id, k) GROUP BY ring_id HAVING count(*) >= 3""",
    "wall_runs": f"WITH {_R} SELECT plan_id, orient, grp, run, min(a0) AS s, max(a1) AS e, sum(a1 - a0) AS votes, count(*) AS n, count(*) FILTER (a0 - pe > 6 AND a0 - pe <= 160) AS openings FROM r GROUP BY ALL",
    "opening_candidates": f"WITH {_R} SELECT plan_id, orient, grp, run, pe AS gap_start, a0 AS gap_end FROM r WHERE a0 - pe > 6 AND a0 - pe <= 160",
    "cluster_1d": f"WITH {_G} SELECT plan_id, orient, grp, count(*) AS n, avg(perp) AS fixed FROM g GROUP BY ALL",
    "exterior_walls": f"WITH {_W} SELECT plan_id, orient, grp, run, fixed, s, e, confidence, exterior FROM walls",
    "openings_classified": f"WITH {_O} SELECT * FROM opening",
    "opening_kinds": f"WITH {_O} SELECT kind, swing, count(*) AS n, sum(width) AS width FROM opening GROUP BY ALL",
    "segment_geometry": f"WITH a AS (SELECT *, degrees(atan2(y2 - y1, x2 - x1)) AS d FROM ({RAW})), b AS (SELECT *, CASE WHEN d < 0 THEN d + 180 WHEN d >= 180 THEN d - 180 ELSE d END AS m FROM a) "
    "SELECT plan_id, seg_id, round(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), 6) AS length, round(d, 6) AS angle, CASE WHEN m <= 10 OR m >= 170 THEN 'horizontal' WHEN m BETWEEN 80 AND 100 THEN 'vertical' END AS orientation FROM b",
    "segments_oriented": f"""WITH {_A} SELECT plan_id, seg_id, CASE WHEN m <= 10 OR m >= 170 THEN 'h' ELSE 'v' END AS orient, CASE WHEN m <= 10 OR m >= 170 THEN (y1 + y2) / 2 ELSE (x1 + x2) / 2 END AS perp,
CASE WHEN m <= 10 OR m >= 170 THEN least(x1, x2) ELSE least(y1, y2) END AS a0, CASE WHEN m <= 10 OR m >= 170 THEN greatest(x1, x2) ELSE greatest(y1, y2) END AS a1 FROM b WHERE m <= 10 OR m >= 170 OR m BETWEEN 80 AND 100""",
    "leaf_middles": f"WITH {_A} SELECT plan_id, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my FROM b WHERE NOT (m <= 10 OR m >= 170 OR m BETWEEN 80 AND 100)",
    "plan_skew": f"WITH {_A}, s AS (SELECT plan_id, median(d + 45 - 90 * floor((d + 45) / 90) - 45) AS m FROM b GROUP BY plan_id) SELECT o_orderkey AS plan_id, round(coalesce(m, 0.0::DOUBLE), 6) AS skew FROM orders LEFT JOIN s ON plan_id = o_orderkey",
    "ring_bounds": f"SELECT room_id, x0, y0, x1, y1 FROM ({PART_ROOMS})",
    "px_to_units": "SELECT p_partkey AS id, round(CASE WHEN p_partkey % 5 - 1 <= 0 THEN p_size::DOUBLE ELSE p_size / (p_partkey % 5 - 1)::DOUBLE END, 3) AS units FROM part",
    "thin_walls": f"WITH {_R.replace(SEGMENTS, THICK)} SELECT plan_id, orient, grp, run, min(a0) AS s, max(a1) AS e, avg(thickness) AS thickness FROM r GROUP BY plan_id, orient, grp, run HAVING avg(thickness) < 2.5",
    "thick_walls": f"WITH {_W.replace(SEGMENTS, THICK).replace('FROM r GROUP BY ALL', 'FROM r GROUP BY ALL HAVING avg(thickness) >= 2.5')} SELECT plan_id, orient, grp, run, fixed, exterior FROM walls",
    "project_names": "SELECT o_orderkey AS id, concat_ws(',', CASE WHEN o_orderkey % 250 NOT BETWEEN 1 AND 200 THEN 'name' END, CASE WHEN o_custkey * 7 % 2500 > 2000 THEN 'description' END) AS errors FROM orders",
    "event_sessions": "WITH e AS (SELECT user_id, event_id, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS t FROM events), l AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS step FROM e), g AS (SELECT *, CAST(sum(CASE WHEN step > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM l) "
    "SELECT user_id, grp, count(*) AS n, min(event_id) AS first_event FROM g GROUP BY ALL",
    "suppress_openings": f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY wall_id ORDER BY position, swing) AS i FROM ({OPENINGS})),
f AS (SELECT wall_id, i, 1 AS slot, position, swing FROM o WHERE i = 1 UNION ALL
SELECT o.wall_id, o.i, f.slot + CASE WHEN abs(o.position - f.position) < 0.05 THEN 0 ELSE 1 END, CASE WHEN abs(o.position - f.position) < 0.05 AND (f.swing OR NOT o.swing) THEN f.position ELSE o.position END,
CASE WHEN abs(o.position - f.position) < 0.05 AND (f.swing OR NOT o.swing) THEN f.swing ELSE o.swing END FROM f JOIN o ON o.wall_id = f.wall_id AND o.i = f.i + 1)
SELECT wall_id, arg_max(position, i) AS position, arg_max(swing, i) AS swing FROM f GROUP BY wall_id, slot""",
    "stair_clusters": f"""WITH seg AS ({SEGMENTS}), s0 AS (SELECT *, lag(perp) OVER (PARTITION BY plan_id, orient ORDER BY perp, a0, a1) AS pp FROM seg WHERE a1 - a0 <= 90),
s1 AS (SELECT *, sum(CASE WHEN perp - pp > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id, orient ORDER BY perp, a0, a1 ROWS UNBOUNDED PRECEDING) AS frag FROM s0),
t AS (SELECT plan_id, orient, frag, min(a0) AS a0, max(a1) AS a1, avg(perp) AS perp FROM s1 GROUP BY ALL),
t1 AS (SELECT *, perp - lag(perp) OVER (PARTITION BY plan_id, orient ORDER BY perp, frag) AS step FROM t),
t2 AS (SELECT *, CAST(sum(CASE WHEN step > 18 THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id, orient ORDER BY perp, frag ROWS UNBOUNDED PRECEDING) AS BIGINT) AS flight FROM t1),
t3 AS (SELECT *, perp - lag(perp) OVER (PARTITION BY plan_id, orient, flight ORDER BY perp, frag) AS gap FROM t2),
f AS (SELECT plan_id, orient, flight, count(*) AS treads, min(a0) AS a0, max(a1) AS a1, min(perp) AS p0, max(perp) AS p1, max(a1 - a0) AS hi, min(a1 - a0) AS lo, median(gap) AS mid, stddev_pop(gap) AS sd FROM t3 GROUP BY plan_id, orient, flight)
SELECT plan_id, orient, flight, treads, a0, a1, p0, p1 FROM f WHERE treads >= 3 AND hi <= 1.8 * greatest(lo, 1e-6) AND greatest(a1 - a0, p1 - p0) <= 220 AND mid > 0 AND sd <= 0.5 * mid + 1e-9""",
    "text_blocks": """WITH w AS (SELECT conv_id, turn, generate_subscripts(string_split(text, ' '), 1) - 1 AS i, unnest(string_split(text, ' ')) AS t FROM conversations),
d AS (SELECT conv_id, turn, i, t, i * 60 + (length(t) * 13) % 90 AS l, 10 + length(t) % 3 AS top, length(t) * 6 AS w, 8 + length(t) % 5 AS h, (length(t) * 7) % 120 - 10 AS conf FROM w WHERE trim(t) <> ''),
s AS (SELECT *, l - lag(l + w) OVER (PARTITION BY conv_id, turn ORDER BY l, i) AS space, greatest(50.0::DOUBLE, 2.5 * median(h) OVER (PARTITION BY conv_id, turn)) AS cutoff FROM d),
b AS (SELECT *, CAST(sum(CASE WHEN space > cutoff THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY l, i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM s)
SELECT conv_id, turn, block, string_agg(trim(t), ' ' ORDER BY l, i) AS text, min(l) AS min_x, min(top) AS min_y, max(l + w) AS max_x, max(top + h) AS max_y, round(coalesce(avg(conf) FILTER (conf >= 0) / 100, 0.5::DOUBLE), 9) AS confidence,
(min(l) + max(l + w)) / 2 AS cx, (min(top) + max(top + h)) / 2 AS cy FROM b GROUP BY conv_id, turn, block""",
    "dimension_parse": f"SELECT id, {_VALUE} AS value FROM ({LABELS})",
    "room_type_classify": f"SELECT id, CASE WHEN {_VALUE} IS NOT NULL THEN 'dimension' WHEN {_TYPE} IS NOT NULL THEN 'room_label' ELSE 'other' END AS kind, {_TYPE} AS room_type FROM ({LABELS})",
    "label_in_room": f"SELECT r.plan_id, r.room_id, arg_min(p.label, p.ord) AS label FROM ({ROOMS}) r LEFT JOIN ({POINTS}) p ON p.plan_id = r.plan_id AND p.x > x0 AND p.x < x0 + 60 AND p.y > y0 AND p.y < y0 + 40 GROUP BY ALL",
    "room_measures": f"SELECT room_id, (x1 - x0) * (y1 - y0) AS area, 2 * (x1 - x0 + y1 - y0) AS perimeter FROM ({PART_ROOMS})",
    "nearest_line": f"""WITH t AS ({POINTS}), l AS (SELECT plan_id, room_id AS line_id, x0 AS x1, y0 AS y1, x0 + 80 AS x2, y0 + room_id % 7 AS y2 FROM ({ROOMS})),
m AS (SELECT t.plan_id, t.ord, l.*, row_number() OVER (PARTITION BY t.plan_id, t.ord ORDER BY pow((x1 + x2) / 2 - x, 2) + pow((y1 + y2) / 2 - y, 2), line_id) AS nth FROM t JOIN l ON l.plan_id = t.plan_id AND pow((x1 + x2) / 2 - x, 2) + pow((y1 + y2) / 2 - y, 2) < 1600)
SELECT t.plan_id, t.ord, line_id, coalesce(x1, x - greatest(10, width / 2)) AS x1, coalesce(y1, y) AS y1, coalesce(x2, x + greatest(10, width / 2)) AS x2, coalesce(y2, y) AS y2,
round(confidence * CASE WHEN line_id IS NULL THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END, 3) AS confidence, line_id IS NOT NULL AS matched FROM t LEFT JOIN m ON m.plan_id = t.plan_id AND m.ord = t.ord AND m.nth = 1""",
    "calibration": f"""WITH {_W}, d AS (SELECT plan_id, median(pixels / value) AS m FROM ({DIMENSIONS}) WHERE matched AND value > 0 GROUP BY plan_id), x AS (SELECT plan_id, max(e - s) AS w FROM walls WHERE exterior GROUP BY plan_id)
SELECT p_partkey AS plan_id, coalesce(m, CASE WHEN w > 0 THEN w / 30 END, 1.0::DOUBLE) AS pixels_per_unit, CASE WHEN m IS NOT NULL THEN 'ocr_dimension_match' WHEN w > 0 THEN 'longest_wall_fallback' ELSE 'uncalibrated' END AS source
FROM part LEFT JOIN d ON d.plan_id = p_partkey LEFT JOIN x ON x.plan_id = p_partkey""",
    "room_boundary": f"WITH {_W}, {_EDGES} SELECT * FROM bound",
    "room_confidence": f"WITH {_W}, {_EDGES}, c AS (SELECT plan_id, room_id, floor((2 * sum(CAST(round(confidence * 1000) AS BIGINT)) + count(*)) / (2 * count(*))) / 1000 AS c FROM bound JOIN walls USING (plan_id, wall_id) GROUP BY ALL) SELECT plan_id, room_id, coalesce(c, 0.7::DOUBLE) AS confidence FROM room LEFT JOIN c USING (plan_id, room_id)",
    "duplicate_ids": "WITH u AS (SELECT o_custkey AS plan_id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 6 ELSE o_orderkey % 9 END AS VARCHAR) AS id, o_orderkey % 2 AS collection, o_orderkey AS ord FROM orders) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, id ORDER BY collection, ord) AS nth FROM u) WHERE nth > 1",
    "dangling_refs": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "project_page": "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 20",
    "project_patch": "SELECT c_custkey AS id, CASE WHEN c_custkey % 14 = 0 THEN 'renamed' ELSE c_name END AS name, CASE WHEN c_custkey % 21 = 0 THEN 'changed' ELSE c_mktsegment END AS description FROM customer WHERE c_custkey % 11 <> 0",
    "doc_roundtrip": f"SELECT project_id, id, confidence, thickness FROM ({ELEMENTS})",
    "doc_summary": "SELECT CAST(o_orderkey AS VARCHAR) AS project_id, 0::BIGINT AS rooms, count(l_orderkey) AS walls, 0::BIGINT AS doors, 0::BIGINT AS windows, 0::BIGINT AS stairs, 0::BIGINT AS dimensions FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "range_rules": f"""WITH e AS (SELECT project_id, count(*) FILTER (NOT confidence BETWEEN 0 AND 1) + count(*) FILTER (thickness <= 0) AS bad, count(*) - count(DISTINCT id) AS again FROM ({ELEMENTS}) GROUP BY project_id),
p AS (SELECT project_id, CASE WHEN units = 'cubits' THEN 1 ELSE 0 END + coalesce(bad, 0) AS bad, coalesce(again, 0) AS again FROM ({PROJECTS}) LEFT JOIN e USING (project_id))
SELECT project_id, bad + again = 0 AS is_valid, CAST(CASE WHEN bad > 0 THEN bad ELSE again END AS BIGINT) AS n_errors FROM p""",
}.items()}

_SEEN = "SELECT plan_id, orient, perp, a0, a1, thickness FROM ori WHERE orient IS NOT NULL AND src = "
_HALF_UP = "CAST(round(CAST(CAST({} AS VARCHAR) AS DECIMAL(38, 18)), 3) AS DOUBLE)"  # of the decimal that is shown
_UNIT = lambda c: _HALF_UP.replace("{}", f"({c}) / ppu")
_THICK_W = _O.replace(SEGMENTS, _SEEN + "'wall'").replace("AS votes FROM r GROUP BY ALL", "AS votes, avg(thickness) AS thickness FROM r GROUP BY ALL HAVING avg(thickness) >= 2.5")
_THICK_W = _THICK_W.replace(LEAVES, "SELECT plan_id, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my FROM ori WHERE orient IS NULL AND src = 'detail'").replace("round(least(1.0::DOUBLE, greatest(", "(least(1.0::DOUBLE, greatest(").replace("(e - s))), 9) AS position", "(e - s)))) AS position")
_ALONG = "CASE WHEN orient = 'h' THEN {} ELSE {} END"
_ENDS = [_ALONG.format(h, v) for h, v in (("s", "fixed"), ("fixed", "s"), ("e", "fixed"), ("fixed", "e"))]
_BOX = [_ALONG.format(h, v) for h, v in (("a0", "p0"), ("p0", "a0"), ("a1", "p1"), ("p1", "a1"))]
_ROW = lambda kind, n, conf, what, v, rest: f"SELECT plan_id, '{kind}' AS kind, {n} AS id, {conf} AS confidence, {what} AS what, " + ", ".join(f"{x} AS v{k}" for k, x in enumerate([*v, *["NULL::DOUBLE"] * (5 - len(v))], 1)) + f" FROM {rest}"
_NTH = lambda prefix, order: f"'{prefix}-' || row_number() OVER (PARTITION BY plan_id ORDER BY {order})"
_STAIRS = ORACLES["stair_clusters"].replace(duck(SEGMENTS), _SEEN + "'detail'")
_PARTS = " UNION ALL ".join([
    _ROW("room", _NTH("room", "room_id"), "coalesce(c, 0.7::DOUBLE)", f"concat_ws('/', coalesce(label, 'Unnamed Room'), {_TYPE})", [_UNIT(c) for c in ("x0", "y0", "x1", "y1")], "room LEFT JOIN rc USING (plan_id, room_id) LEFT JOIN named USING (plan_id, room_id) JOIN scale USING (plan_id)"),
    _ROW("wall", "wall_id", "confidence", "CASE WHEN exterior THEN 'exterior' ELSE 'interior' END", [_UNIT(c) for c in (*_ENDS, "thickness")], "wt JOIN scale USING (plan_id)"),
    _ROW("door", _NTH("door", "wall_id, position"), "confidence", "concat_ws(' ', wall_id, CASE WHEN swing THEN 'left' END)", [_HALF_UP.replace("{}", "position"), _UNIT("width")], "kept JOIN scale USING (plan_id) WHERE kind = 'door'"),
    _ROW("window", _NTH("window", "wall_id, position"), "confidence", "wall_id", [_HALF_UP.replace("{}", "position"), _UNIT("width")], "kept JOIN scale USING (plan_id) WHERE kind = 'window'"),
    _ROW("stair", _NTH("stair", "orient, flight"), "0.5::DOUBLE", "NULL", [_UNIT(c) for c in _BOX], "stair JOIN scale USING (plan_id)"),
    _ROW("dimension", _NTH("dim", "y1, x1, label, ord"), "confidence", "label", [*[_UNIT(c) for c in ("x1", "y1", "x2", "y2")], "value"], "dim JOIN scale USING (plan_id)"),
    _ROW("document", "CASE WHEN how = 1 THEN 'ocr_dimension_match' ELSE 'fallback_default_assumption' END", "NULL::DOUBLE", "nullif(concat_ws(' ', CASE how WHEN 2 THEN 'No dimension text matched; scale estimated from the longest exterior wall.' WHEN 3 THEN 'Scale is uncalibrated: coordinates are pixels.' END, "
         f"CASE WHEN width < 800 OR height < 800 THEN '{detection.LOW_RESOLUTION}' END), '')", [], "plan JOIN scale USING (plan_id)"),
])
ORACLES["detect_document"] = duck(f"""WITH RECURSIVE plan AS ({DRAWINGS}), drawn AS (SELECT *, degrees(atan2(y2 - y1, x2 - x1)) AS d FROM ({DRAWN})), tilt AS (SELECT *, CASE WHEN d < 0 THEN d + 180 WHEN d >= 180 THEN d - 180 ELSE d END AS m FROM drawn),
way AS (SELECT *, CASE WHEN m <= 10 OR m >= 170 THEN 'h' WHEN m BETWEEN 80 AND 100 THEN 'v' END AS orient FROM tilt),
ori AS MATERIALIZED (SELECT *, CASE orient WHEN 'h' THEN (y1 + y2) / 2 ELSE (x1 + x2) / 2 END AS perp, CASE orient WHEN 'h' THEN least(x1, x2) ELSE least(y1, y2) END AS a0, CASE orient WHEN 'h' THEN greatest(x1, x2) ELSE greatest(y1, y2) END AS a1 FROM way),
{_THICK_W},
wt AS MATERIALIZED (SELECT walls.* EXCLUDE (wall_id), thickness, {_NTH("wall", "orient, fixed, walls.s")} AS wall_id FROM walls JOIN runs USING (plan_id, orient, grp, run)),
lines AS (SELECT plan_id, {_NTH("line", "orient, fixed, s")} AS line_id, {", ".join(f"{c} AS {n}" for c, n in zip(_ENDS, ("x1", "y1", "x2", "y2"), strict=True))} FROM (SELECT plan_id, orient, grp, run, min(a0) AS s, max(a1) AS e FROM r GROUP BY ALL HAVING avg(thickness) < 2.5) JOIN fx USING (plan_id, orient, grp)),
op AS MATERIALIZED (SELECT opening.*, wt.wall_id, row_number() OVER (PARTITION BY plan_id, wall_id ORDER BY position, swing) AS i FROM opening JOIN wt USING (plan_id, orient, grp, run)),
fold AS (SELECT plan_id, wall_id, i, 1 AS slot, position, swing FROM op WHERE i = 1 UNION ALL
  SELECT o.plan_id, o.wall_id, o.i, f.slot + CASE WHEN abs(o.position - f.position) < 0.05 THEN 0 ELSE 1 END, CASE WHEN abs(o.position - f.position) < 0.05 AND (f.swing OR NOT o.swing) THEN f.position ELSE o.position END,
  CASE WHEN abs(o.position - f.position) < 0.05 AND (f.swing OR NOT o.swing) THEN f.swing ELSE o.swing END FROM fold f JOIN op o ON o.plan_id = f.plan_id AND o.wall_id = f.wall_id AND o.i = f.i + 1),
stay AS (SELECT plan_id, wall_id, arg_max(position, i) AS position, arg_max(swing, i) AS swing FROM fold GROUP BY plan_id, wall_id, slot),
kept AS (SELECT * FROM op SEMI JOIN stay USING (plan_id, wall_id, position, swing)),
stair AS ({_STAIRS}),
told AS (SELECT plan_id, ord, label, cx, cy, max_x - min_x AS wide, confidence, {_VALUE} AS value, {_TYPE} AS type FROM (SELECT * RENAME (text AS label) FROM ({WRITTEN}))),
span AS (SELECT * FROM told WHERE value IS NOT NULL),
beside AS (SELECT t.plan_id, t.ord, l.line_id, x1, y1, x2, y2, row_number() OVER (PARTITION BY t.plan_id, t.ord ORDER BY pow((x1 + x2) / 2 - cx, 2) + pow((y1 + y2) / 2 - cy, 2), line_id) AS nth FROM span t JOIN lines l ON l.plan_id = t.plan_id AND pow((x1 + x2) / 2 - cx, 2) + pow((y1 + y2) / 2 - cy, 2) < 1600),
dim AS MATERIALIZED (SELECT t.plan_id, t.ord, t.label, t.value, line_id, coalesce(x1, cx - greatest(10, wide / 2)) AS x1, coalesce(y1, cy) AS y1, coalesce(x2, cx + greatest(10, wide / 2)) AS x2, coalesce(y2, cy) AS y2,
  {_HALF_UP.replace("{}", "confidence * CASE WHEN line_id IS NULL THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END")} AS confidence FROM span t LEFT JOIN beside b ON b.plan_id = t.plan_id AND b.ord = t.ord AND b.nth = 1),
scale AS MATERIALIZED (SELECT plan_id, coalesce(q, CASE WHEN w > 0 THEN w / 30 END, 1.0::DOUBLE) AS ppu, CASE WHEN q IS NOT NULL THEN 1 WHEN w > 0 THEN 2 ELSE 3 END AS how FROM (SELECT plan_id FROM plan)
  LEFT JOIN (SELECT plan_id, median(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / value) AS q FROM dim WHERE line_id IS NOT NULL AND value > 0 GROUP BY plan_id) USING (plan_id) LEFT JOIN (SELECT plan_id, max(e - s) AS w FROM wt WHERE exterior GROUP BY plan_id) USING (plan_id)),
{_EDGES.replace("JOIN walls w", "JOIN wt w")},
rc AS (SELECT plan_id, room_id, floor((2 * sum(CAST(round(confidence * 1000) AS BIGINT)) + count(*)) / (2 * count(*))) / 1000 AS c FROM bound JOIN wt USING (plan_id, wall_id) GROUP BY ALL),
named AS (SELECT r.plan_id, room_id, arg_min(label, ord) AS label FROM room r JOIN told t ON t.plan_id = r.plan_id AND value IS NULL AND type IS NOT NULL AND cx > x0 AND cx < x1 AND cy > y0 AND cy < y1 GROUP BY ALL)
SELECT CAST(plan_id AS VARCHAR) AS project_id, kind, id, confidence, what, v1, v2, v3, v4, v5 FROM ({_PARTS})""")
