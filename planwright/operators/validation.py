"""Rules of plan documents: fields first, then structure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.plans import ELEMENTS

UNITS = ("feet", "meters", "inches", "centimeters")
SOURCES = ("ai_detection", "manual_correction")
COLLECTIONS = ("rooms", "walls", "doors", "windows", "stairs", "dimensions", "furniture")


def positive_or_null(c: Column) -> Column:
    return c.isNull() | (c > 0)


def failing(rules: dict[str, Column]) -> Column:
    """The names of the rules that do not hold, in order; a null counts as not holding."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def element_rules(kind: str) -> dict[str, callable]:
    base = {
        "id": lambda e: F.length(e["id"]) >= 1,
        "confidence": lambda e: e["confidence"].isNull() | e["confidence"].between(0, 1),
        "source": lambda e: F.coalesce(e["source"], F.lit("manual_correction")).isin(*SOURCES),
    }
    opening = {"wall_id": lambda e: F.length(e["wall_id"]) >= 1, "position": lambda e: e["position"].between(0, 1), "width": lambda e: e["width"] > 0, "height": lambda e: positive_or_null(e["height"])}
    own = {
        "rooms": {"name": lambda e: F.length(e["name"]) >= 1, "polygon": lambda e: F.size(e["polygon"]) >= 3},
        "walls": {"start": lambda e: e["start"].isNotNull(), "end": lambda e: e["end"].isNotNull(), "thickness": lambda e: positive_or_null(e["thickness"]), "height": lambda e: positive_or_null(e["height"]), "wall_type": lambda e: F.coalesce(e["wall_type"], F.lit("interior")).isin("exterior", "interior")},
        "doors": opening | {"swing": lambda e: e["swing"].isNull() | e["swing"].isin("left", "right", "sliding", "none")},
        "windows": opening | {"sill_height": lambda e: e["sill_height"].isNull() | (e["sill_height"] >= 0)},
        "stairs": {"polygon": lambda e: F.size(e["polygon"]) >= 3, "step_count": lambda e: positive_or_null(e["step_count"])},
        "dimensions": {"start": lambda e: e["start"].isNotNull(), "end": lambda e: e["end"].isNotNull(), "value": lambda e: e["value"] > 0},
        "furniture": {"furniture_type": lambda e: F.length(e["furniture_type"]) >= 1, "position": lambda e: e["position"].isNotNull(), "width": lambda e: positive_or_null(e["width"]), "depth": lambda e: positive_or_null(e["depth"]), "height": lambda e: positive_or_null(e["height"])},
    }
    return base | own[kind]


def field_errors() -> Column:
    head = failing({"project_id: blank": F.length(F.trim("project_id")) > 0, "units: unknown": F.coalesce("units", F.lit("feet")).isin(*UNITS)})
    parts = [head]
    for kind in COLLECTIONS:
        parts.append(F.flatten(F.transform(F.coalesce(F.col(kind), F.array().cast(ELEMENTS[kind])), _element_errors(kind))))
    return F.concat(*parts)


def _element_errors(kind: str):
    rules = element_rules(kind)

    def errors(e, i):
        return F.transform(failing({name: f(e) for name, f in rules.items()}), lambda n: F.concat(F.lit(f"{kind}."), i.cast("string"), F.lit("."), n, F.lit(": invalid")))

    return errors


def structural_errors() -> Column:
    """Repeated ids (each occurrence after the first, in the order of collections) and references to nothing.

    Sets (hashed, so linear in a document) tell whether an id repeats and which references lead nowhere; only
    documents with such errors look for their places, among the ids or references in question."""
    ids = lambda kind: F.transform(F.coalesce(F.col(kind), F.array().cast(ELEMENTS[kind])), lambda e: F.struct(e["id"].alias("id"), F.lit(kind).alias("kind")))
    every = F.concat(*[ids(k) for k in COLLECTIONS])
    names = F.transform(every, lambda x: x["id"])
    again = F.filter(F.transform(every, lambda x, i: F.when(F.array_position(names, x["id"]) <= i, F.concat(F.lit("Duplicate element id '"), x["id"], F.lit("' found in '"), x["kind"], F.lit("'.")))), lambda s: s.isNotNull())
    again = F.when(F.size(F.array_distinct(names)) < F.size(names), again).otherwise(F.array().cast("array<string>"))

    def dangling(kind, label, ref, to):
        known = F.transform(F.coalesce(F.col(to), F.array().cast(ELEMENTS[to])), lambda e: e["id"])
        own = F.coalesce(F.col(kind), F.array().cast(ELEMENTS[kind]))
        unknown = F.array_compact(F.array_except(F.transform(own, lambda e: e[ref]), known))
        bad = F.when(F.size(unknown) > 0, F.filter(own, lambda e: F.array_contains(unknown, e[ref]))).otherwise(F.array().cast(ELEMENTS[kind]))
        return F.transform(bad, lambda e: F.concat(F.lit(f"{label} '"), e["id"], F.lit(f"' references unknown {ref} '"), e[ref], F.lit("'.")))

    return F.concat(again, dangling("doors", "Door", "wall_id", "walls"), dangling("windows", "Window", "wall_id", "walls"), dangling("furniture", "Furniture", "room_id", "rooms"))


def validate(documents: DataFrame) -> DataFrame:
    """(project_id, is_valid, errors); structure is looked at only where all fields hold."""
    out = documents.withColumn("_f", field_errors())
    errors = F.when(F.size("_f") > 0, F.col("_f")).otherwise(structural_errors())
    return out.select("project_id", errors.alias("errors")).withColumn("is_valid", F.size("errors") == 0)


def duplicate_ids(*collections: DataFrame) -> DataFrame:
    """(plan_id, id, collection, ord) of every occurrence of an id after its first; collections have plan_id, id, collection, ord."""
    rows = reduce(DataFrame.unionByName, collections)
    place = F.array_position(F.array(*[F.lit(c) for c in COLLECTIONS]), F.col("collection").cast("string"))  # 0 where unknown
    w = Window.partitionBy("plan_id", "id").orderBy(place, "collection", "ord")
    return rows.withColumn("nth", F.row_number().over(w)).where("nth > 1")


def dangling(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose reference is set and leads nowhere."""
    return rows.where(F.col(key).isNotNull()).join(known.select(F.col(known_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
