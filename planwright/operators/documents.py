"""Plan documents: assembled from element rows, taken apart again, summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.plans import DDL, ELEMENTS
from .validation import COLLECTIONS


def assemble(projects: DataFrame, elements: dict[str, DataFrame], key: str = "project_id") -> DataFrame:
    """One document a project (``key``, units); ``elements[kind]`` has ``key``, ord and a struct ``element``.

    Elements of a kind stand in order of ord; kinds without rows are empty arrays.  Joins are by sorting, as projects
    are as many as documents, of whose number and width their file tells little."""
    out = projects.select(key, "units")
    for kind in COLLECTIONS:
        none = F.array().cast(ELEMENTS[kind])
        if kind in elements:
            got = elements[kind].groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "element")), lambda a, b: (a["ord"] - b["ord"]).cast("int")), lambda x: x["element"]).alias(kind))
            out = out.join(got.hint("merge"), key, "left").withColumn(kind, F.coalesce(F.col(kind).cast(ELEMENTS[kind]), none))
        else:
            out = out.withColumn(kind, none)
    return out


def as_json(documents: DataFrame) -> DataFrame:
    return documents.select("project_id", F.to_json(F.struct(*documents.columns)).alias("floorplan_data"))


def from_json(rows: DataFrame) -> DataFrame:
    """Documents from their JSON, by the declared schema; broken text gives nulls."""
    return rows.select(F.from_json("floorplan_data", DDL).alias("d")).select("d.*")


def elements(documents: DataFrame, kind: str) -> DataFrame:
    return documents.select("project_id", F.posexplode(kind).alias("ord", "e")).select("project_id", "ord", "e.*")


def summary(documents: DataFrame, told: bool = False) -> DataFrame:
    """Numbers of elements; with ``told`` also where the scale comes from and the notes."""
    counted = ("rooms", "walls", "doors", "windows", "stairs", "dimensions")
    return documents.select("project_id", *[F.coalesce(F.size(k), F.lit(0)).cast("long").alias(k) for k in counted], *([F.col("metadata.extra")["calibration_source"].alias("calibration_source"), F.col("metadata.notes").alias("notes")] if told else []))
