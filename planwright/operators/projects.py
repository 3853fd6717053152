"""The table of projects: page, change, remove, document and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .documents import as_json
from .validation import validate


def page(projects: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first, ties by id; limit 1 to 500, offset from 0."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be in 1..500 and offset 0 or more")
    return projects.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def patch(projects: DataFrame, changes: DataFrame, columns: list[str], now=None) -> DataFrame:
    """Non-null fields of ``changes`` overwrite, so none can be set back to null; updated_at follows."""
    c = changes.select(F.col("id").alias("_id"), *[F.col(x).alias(f"_{x}") for x in columns])
    touched = F.col("_id").isNotNull()
    out = projects.join(c, F.col("id") == F.col("_id"), "left")
    new = {x: F.coalesce(F.col(f"_{x}"), F.col(x)) for x in columns}
    if "updated_at" in projects.columns:
        new["updated_at"] = F.when(touched, F.current_timestamp() if now is None else F.lit(now)).otherwise(F.col("updated_at"))
    return out.withColumns(new).select(*projects.columns)


def remove(projects: DataFrame, ids: DataFrame) -> DataFrame:
    return projects.join(ids.select("id"), "id", "left_anti").select(*projects.columns)


def save_documents(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """Projects with the document and status of a run: (id, floorplan_data, error).

    A failed run keeps the document before it; a good one clears the error."""
    d = documents.select(F.col("id").alias("_id"), F.col("floorplan_data").alias("_d"), F.col("error").alias("_e"))
    out = projects.join(d, F.col("id") == F.col("_id"), "left")
    ran = F.col("_id").isNotNull()
    return out.withColumns({
        "floorplan_data": F.when(ran & F.col("_e").isNull(), F.col("_d")).otherwise(F.col("floorplan_data")),
        "detection_status": F.when(ran, F.when(F.col("_e").isNull(), "complete").otherwise("failed")).otherwise(F.col("detection_status")),
        "detection_error": F.when(ran, F.col("_e")).otherwise(F.col("detection_error")),
    }).select(*projects.columns)


def name_errors(name: Column, description: Column) -> Column:
    """What is wrong with a new project: names have 1 to 200 characters, descriptions at most 2000."""
    long = F.coalesce(F.length(description) > 2000, F.lit(False))
    return F.array_compact(F.array(F.when(~F.coalesce(F.length(name).between(1, 200), F.lit(False)), "name"), F.when(long, "description")))


def insert(projects: DataFrame, new: DataFrame, now=None) -> tuple[DataFrame, DataFrame]:
    """The table with the rows of ``new`` (id, name, description) that may be added, and the others with their errors."""
    rows = new.withColumn("errors", name_errors(F.col("name"), F.col("description")))
    at = F.current_timestamp() if now is None else F.lit(now)
    made = {"status": F.lit("created"), "detection_status": F.lit("not_started"), "created_at": at, "updated_at": at, "id": F.col("id"), "name": F.col("name"), "description": F.col("description")}
    good = rows.where(F.size("errors") == 0)
    own = [made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in projects.schema.fields]
    return projects.unionByName(good.select(*own)), rows.where(F.size("errors") > 0)


def get(projects: DataFrame, ids: DataFrame) -> DataFrame:
    """Each asked id with its project; error_code 404 where there is none, 409 where it has no document."""
    asked = ids.select(F.col("id").alias("_id"))
    out = asked.join(projects, F.col("id") == F.col("_id"), "left")
    code = F.when(F.col("id").isNull(), 404).when(F.col("floorplan_data").isNull(), 409)
    return out.withColumn("error_code", code).withColumn("id", F.col("_id")).drop("_id")


def start(projects: DataFrame, ids: DataFrame) -> DataFrame:
    """Projects whose detection begins: status processing, no error."""
    asked = ids.select(F.col("id").alias("_id")).distinct()
    runs = F.col("_id").isNotNull()
    out = projects.join(asked, F.col("id") == F.col("_id"), "left")
    return out.withColumns({"detection_status": F.when(runs, "processing").otherwise(F.col("detection_status")), "detection_error": F.when(~runs, F.col("detection_error"))}).select(*projects.columns)


def save_valid(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """``save_documents`` of plan documents by their project_id: those that break a rule are never written and fail with their errors."""
    told = validate(documents).select(F.col("project_id").alias("_p"), "is_valid", F.array_join("errors", "; ").alias("e"))
    rows = as_json(documents).join(told, F.col("project_id") == F.col("_p"))
    return save_documents(projects, rows.select(F.col("project_id").alias("id"), F.when(F.col("is_valid"), F.col("floorplan_data")).alias("floorplan_data"), F.when(~F.col("is_valid"), F.col("e")).alias("error")))


def unknown(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, error_code): 404 for each project_id of ``documents`` that is in no project; ``save_valid`` writes none of them."""
    ids = documents.select(F.col("project_id").alias("id")).distinct()
    return ids.join(projects.select(F.col("id").alias("_p")), F.col("id").eqNullSafe(F.col("_p")), "left_anti").select("id", F.lit(404).alias("error_code"))
