"""Reading and writing plan documents and uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
BASE = "id:string,confidence:double,source:string,metadata:map<string,string>"
ELEMENTS = {
    "rooms": f"array<struct<{BASE},name:string,polygon:array<{POINT}>,room_type:string>>",
    "walls": f"array<struct<{BASE},start:{POINT},`end`:{POINT},thickness:double,height:double,wall_type:string>>",
    "doors": f"array<struct<{BASE},wall_id:string,position:double,width:double,height:double,swing:string>>",
    "windows": f"array<struct<{BASE},wall_id:string,position:double,width:double,height:double,sill_height:double>>",
    "stairs": f"array<struct<{BASE},polygon:array<{POINT}>,step_count:int,direction:string>>",
    "dimensions": f"array<struct<{BASE},start:{POINT},`end`:{POINT},value:double,label:string>>",
    "furniture": f"array<struct<{BASE},furniture_type:string,position:{POINT},rotation:double,width:double,depth:double,height:double,room_id:string>>",
}
METADATA = "struct<building_name:string,detection_version:string,source_image_reference:string,notes:string,extra:map<string,string>>"
DDL = ", ".join(["project_id string", "units string", *(f"{k} {t}" for k, t in ELEMENTS.items()), f"metadata {METADATA}"])
UPLOADS = (".png", ".jpg", ".jpeg", ".pdf")
MOST_BYTES = 15 * 1024 * 1024


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Plan documents as JSON, one a file, always by the declared schema."""
    return spark.read.schema(DDL).option("multiLine", True).json(path)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files with the reason to refuse them, if any: (path, length, modificationTime, error_code); contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    suffix = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    return files.withColumn("error_code", F.when(~suffix.isin(*UPLOADS), 415).when(F.col("length") > MOST_BYTES, 413))


def asked(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Each row of ``paths`` (path) with what ``uploads`` tells of its file; error_code 404 where there is no such file.

    A path matches with and without the scheme of local files; repeated paths are answered as often as asked."""
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    held = files.select(bare("path").alias("_path"), "modificationTime", "length", "error_code")
    met = paths.select("path").join(held, bare("path") == F.col("_path"), "left")
    return met.select("path", "modificationTime", "length", F.when(F.col("_path").isNull(), 404).otherwise(F.col("error_code")).alias("error_code"))
