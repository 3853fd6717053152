"""Uploads: drawings stored under names from their content, refused ones told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans import MOST_BYTES, UPLOADS


def sorted_out(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (project_id, filename, content) that may be stored, with their name, and the others with error_code.

    415: no filename, or an ending that is not in UPLOADS; 413: more than MOST_BYTES.  A stored name is the SHA-256
    of the content with the file's ending, so equal contents of a project are one file.  Null content is no bytes."""
    suffix = F.lower(F.regexp_extract(F.coalesce("filename", F.lit("")), r"\.[^./]+$", 0))
    content = F.coalesce("content", F.lit(b""))
    code = F.when(~suffix.isin(*UPLOADS), 415).when(F.length(content) > MOST_BYTES, 413)
    told = files.withColumn("error_code", code)
    good = told.where("error_code is null").select("project_id", F.concat(F.sha2(content, 256), suffix).alias("name"), content.alias("content"))
    return good, told.where("error_code is not null").select("project_id", "filename", F.length(content).alias("length"), "error_code")


def save(files: DataFrame, folder: str) -> DataFrame:
    """Stores what may be stored under ``folder``/project_id=.../name=..., and gives back the rest with error_code.

    Each name is a partition of its own that is overwritten alone, so a rerun, or a part of it, leaves the same files
    and nothing else of a project is touched."""
    good, refused = sorted_out(files)
    # Of equal contents of a project one row stays; the shuffle is of the files that may be stored.
    one = good.dropDuplicates(["project_id", "name"])
    one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id", "name").parquet(folder)
    return refused
