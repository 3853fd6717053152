"""Detection as a stream with the status of each project: processing, then complete or failed.

Segments arrive in files; a plan may be split over any number of them.  A micro-batch keeps its segments in a folder
of its number and runs detection anew for the plans that it touches, on all of their segments so far.  Changes of
status are a log, one folder a batch and step: a batch that is run again overwrites its own folders and reads only
those of batches before it, so every change counts once.  The table of projects is the log's last change of each
project over the rows before the stream; nothing that did not change is written again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.projects import save_documents

PROCESSING, DONE = 0, 1
CHANGES = "id string, floorplan_data string, error string"
LOG = f"{CHANGES}, batch bigint, step int"


def _log(spark: SparkSession, sink: str) -> DataFrame:
    """The log so far; before its first change there is no folder to read."""
    try:
        return spark.read.schema(LOG).parquet(f"{sink}/changes")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def status_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str, detect: Callable[[DataFrame], DataFrame]):
    """Starts the stream over the files of segments in ``source`` (``schema`` holds plan_id).

    ``detect`` turns all segments of some plans into (id, floorplan_data, error), one row a plan; a plan for which it
    gives none has failed, and so have all plans of a batch where it raises."""

    def run(batch: DataFrame, number: int):
        session = batch.sparkSession
        change = lambda df, step: df.select(F.col("id").cast("string").alias("id"), F.col("floorplan_data").cast("string").alias("floorplan_data"), F.col("error").cast("string").alias("error")).write.mode("overwrite").parquet(f"{sink}/changes/batch={number}/step={step}")
        batch.write.mode("overwrite").parquet(f"{sink}/segments/batch={number}")
        every = session.read.schema(f"{schema}, batch bigint").parquet(f"{sink}/segments")
        touched = every.where(F.col("batch") == number).select("plan_id").distinct()
        ids = touched.select(F.col("plan_id").cast("string").alias("id"))
        nothing = lambda text: ids.select("id", F.lit(None).alias("floorplan_data"), F.lit(text).alias("error"))
        change(nothing(None), PROCESSING)
        mine = every.where(F.col("batch") <= number).join(touched, "plan_id", "left_semi").drop("batch")
        try:
            found = detect(mine).select(F.col("id").cast("string").alias("i"), "floorplan_data", F.col("error").alias("e"))
            told = F.when(F.col("floorplan_data").isNull(), F.coalesce("e", F.lit("detection gave no document"))).otherwise(F.col("e"))
            change(ids.join(found, F.col("id") == F.col("i"), "left").select("id", "floorplan_data", told.alias("error")), DONE)
        except Exception as failure:  # whatever fails is the outcome of the run, not of the stream
            change(nothing(str(failure).split("\n")[0][:500] or type(failure).__name__), DONE)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def projects_now(projects: DataFrame, sink: str) -> DataFrame:
    """``projects`` with the changes of the stream: the last good document of each, and the status and error of its last run.

    Changes of unknown projects are left out."""
    log = _log(projects.sparkSession, sink)
    place = F.struct("batch", "step")
    ended = log.where(F.col("step") == DONE)
    last = log.groupBy("id").agg(F.max_by(F.struct("step", "error"), place).alias("last"))
    good = ended.where("error is null").groupBy("id").agg(F.max_by("floorplan_data", place).alias("document"))
    # The last good document first, then the outcome of the last run, which keeps it where it failed.
    kept = save_documents(projects, good.select("id", F.col("document").alias("floorplan_data"), F.lit(None).cast("string").alias("error")))
    done = last.where(F.col("last.step") == DONE).join(good, "id", "left").select("id", F.col("document").alias("floorplan_data"), F.col("last.error").alias("error"))
    kept = save_documents(kept, done)
    running = last.where(F.col("last.step") == PROCESSING).select(F.col("id").alias("_r"))
    runs = F.col("_r").isNotNull()
    out = kept.join(running, F.col("id") == F.col("_r"), "left")
    return out.withColumns({"detection_status": F.when(runs, "processing").otherwise(F.col("detection_status")), "detection_error": F.when(~runs, F.col("detection_error"))}).select(*projects.columns)
