"""Cutting lineage between rounds of an iterative operator or steps of a long one."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder of ``spark.checkpoint.dir`` and read from there, so lost executors cost no round twice.

    Only where none is set and all runs on this machine (tests, local runs) a folder is made."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="planwright-"))
    return df.checkpoint()


# Adaptive execution forgets how rows were dealt out; joins ask for all their columns by default.
IN_PLACE = {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def cut_in_place(df: DataFrame) -> DataFrame:
    """``cut`` for rows dealt out by a key (``spread``): they stay as dealt, so later windows, aggregates and joins by that key, or by it and more columns, move no rows.

    What the step shuffled goes from the disks once its rows are written.  ``df`` is planned anew, and the session's settings are as before afterwards."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in IN_PLACE}
    try:
        for k, v in IN_PLACE.items():
            conf.set(k, v)
        return cut(df.select("*"))
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def drop(*frames: DataFrame) -> None:
    """Deletes what ``cut`` wrote of ``frames`` once nothing is to read it any more; rows that came from elsewhere stay."""
    for df in frames:
        sc, plan = df.sparkSession.sparkContext, df._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() == "LogicalRDD" and plan.rdd().getCheckpointFile().isDefined():
            path = sc._jvm.org.apache.hadoop.fs.Path(plan.rdd().getCheckpointFile().get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
