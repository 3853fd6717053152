"""Detection as a stream: batches of segments arrive as Parquet files; each plan's walls are written when its file is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.segments import wall_runs

SEGMENTS = "plan_id bigint, orient string, perp double, a0 double, a1 double"


def wall_stream(spark: SparkSession, source: str, sink: str, checkpoint: str):
    """Starts the stream; a file holds whole plans.  A batch that is run again replaces its own folder, so every plan counts once."""

    def write(batch: DataFrame, number: int):
        wall_runs(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return spark.readStream.schema(SEGMENTS).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
