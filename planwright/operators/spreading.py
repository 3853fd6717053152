"""Rows dealt out by key before work that needs much more memory than they take on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` over ``spark.sql.shuffle.partitions`` partitions, which adaptive execution leaves as they are.

    It merges partitions by their compressed bytes otherwise; plans of small numbers take 30 times as many bytes in a
    sort, and more where rows multiply after the exchange, so that a few tasks would have it all."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
