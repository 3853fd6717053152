"""Bounded training samples of labelled documents, and fitting in one task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty


def fold(mod: int):
    """crc32 of the id as text, modulo ``mod``; -1, which is no fold, where the id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod, F.lit(-1))


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, most: dict[int, int]) -> DataFrame:
    """(text, label) of at most ``most[v]`` rows for each label v, outside the held-out fold, in order of a hash of the id.

    Only labels are ordered; the few ids chosen are sent to the documents."""
    free = labels.where(f"doc_id is not null and {label} is not null").where(fold(mod) != held).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    chosen = reduce(DataFrame.unionByName, (free.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in most.items()))
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    return docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")  # sum(most.values()) rows


def fitted(rows: DataFrame, fit) -> bytes | None:
    """``fit(pandas frame) -> bytes`` of the sample, in one task; rows in order of id, so that reruns agree."""

    def run(frames):
        parts = list(frames)
        if parts:
            pdf = pd.concat(parts).sort_values(["doc_id", "text"], kind="stable").reset_index(drop=True)
            if len(pdf):
                yield pd.DataFrame({"model": [fit(pdf)]})

    got = rows.repartition(1).mapInPandas(run, "model binary").first()
    return bytes(got["model"]) if got else None


def series_udf(run):
    """A scalar UDF of doubles from a generator over the series of a task."""

    def scores(it):
        return run(it)

    scores.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(scores, "double")
