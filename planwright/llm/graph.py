"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CHUNK = 500_000


def forest(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of ``size`` numbers that each one reaches by the pairs."""
    label = np.arange(size)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (node, least node that it reaches) of all nodes but the least ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = forest(len(nodes), at[: len(a)], at[len(a) :])
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def contracted(links: DataFrame) -> DataFrame:
    """(a, b) with the same components: each task turns what it has, CHUNK links at a time, into stars; b is less than a."""

    def run(batches):
        waiting, n = [], 0

        def out():
            a, b = stars(*(np.concatenate([w[k] for w in waiting]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for x in batches:
            waiting.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
            n += x.num_rows
            if n >= CHUNK:
                yield out()
                waiting, n = [], 0
        if waiting:
            yield out()

    return links.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def _star(e: DataFrame, both: bool) -> DataFrame:
    """Links of each node's neighbours to the least of them and itself: the greater neighbours (large) or the lesser (small)."""
    pairs = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else e
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
    joined = pairs.join(least, F.col("a") == F.col("u"))
    if both:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b")


def _is_done(e: DataFrame) -> bool:
    """Whether every node is either a root or has one link, to a root."""
    ends = e.select(F.col("a").alias("v"), F.col("b").alias("r")).unionByName(e.select(F.col("b").alias("v"), F.lit(None).cast("long").alias("r")))
    ends = ends.groupBy("v").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.max(F.col("r").isNull()).alias("root"))
    return ends.where("lo is not null and (root or lo < hi)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b longs); a component is named by its least node.

    Links that are turned so that each points to a lesser node, and rewired to the least neighbour from
    both sides in turn, become stars in a number of rounds that grows with the logarithm of the nodes.
    Every round is written to the checkpoint folder.  Links that come out of Python should be written first:
    two Python steps in one stage take two workers a core."""
    e = cut(contracted(links).distinct())
    while not _is_done(e):
        e = cut(_star(_star(e, True), False).distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
