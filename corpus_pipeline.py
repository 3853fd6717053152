"""A corpus pipeline of five stages, each by one operator of planwright.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  Empty tables pass through; rows with null text are empty documents and stay until the mix,
which takes no copies of documents without words beyond the certain ones.  Columns beyond those of ``documents``
go in the first stage, so none can clash.  Repeated rows are near duplicates of each other: one stays.  Of rows
with one id and different texts each goes its own way; ties go to the least id, then the least text.  Texts of
any length are read whole; null text is the empty string from the third stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwright.llm import mixing, ngram_join, pieces, secret_scan, toxicity
from planwright.llm.common import cut, documents, table

OWN = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects (0.5 or more) go; the model learns from the labelled documents of sf_dir."""
    model = toxicity.train(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*OWN), model, out="_toxic").where(F.col("_toxic") < 0.5).drop("_toxic")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays, that of the least doc_id."""
    return ngram_join.distinct_documents(docs.select(*OWN))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every secret found is replaced by a mask, and n_chars follows."""
    return secret_scan.redact(docs.select(*OWN))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs.select(*OWN))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, begin and end included, and whether they decode to its text."""
    coded = pieces.encode(docs.select("doc_id", "source", "text"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [("toxicity", toxic_out), ("ngram_join", one_of_each), ("secret_scan", secrets_masked), ("source_mix", mixed), ("sentencepiece", tokens)]

#: Compression lengths and piece merges are beyond SQL; tests hold the operators of the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else cut(docs), sf_dir)
    return docs
