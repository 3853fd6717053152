"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits: bit k is 1 if it is set in over half the XXH64 hashes of a text's 3-word shingles.
Fingerprints link at RADIUS = 3 or fewer differing bits.

1. Documents of one fingerprint are one class; all that follows is about distinct fingerprints.
2. Two fingerprints at most two bits apart share a variant within half the radius, one bit, of both.  The odd third
   bit is caught by leaving out one of four blocks of 16 bits: of three differing bits one is in some block, and
   without that block at most two differ.  So every fingerprint emits 4 x 49 variants of 48 bits; full balls of two
   bits would be 2,081.  Variants are shuffled; those that one fingerprint has alone go.
3. Fingerprints that share a variant are verified by their differing bits, in groups of up to GROUP.
4. Of a larger group no pairs are made.  Its members differ outside the block by at most one bit each from the shared
   variant, so each emits the variants of its block too: one bit, and two bits if it has the variant itself.  Two that
   meet in such a point, at offsets of at most three bits together, link for certain: the one of least offset is the
   centre and all others link to it if its offset is at most one.  A point has at most 2,081 members and a variant at
   most 49 * 2^16, however many documents there are.
5. Components of the links, distributed, give each class its least document.

Edge cases: null texts are empty, and texts without words have the fingerprint zero, linked like any other; fewer than
three words are one shingle; repeated rows are one class; ids that are null come back with the least id that is not
(null only if their component has none); other columns are not looked at, so their names cannot clash; an empty table
gives an empty result; texts of any length are read whole, hashes are counted in slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, text_batches, text_or_empty
from .graph import components

WORDS, SEED = 3, 42
RADIUS = 3
BITS, BLOCK = 64, 16
REST = BITS - BLOCK
GROUP = 64
SLICE = 1 << 16


def fingerprint(text: str) -> int:
    """The fingerprint of a text, unsigned."""
    words = text.encode().lower().split()  # bytes: only A-Z change, and blanks are the ASCII ones
    if not words:
        return 0
    line, k = memoryview(b" ".join(words)), min(WORDS, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    h = np.fromiter((xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in spans), np.uint64, len(words) - k + 1)
    ones = np.zeros(BITS, np.int64)
    for s in range(0, len(h), SLICE):
        ones += np.unpackbits(h[s : s + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row of ``docs`` (doc_id, text); fp is the fingerprint as a signed long."""
    text_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def _without(block: int) -> Column:
    """The fingerprint without a block, as 48 bits; the number of the block above them."""
    fp, at = F.col("fp"), BLOCK * block
    low = fp.bitwiseAND((1 << at) - 1)
    high = F.shiftleft(F.shiftrightunsigned(F.shiftrightunsigned(fp, at), BLOCK), at)
    return low.bitwiseOR(high).bitwiseOR(F.lit(block << REST))


def variants(classes: DataFrame) -> DataFrame:
    """(key, fp): the variants of every fingerprint (fp), one bit from it at most, without each of the blocks."""
    flips = F.array(*[F.lit(x) for x in (0, *(1 << i for i in range(REST)))])
    base = classes.select("fp", F.explode(F.array(*[_without(b) for b in range(BITS // BLOCK)])).alias("base"))
    return base.select("fp", "base", F.explode(flips).alias("flip")).select(F.col("base").bitwiseXOR(F.col("flip")).alias("key"), "fp")


def verified(groups: DataFrame) -> DataFrame:
    """(a, b) of the fingerprints of a key that link, b the lesser; groups are of GROUP members at most."""
    near = lambda x, y: (y < x) & (F.bit_count(x.bitwiseXOR(y)) <= RADIUS)
    pairs = F.flatten(F.transform("f", lambda x: F.transform(F.filter("f", lambda y: near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return groups.groupBy("key").agg(F.collect_list("fp").alias("f")).select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def met(groups: DataFrame) -> DataFrame:
    """(a, b) of the fingerprints of large groups: each point's members with its centre."""
    flip = lambda x, d: F.struct(F.lit(x).alias("flip"), F.lit(d).alias("d"))
    one = [flip(0, 0), *(flip(1 << i, 1) for i in range(BLOCK))]
    two = [flip(1 << i | 1 << j, 2) for i in range(BLOCK) for j in range(i)]
    block = F.shiftrightunsigned("key", REST).cast("int")
    own = F.element_at(F.array(*[_without(b) for b in range(BITS // BLOCK)]), block + 1) == F.col("key")
    inside = F.element_at(F.array(*[F.shiftrightunsigned("fp", BLOCK * b).bitwiseAND((1 << BLOCK) - 1) for b in range(BITS // BLOCK)]), block + 1)
    rows = groups.select("key", "fp", inside.alias("inside"), own.alias("own")).withColumn("x", F.explode(F.when(F.col("own"), F.array(*one, *two)).otherwise(F.array(*one))))
    rows = rows.select("key", F.col("inside").bitwiseXOR(F.col("x.flip").cast("long")).alias("point"), (F.col("x.d") + F.when(F.col("own"), 0).otherwise(1)).alias("offset"), "fp")
    centre = F.min(F.struct("offset", "fp")).over(Window.partitionBy("key", "point"))
    sure = rows.withColumn("c", centre).where((F.col("c.offset") <= RADIUS // 2) & (F.col("c.fp") != F.col("fp")))
    return sure.select(F.greatest("fp", "c.fp").alias("a"), F.least("fp", "c.fp").alias("b")).distinct()


def links(classes: DataFrame) -> DataFrame:
    """(a, b) with the components of all fingerprints (fp, distinct) at most RADIUS bits apart."""
    shared = variants(classes).withColumn("m", F.count("*").over(Window.partitionBy("key"))).where("m > 1")
    shared = cut(shared)
    return verified(shared.where(F.col("m") <= GROUP)).unionByName(met(shared.where(F.col("m") > GROUP)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text)."""
    rows = cut(fingerprints(docs))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(links(classes.select("fp")))
    named = classes.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    named = cut(named)
    first = named.groupBy("c").agg(F.min("least").alias("component_id")).withColumnRenamed("c", "name")
    named = named.join(first, F.col("c") == F.col("name")).select(F.col("fp").alias("f"), "component_id")
    return rows.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
