"""Filter interaction audit: what each filter removes in every order of five, with exact duplicates found by sorting.

1. Texts are range-partitioned by (fingerprint, doc_id) and sorted within partitions by fingerprint, full text and
   doc_id.  Equal texts are neighbours, so each row is compared with its predecessor only; a fingerprint that a third
   of all rows share is cut into several partitions by doc_id.  The four filters on a text alone are decided in the
   same pass.
2. Boundary handling: a partition tells the texts of its last fingerprint with their least id, at most one
   fingerprint a partition; rows of a partition's first fingerprint look their text up there, by SHA-256.
3. Masks of five bits are counted by part: at most 32 rows of additive counters a part.  Of the 600 steps of 120
   orders only 80 differ in the set of filters before and the filter itself; those are summed up and dealt to steps.

Edge cases: a null text is the empty text (it fails the filter on length only, and equals other empty texts); a null
source is the part of the empty string; rows with a null id are counted, are no one's original and never repeat one;
repeated rows of one id and text do not fail, as none has a smaller id; a document is good or toxic if any of its
labels says so; labels of unknown or null ids are not looked at; other columns are not read, so their names cannot
clash; an empty table gives an empty result; texts of any length are read whole, one at a time.
"""

from __future__ import annotations

import hashlib
from itertools import combinations, permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, small, table, text_batches, text_or_empty

FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65  # percent of the words
MOST_CAPITALS = 5  # percent of the code points
CAPITALS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}


def own_failures(text: str) -> int:
    """The mask of the filters A to D, which look at one text."""
    raw = text.encode()
    words = raw.split()  # ASCII blanks, as bytes
    out = BIT["A"] * (len(words) < LEAST_WORDS) + BIT["B"] * (100 * len(set(words)) < LEAST_DISTINCT * len(words))
    out += BIT["C"] * (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > MOST_CAPITALS * len(text))
    return out + BIT["D"] * (len(raw) != len(raw.translate(None, SYMBOLS)))


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def _compared(batches):
    """Sorted rows (fp, text, doc_id, part) as (doc_id, part, mask, fp, digest, start, told).

    fp and digest are set for rows of the partition's first fingerprint and for what it tells of its last one."""
    fp = text = start = digest = None
    first, last = True, {}
    for b in batches:
        doc_id, part, mask, key, own = [], [], [], [], []
        for f, t, i, p in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if f != fp:
                first, fp, text, last = fp is None, f, None, {}
            if t != text:
                text, start = t, None
                fails, digest = own_failures(t), _digest(t) if first else None
            if start is None and i is not None:
                start = last[t] = i  # ids ascend, nulls first
            doc_id.append(i)
            part.append(p)
            mask.append(fails + BIT["E"] * (i is not None and i > start))
            key.append(f if first else None)
            own.append(digest)
        yield _rows(doc_id, part, mask, key, own, [None] * len(mask), [False] * len(mask))
    if last:
        n = len(last)
        yield _rows([None] * n, [None] * n, [0] * n, [fp] * n, [_digest(t) for t in last], list(last.values()), [True] * n)


def _rows(*columns):
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "part", "mask", "fp", "digest", "start", "told"])


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row of ``docs`` (doc_id, text, source): the filters that it fails, as bits."""
    text_batches(docs.sparkSession)
    rows = docs.select(text_or_empty().alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    rows = rows.select(F.xxhash64("text").alias("fp"), "text", "doc_id", "part").repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    seen = cut(rows.mapInArrow(_compared, "doc_id bigint, part string, mask int, fp bigint, digest binary, start bigint, told boolean"))
    told = seen.where("told").groupBy(F.col("fp").alias("f"), F.col("digest").alias("d")).agg(F.min("start").alias("least"))
    found = seen.where("not told").join(small(told), (F.col("fp") == F.col("f")) & (F.col("digest") == F.col("d")), "left")
    again = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return found.select("doc_id", "part", F.when(again, F.col("mask").bitwiseOR(BIT["E"])).otherwise(F.col("mask")).alias("mask"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): additive, so counters of several tables may be summed up."""
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("l")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    every = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    labelled = masks.join(told, F.col("doc_id") == F.col("l")).groupBy("part", "mask").agg(F.lit(0).cast("long").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return every.unionByName(labelled).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def _turns() -> list[tuple[int, int, int]]:
    """(filters before, own filter, number of orders in which it comes right after those)."""
    bits = list(BIT.values())
    return [(sum(s), b, factorial(k) * factorial(len(bits) - 1 - k)) for b in bits for k in range(len(bits)) for s in combinations([x for x in bits if x != b], k)]


def audit(counts: DataFrame) -> DataFrame:
    """Counters as one row for each part, order of the filters and step."""
    spark = counts.sparkSession
    turn = F.explode(F.array(*[F.struct(F.lit(s).alias("before"), F.lit(b).alias("own"), F.lit(w).alias("orders")) for s, b, w in _turns()]))
    has = lambda c: F.col("mask").bitwiseAND(F.col(c)) != 0
    total = lambda when, c, out: F.sum(F.when(when, F.col(c)).otherwise(0)).alias(out)
    fails, earlier = has("own"), has("before")
    met = counts.withColumn("turn", turn).select("part", "mask", "n", "good", "toxic", "turn.*").groupBy("part", "own", "before").agg(
        total(~fails & ~earlier, "n", "kept"), total(fails & ~earlier, "n", "removed"), total(fails & earlier, "n", "redundant"), total(F.col("mask") == F.col("own"), "n", "unique_fails"),
        total(fails & ~earlier, "good", "good_lost"), total(fails & ~earlier, "toxic", "toxic_lost"), F.max("orders").alias("orders"),
    )
    share = met.groupBy("part", "own").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = [("".join(o), k + 1, sum(BIT[x] for x in o[:k]), BIT[f]) for o in permutations(FILTERS) for k, f in enumerate(o)]
    steps = spark.createDataFrame(steps, "filter_order string, step int, before int, own int")  # 600 rows, whatever the input
    out = met.join(share, ["part", "own"]).join(F.broadcast(steps), ["before", "own"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(counters(failures(documents(spark, sf_dir)), table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
lo AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
m AS (SELECT w.doc_id, part, CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM w JOIN lo USING (t)),
l AS (SELECT doc_id, bool_or(quality = 1) AS g, bool_or(toxic = 1) AS x FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (g) AS good, count(*) FILTER (x) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bs FROM f p, f q, f r, f s, f t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, bs[i] AS b, CAST(coalesce(list_sum(bs[1:i - 1]), 0) AS INTEGER) AS before FROM o, range(1, 6) AS k(i)),
r AS (SELECT part, filter_order, step, b, sum(CASE WHEN mask & (before | b) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & b <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = b THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley FROM r
"""
