"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words.  ``target / source_size`` is the expected number of copies of a
word of it: the whole part is taken for certain of every document, the rest is sampled with unequal
probabilities.  Within a source a document's inclusion probability is ``min(1, level * preference)``,
with the number of binary digits of its size as preference (longer documents are likelier to come once
more) and the level at which the expected words are the rest of the target; where it reaches 1 one more
copy is certain.  Each document gets the rank ``odds(u) / odds(p)`` with ``u`` a hash of its id, and the
documents of lowest rank fill what the certain copies leave of the target, up to the document whose
middle word passes it.  A source's words therefore miss its target by less than half a document.

Scale: the scan yields one narrow row a document.  Preferences take at most 64 values, so the plan is a table
of a row for each source and preference, summed before it is shuffled; ranks are summed in 4096 buckets
a source, and only the one bucket where a target is passed is ordered, so that a source
with a third of all rows never meets in one task.  The windows over the sources see a row a source.

Edge cases: null text has size 0 and takes no words; a null source is a source of its own, last in
order; rows that repeat a doc_id with texts of like size share their rank and are taken or left together;
an empty table gives an empty result; a source of size 0 has target 0; documents of size 0 have preference
0, so no copies beyond the certain ones.  Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, documents, small, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SEED = 17
BUCKETS = 4096


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of md5(id:seed)."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row a source: its words, weight and target.

    Targets solve ``sum(min(cap * size, level * weight)) = share * sum(size)``: the level where
    resharing the excess by weight leaves no target above its cap."""
    by = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by) - 1) % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    rising = Window.orderBy("ratio")
    below, level = rising.rangeBetween(Window.unboundedPreceding, Window.currentRow), F.col("level")
    return (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", w)
        .withColumn("most", F.col("source_size") * F.lit(cap))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("most_below", F.sum("most").over(below))
        .withColumn("weight_below", F.sum("weight").over(below))
        .withColumn("full", F.col("most_below") + F.col("ratio") * (F.col("all_weight") - F.col("weight_below")) <= F.col("total"))
        .withColumn("free", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(whole))
        .withColumn("spent", F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(whole))
        .withColumn("level", (F.col("total") - F.col("spent")) / F.when(F.col("free") > 0, F.col("free")))
        .withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(level * F.col("weight")))
        .select("source", "source_size", "target")
    )


def preference(size: Column) -> Column:
    """How likely a document is sampled against others of its source: the binary digits of its size."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0).cast("long")


def with_certain(targets: DataFrame) -> DataFrame:
    """Adds the copies that each document of a source has for certain and the words they leave to be sampled."""
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return targets.withColumn("certain", F.floor(copies).cast("long")).withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))


def with_inclusion(classes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each source and preference: the columns of ``targets`` and the inclusion probability ``p``.

    ``p`` solves ``sum(min(1, level * preference) * size) = rest`` in each source: preferences are taken
    from the greatest down, and those are certain for which the lesser ones, at that level, still fit."""
    c = classes.select(F.col("source").alias("cs"), "preference", "size")
    whole = Window.partitionBy("source")
    falling = whole.orderBy(F.desc("preference"))
    likely, weight = F.col("preference") > 0, F.col("preference") * F.col("size")
    return (
        c.join(small(targets), F.col("cs").eqNullSafe(F.col("source")))
        .withColumn("upto", F.sum("size").over(falling))
        .withColumn("below", F.sum(weight).over(whole) - F.sum(weight).over(falling))
        .withColumn("sure", F.when(likely, F.col("upto") + F.col("below") / F.col("preference") <= F.col("rest")).otherwise(False))
        .withColumn("spent", F.sum(F.when(F.col("sure"), F.col("size")).otherwise(0)).over(whole))
        .withColumn("open", F.sum(F.when(F.col("sure"), 0).otherwise(weight)).over(whole))
        .withColumn("level", (F.col("rest") - F.col("spent")) / F.when(F.col("open") > 0, F.col("open")))
        .withColumn("p", F.when(~likely | (F.col("rest") <= 0), 0.0).when(F.col("sure"), 1.0).otherwise(F.least(F.lit(1.0), F.col("level") * F.col("preference"))))
        .select("source", "preference", "source_size", "target", "certain", "rest", "p")
    )


def rank(u: Column, p: Column) -> Column:
    """Pareto order: random odds over inclusion odds; null where nothing more may be taken."""
    return F.when(p > 0, (u * (1 - p)) / ((1 - u) * p))


def plan_mix(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row for each source and preference with ``last``, the (rank, doc_id) of the source's last document taken once more.

    ``sized`` has doc_id, source, size, preference, u."""
    classes = cut(sized.groupBy("source", "preference").agg(F.sum("size").alias("size")))
    plan = cut(with_inclusion(classes, with_certain(source_targets(classes, weights, share, cap))))
    s = small(plan.where("p > 0").select(F.col("source").alias("s"), F.col("preference").alias("sp"), "p", "rest"))
    ranked = (
        sized.join(s, F.col("source").eqNullSafe(F.col("s")) & (F.col("preference") == F.col("sp")))
        .withColumn("rank", rank(F.col("u"), F.col("p")))
        .withColumn("bucket", F.floor(BUCKETS * F.col("rank") / (1 + F.col("rank"))).cast("int"))
    )
    upto = Window.partitionBy("source").orderBy("bucket")
    bucket = (
        ranked.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"), F.first("rest").alias("rest"))
        .withColumn("after", F.sum("in_bucket").over(upto))
        .withColumn("before", F.col("after") - F.col("in_bucket"))
    )
    # The bucket where the target is passed; in full buckets before it everything is taken.
    edge = bucket.where("after >= rest").groupBy("source").agg(F.min_by(F.struct("bucket", "before"), "bucket").alias("e"))
    edge = small(edge.select(F.col("source").alias("es"), F.col("e.bucket").alias("eb"), F.col("e.before").alias("before")))
    within = Window.partitionBy("source").orderBy("rank", "doc_id")
    last = (
        ranked.join(edge, F.col("source").eqNullSafe(F.col("es")) & (F.col("bucket") == F.col("eb")))
        .withColumn("middle", F.col("before") + F.sum("size").over(within.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size") / 2)
        .groupBy("source")
        .agg(F.max(F.when(F.col("middle") <= F.col("rest"), F.struct("rank", F.col("doc_id").cast("long").alias("doc_id")))).alias("last"), F.min("bucket").alias("edge"))
    )
    return cut(
        plan.join(small(last.select(F.col("source").alias("ls"), "last", "edge")), F.col("source").eqNullSafe(F.col("ls")), "left").drop("ls")
    )


def copies_of(u: Column, doc_id: Column) -> Column:
    """Copies of a row, given the columns of the plan of its source and preference."""
    q = rank(u, F.col("p"))
    bucket = F.floor(BUCKETS * q / (1 + q)).cast("int")
    more = F.when(F.col("edge").isNull(), q.isNotNull()).otherwise(
        (bucket < F.col("edge")) | F.coalesce(F.struct(q.alias("rank"), doc_id.cast("long").alias("doc_id")) <= F.col("last"), F.lit(False))
    )
    return F.col("certain") + F.coalesce(more, F.lit(False)).cast("long")


def sizes(df: DataFrame, seed: int = SEED) -> DataFrame:
    return df.select("doc_id", F.col("source").cast("string").alias("source"), words(text_or_empty()).alias("size"), uniform(F.col("doc_id"), seed).alias("u")).withColumn("preference", preference(F.col("size")))


def mix(df: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix as rows: every document as often as it is taken, with the columns of ``df``."""
    plan = small(plan_mix(cut(sizes(df, seed)), weights, share, cap).select(F.struct(F.col("source"), "preference", "certain", "p", "edge", "last").alias("_plan")))
    own = [F.col(f"`{c}`") for c in df.columns]
    kept = df.select(F.struct(*own).alias("_row"), F.col("source").cast("string").alias("_source"), uniform(F.col("doc_id"), seed).alias("_u"), preference(words(text_or_empty())).alias("_preference"))
    kept = kept.join(plan, F.col("_source").eqNullSafe(F.col("_plan.source")) & (F.col("_preference") == F.col("_plan.preference"))).select("_row", "_u", "_plan.*")
    times = F.sequence(F.lit(1).cast("long"), F.col("_n"))
    return kept.select("_row", copies_of(F.col("_u"), F.col("_row.doc_id")).alias("_n")).where("_n > 0").select("_row", F.explode(times)).select("_row.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(sizes(documents(spark, sf_dir)))
    plan = small(plan_mix(sized).withColumnsRenamed({"source": "s", "preference": "sp"}))
    return sized.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("preference") == F.col("sp"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies_of(F.col("u"), F.col("doc_id"))).alias("taken")
    )


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':17'), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    source_size * 2.0::DOUBLE AS most FROM src),
r AS (SELECT *, most / weight AS ratio, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS total, sum(weight) OVER () AS all_weight FROM w),
b AS (SELECT *, sum(most) OVER (ORDER BY ratio) + ratio * (all_weight - sum(weight) OVER (ORDER BY ratio)) <= total AS is_full FROM r),
l AS (SELECT *, (total - sum(CASE WHEN is_full THEN most ELSE 0.0::DOUBLE END) OVER ()) / nullif(sum(CASE WHEN is_full THEN 0.0::DOUBLE ELSE weight END) OVER (), 0) AS level FROM b),
t AS (SELECT source, source_size, CASE WHEN is_full THEN most ELSE level * weight END AS target FROM l),
i AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS copies FROM t),
k AS (SELECT source, source_size, target, CAST(floor(copies) AS BIGINT) AS certain, target - floor(copies) * source_size AS rest FROM i),
z AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS pref FROM sized),
g AS (SELECT source, pref, CAST(sum(size) AS BIGINT) AS size FROM z GROUP BY source, pref),
h AS (SELECT k.*, g.pref, g.size, CAST(sum(g.size) OVER f AS BIGINT) AS upto,
    CAST(sum(g.pref * g.size) OVER (PARTITION BY g.source) AS BIGINT) - CAST(sum(g.pref * g.size) OVER f AS BIGINT) AS below
  FROM g JOIN k ON g.source IS NOT DISTINCT FROM k.source WINDOW f AS (PARTITION BY g.source ORDER BY g.pref DESC)),
v AS (SELECT *, CASE WHEN pref > 0 THEN upto + below::DOUBLE / pref <= rest ELSE false END AS sure FROM h),
o AS (SELECT *, (rest - CAST(sum(CASE WHEN sure THEN size ELSE 0 END) OVER (PARTITION BY source) AS BIGINT))
    / nullif(CAST(sum(CASE WHEN sure THEN 0 ELSE pref * size END) OVER (PARTITION BY source) AS BIGINT), 0)::DOUBLE AS level FROM v),
p AS (SELECT source, pref, source_size, target, certain, rest, CASE WHEN pref = 0 OR rest <= 0 THEN 0.0::DOUBLE WHEN sure THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, level * pref) END AS p FROM o),
q AS (SELECT s.*, p.source_size, p.target, p.certain, p.rest, CASE WHEN p.p > 0 THEN (u * (1 - p.p)) / ((1 - u) * p.p) END AS rnk
  FROM z s JOIN p ON s.source IS NOT DISTINCT FROM p.source AND s.pref = p.pref),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rnk, doc_id) - size / 2.0::DOUBLE AS middle FROM q)
SELECT doc_id, size, source_size, target, CAST(size * (certain + CASE WHEN rnk IS NOT NULL AND middle <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
