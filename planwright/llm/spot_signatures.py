"""SpotSigs document fingerprints.

A text is lower-cased and cut into words of letters and digits.  Wherever one or more common words
(the anchors) stand before a content word, that run of anchors with the chain of the next ``CHAIN``
content words is a spot signature.  The set of a document's signatures is its fingerprint; documents
are compared by the Jaccard likeness of their sets.

``near_duplicates`` partitions the sets by their length: two sets of likeness ``t`` differ in length
by a factor of ``t`` at most, so each band of lengths meets itself and the next one only.  Within the
bands sets meet in the signatures of their prefix in order of rising frequency, which holds one shared
signature for every pair of likeness ``t``; a pair's bound from its lengths and the place of that
signature prunes it before the sets are intersected.

Scale: all of it is DataFrame expressions.  Documents with equal sets are one class before any pair is
made.  ``following`` deals ids over ranges, each with a copy of the one row that its last row needs
from the next range, so no window spans the table.

Edge cases: null text is empty; a text without signatures has the hash of its words as the only one,
so that it is like its equals; without words the set is empty, and empty sets are alike (1.0).  Null ids
stand as the lowest id; rows that repeat an id are ordered by text.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, partitions, text_or_empty

#: Anchors: common words of English, German, French and Spanish.  A parameter.
ANCHORS = tuple(
    """the a an is was of and to in that for it with as on be by at this from or are
    der die das und ist von zu den mit ein eine für auf des nicht dem auch als sich im
    le la les de du et un une est que qui dans pour pas sur au aux plus avec en
    el los las del y es por con para su se lo al como""".split()
)
CHAIN = 2
MARK = "\x01"
LOWEST = -(2**63)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def with_signatures(df: DataFrame, text: str, out: str, anchors=ANCHORS, chain: int = CHAIN) -> DataFrame:
    """``df`` with the sorted array of the signatures of column ``text``; an error if a column to be made exists."""
    if clash := {out, "_words", "_parts", "_spots"} & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    glue = f"(?<= )({'|'.join(anchors)}) "
    df = df.withColumn("_words", normal(F.col(text)))
    df = df.withColumn("_parts", F.split(F.trim(F.regexp_replace(F.concat(F.lit(" "), F.col("_words"), F.lit(" ")), glue, f"$1{MARK}")), " "))
    content = lambda x: F.substring_index(x, MARK, -1)

    def spot(x, i):
        tail = [content(F.get("_parts", i + k)) for k in range(1, chain)]
        whole = F.get("_parts", i + (chain - 1)).isNotNull() & (content(F.get("_parts", i + (chain - 1))) != "")
        return F.when(F.contains(x, F.lit(MARK)) & whole, F.concat_ws(" ", F.translate(x, MARK, " "), *tail))

    df = df.withColumn("_spots", F.array_sort(F.array_distinct(F.array_compact(F.transform("_parts", spot)))))
    only = F.when(F.col("_words") != "", F.array(F.concat(F.lit("="), F.sha2("_words", 256)))).otherwise(F.array().cast("array<string>"))
    return df.withColumn(out, F.when(F.size("_spots") > 0, F.col("_spots")).otherwise(only)).drop("_words", "_parts", "_spots")


def fingerprint(sigs: Column) -> Column:
    return F.sha2(F.array_join(sigs, "\n"), 256)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both.cast("double") / either)


def length_band(n: Column, threshold: float) -> Column:
    """Sets of likeness ``threshold`` have lengths in the same or in neighbouring bands."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")


def near_duplicates(df: DataFrame, threshold: float = 0.8, anchors=ANCHORS, chain: int = CHAIN) -> DataFrame:
    """(a, b, likeness) between classes of equal sets, each named by its smallest doc_id; ``likeness >= threshold``.

    Copies share a class and are not expanded into pairs; documents with an empty set are in none."""
    sets = with_signatures(df.select("doc_id", text_or_empty().alias("text")), "text", "sigs", anchors, chain).drop("text").where(F.size("sigs") > 0)
    classes = cut(sets.groupBy("sigs").agg(F.min("doc_id").alias("id")).select("id", "sigs", F.size("sigs").alias("n")))
    seen = classes.select("id", "n", F.explode("sigs").alias("sig"))
    often = seen.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = seen.join(often, "sig").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("s"))
    # With likeness t a pair shares ceil(t * n) signatures, so one is among the first n - ceil(t * n) + 1 of either.
    prefix = ranked.select("id", "n", F.posexplode(F.slice("s", 1, (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))).alias("pos", "x"))
    prefix = prefix.where("x.df > 1").select("id", "n", "pos", "x.sig", length_band(F.col("n"), threshold).alias("band"))
    a, b = prefix.alias("a"), prefix.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1))).alias("b")
    bound = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    need = F.ceil((F.col("a.n") + F.col("b.n")) * (threshold / (1 + threshold)) - 1e-9)
    ordered = (F.col("a.n") > F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id")))
    pairs = a.join(b, ["sig", "band"]).where(ordered & (F.col("b.n") >= F.col("a.n") * threshold) & (bound >= need))
    pairs = pairs.select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct()
    named = lambda k: classes.select(F.col("id").alias(k), F.col("sigs").alias(f"s{k}"))
    return (
        pairs.join(named("x"), "x").join(named("y"), "y").withColumn("likeness", likeness(F.col("sx"), F.col("sy")))
        .where(F.col("likeness") >= threshold)
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")
    )


def following(df: DataFrame) -> DataFrame:
    """(doc_id, text, next): each row with the text of the next one by falling doc_id; after the last comes the first."""
    rows = df.select("doc_id", text_or_empty().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("k"))
    parts = 2 * partitions(df.sparkSession)
    edges = rows.agg(F.percentile_approx("k", [i / parts for i in range(parts + 1)], 100 * parts).alias("e")).first()["e"] or []
    edges = sorted(set(edges))  # ids of rows: a few for each partition, however many rows there are
    if not edges:
        return rows.select("doc_id", "text", F.col("text").alias("next"))
    inner, top = edges[:-1], edges[-1]
    # Range j has the ids above inner[j - 1], up to inner[j]; the row at its lower edge is a guest there,
    # and so is the first of all rows in the lowest range.
    at = F.lit(len(inner)) if not inner else F.array_size(F.filter(F.array(*[F.lit(x) for x in inner]), lambda e: e < F.col("k")))
    own = F.array(F.struct(at.alias("range"), F.lit(0).alias("guest")))
    guests = own if not inner else F.when(F.array_contains(F.array(*[F.lit(x) for x in inner]), F.col("k")), F.array_append(own, F.struct((at + 1).alias("range"), F.lit(1).alias("guest")))).otherwise(own)
    guests = F.when(F.col("k") == top, F.array_append(guests, F.struct(F.lit(0).alias("range"), F.lit(2).alias("guest")))).otherwise(guests)
    dealt = rows.select("*", F.explode(guests).alias("g")).select("doc_id", "text", "k", "g.*")
    order = Window.partitionBy("range").orderBy("guest", F.desc("k"), F.desc("text"))
    return dealt.withColumn("next", F.lead("text").over(order)).where("guest = 0").select("doc_id", "text", "next")


def edited(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by the first as many of the following text."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(following, F.lit(1), third))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = following(documents(spark, sf_dir).select("doc_id", "text"))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next")))
    rows = with_signatures(rows, "text", "own")
    rows = with_signatures(rows, "edited", "new")
    rows = with_signatures(rows, "next", "after")
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
        F.size("own").cast("long").alias("n_signatures"), length_band(F.size("own"), 0.8).cast("long").alias("length_band"),
    )


OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, text DESC) AS r FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY r), first_value(text) OVER (ORDER BY r)) AS nxt FROM d),
e AS (SELECT *, text[1:length(text) - length(text) // 3] || nxt[1:length(text) // 3] AS edited FROM n),
t AS (SELECT r, 'own' AS which, text AS t FROM e UNION ALL SELECT r, 'new', edited FROM e UNION ALL SELECT r, 'after', nxt FROM e),
m AS (SELECT r, which, trim(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS words FROM t),
w AS (SELECT r, which, unnest(string_split(words, ' ')) AS w, generate_subscripts(string_split(words, ' '), 1) AS i FROM m WHERE words <> ''),
a AS (SELECT *, w IN ({', '.join(f"'{x}'" for x in ANCHORS)}) AS anchor FROM w),
c AS (SELECT *, count(*) FILTER (NOT anchor) OVER (PARTITION BY r, which ORDER BY i) - CASE WHEN anchor THEN 0 ELSE 1 END AS k FROM a),
u AS (SELECT r, which, k, string_agg(w, ' ' ORDER BY i) AS glued, count(*) AS n, max(CASE WHEN NOT anchor THEN w END) AS content FROM c GROUP BY r, which, k),
s AS (SELECT r, which, n, glued, content, lead(content) OVER (PARTITION BY r, which ORDER BY k) AS after FROM u),
g AS (SELECT DISTINCT r, which, glued || ' ' || after AS sig FROM s WHERE n > 1 AND content IS NOT NULL AND after IS NOT NULL),
h AS (SELECT r, which, list(sig ORDER BY sig) AS sigs FROM g GROUP BY r, which),
f AS (SELECT m.r, m.which, coalesce(h.sigs, CASE WHEN words <> '' THEN ['=' || sha256(words)] ELSE CAST([] AS VARCHAR[]) END) AS sigs FROM m LEFT JOIN h USING (r, which)),
j AS (SELECT e.doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, o.sigs AS own, w.sigs AS new, x.sigs AS after
  FROM e JOIN f o ON o.r = e.r AND o.which = 'own' JOIN f w ON w.r = e.r AND w.which = 'new' JOIN f x ON x.r = e.r AND x.which = 'after'),
z AS (SELECT *, len(list_intersect(own, new)) AS i1, len(list_intersect(own, after)) AS i2 FROM j)
SELECT doc_id, n_chars, edited_sha256, sha256(array_to_string(own, chr(10))) AS fingerprint, sha256(array_to_string(new, chr(10))) AS edited_fingerprint,
  CASE WHEN len(own) + len(new) = 0 THEN 1.0::DOUBLE ELSE i1::DOUBLE / (len(own) + len(new) - i1) END AS near_edited,
  CASE WHEN len(own) + len(after) = 0 THEN 1.0::DOUBLE ELSE i2::DOUBLE / (len(own) + len(after) - i2) END AS near_next,
  len(own) AS n_signatures, CAST(floor(ln(greatest(len(own), 1)::DOUBLE) / ln(1 / 0.8::DOUBLE) + 1e-9) AS BIGINT) AS length_band FROM z
"""
