"""Spelling variants of words, grouped by a symmetric-delete join.

Words are counted in tasks and summed up.  Every word emits a hash of itself and of each of its distinct single
deletions; words that share a hash are joined, and the strings of a pair are compared: near words differ by exactly
one inserted, deleted or replaced code point.  Of its near words the most frequent one is a word's form if it is five
times as frequent; forms are followed to the last by joins that double the way each round.

Pairs are joined only where they can be near: a word itself with a deletion, or two deletions at one place (a deletion
is known by the run of equal letters that it shortens).  Two deletions of words over the 90 letters meet at one key in
groups of at most 1 + 90 * (length + 1) words, however many documents there are, and rows carry numbers, not words, so
a word of n letters emits n + 1 short rows.  A form is five times as frequent as its word, so ways to the last form
have at most log5 of the largest count steps, and rounds of joins grow with the logarithm of that.

Edge cases: null and empty texts have no words; a null id stands as the empty string before the colon; repeated rows
count each time; ties of frequency go to the least word in code-point order; a word without near words has n_near 0,
null form and form_n and itself as root; other columns are not looked at, so their names cannot clash; an empty table
gives an empty result; texts and runs of any length are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, text_batches, text_or_empty

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LETTERS, LEAST_COUNT = 6, 5
TIMES = 5  # a form is at least so many times as frequent
SPOILED = 199  # of so many hashes one loses a letter
TABLE = 200_000  # words that a task counts before it passes them on
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
INVERSE = pow(BASE, -1, 1 << 64)


def words_of(doc_id, text: str) -> Counter:
    """The words of one document with their numbers; of every run that the checksum picks one letter is gone."""
    seed, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():  # bytes: only A-Z change
        if len(run) >= LEAST_LETTERS:
            h = zlib.crc32(run.encode(), seed)
            if h % SPOILED == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += n
    return out


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text) with LEAST_LETTERS and LEAST_COUNT at least."""
    text_batches(docs.sparkSession)

    def batch(seen):
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        seen = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                seen.update(words_of(doc_id.as_py(), text.as_py()))
                if len(seen) > TABLE:
                    yield batch(seen)
                    seen = Counter()
        yield batch(seen)

    counted = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "word string, n bigint")
    return counted.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def keys_of(word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a word and of its distinct deletions, with the first and last letter whose loss gives each (0 and 0: the word itself).

    A hash is the sum of c[j] * BASE^j modulo 2^64; without letter i, what follows moves by one place."""
    points = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
    mixed = (points + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    mixed ^= mixed >> np.uint64(32)
    power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(points), BASE, np.uint64))[:-1]])
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * power)])
    first = np.flatnonzero(np.concatenate([[True], points[1:] != points[:-1]]))
    last = np.concatenate([first[1:], [len(points)]])
    less = upto[first] + (upto[-1] - upto[first + 1]) * np.uint64(INVERSE)
    return np.concatenate([upto[-1:], less]), np.concatenate([[0], first + 1]), np.concatenate([[0], last])


def keys(numbered: DataFrame) -> DataFrame:
    """(key, lo, hi, id) of every word of ``numbered`` (id, word)."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                found = [keys_of(w.as_py()) for w in part.column(1)]
                ids = np.repeat(part.column(0).to_numpy(), [len(k) for k, _, _ in found])
                key, lo, hi = (np.concatenate([f[j] for f in found]) for j in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(ids)], names=["key", "lo", "hi", "id"])

    return numbered.select("id", "word").mapInArrow(run, "key bigint, lo int, hi int, id bigint")


def one_apart(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def near_pairs(numbered: DataFrame) -> DataFrame:
    """(x, y, word_y, n_y) of every two near words of ``numbered`` (id, word, n), both ways."""
    k = cut(keys(numbered))
    a, b = (k.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("lo", "hi", "id")]) for s in "ab")
    itself = F.col("lo_a") == 0
    place = F.when(itself | (F.col("lo_b") == 0), itself != (F.col("lo_b") == 0)).otherwise((F.col("lo_a") <= F.col("hi_b")) & (F.col("lo_b") <= F.col("hi_a")))
    pairs = a.join(b, "key").where((F.col("id_a") < F.col("id_b")) & place).select(F.col("id_a").alias("x"), F.col("id_b").alias("y")).distinct()
    of = lambda s: numbered.select(F.col("id").alias(s), F.col("word").alias(f"word_{s}"), F.col("n").alias(f"n_{s}"))
    told = cut(pairs.join(of("x"), "x").join(of("y"), "y").where(one_apart(F.col("word_x"), F.col("word_y"))))
    turned = told.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("word_x").alias("word_y"), F.col("n_x").alias("n_y"))
    return told.select("x", "y", "word_y", "n_y").unionByName(turned)


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of every word of ``forms`` (id, form_id): the last of the forms that follow it."""
    way = cut(forms.select("id", F.col("form_id").alias("root")))
    while True:
        step = way.select(F.col("id").alias("via"), F.col("root").alias("next"))
        way = cut(way.join(step, F.col("root") == F.col("via"), "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if way.where("moved").isEmpty():
            return way.select("id", "root")
        way = way.select("id", "root")


def variants(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of ``docs`` (doc_id, text)."""
    numbered = cut(words(docs).withColumn("id", F.monotonically_increasing_id()))
    best = near_pairs(numbered).groupBy("x").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_y")).alias("less"), "word_y", "y")).alias("b"))
    is_form = -F.col("b.less") >= TIMES * F.col("n")
    found = numbered.join(best, F.col("id") == F.col("x"), "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("b.word_y")).alias("form"), F.when(is_form, -F.col("b.less")).alias("form_n"), F.when(is_form, F.col("b.y")).alias("form_id"),
    )
    found = cut(found)
    last = roots(found.where("form_id is not null")).select(F.col("id").alias("i"), "root")
    named = last.join(numbered.select(F.col("id").alias("r"), F.col("word").alias("root_word")), F.col("root") == F.col("r")).select("i", "root_word")
    out = found.join(named, F.col("id") == F.col("i"), "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root_word", "word").alias("root"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir).select("doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")


OP13_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(256) AS r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS c FROM bits WHERE k = 8),
t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
g AS (SELECT run, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x, count(*) AS k FROM t WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, k, xor(4294967295, list_reduce([CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT) FOR i IN range(CAST(length(x) / 2 AS BIGINT))], lambda a, b: xor(a >> 8, tab.c[1 + (xor(a, b) & 255)]), 4294967295)) AS h FROM g, tab),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(k) >= 5),
e AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
m AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM e),
del AS (SELECT DISTINCT word, n, a || z AS less FROM m),
near AS (SELECT p.word, q.word AS other, q.n AS k FROM m p JOIN m q ON p.i = q.i AND p.a = q.a AND p.z = q.z AND p.word <> q.word
  UNION ALL SELECT del.word, w.word, w.n FROM del JOIN w ON w.word = del.less UNION ALL SELECT w.word, del.word, del.n FROM del JOIN w ON w.word = del.less),
b AS (SELECT word, count(*) AS n_near, arg_min(other, (-k, other)) AS form, max(k) AS form_n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM w LEFT JOIN b USING (word)),
r AS (SELECT word, word AS at, 0 AS k FROM f UNION ALL SELECT r.word, f.form, k + 1 FROM r JOIN f ON f.word = r.at WHERE f.form IS NOT NULL)
SELECT word, form, arg_max(r.at, r.k) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n FROM f JOIN r USING (word) GROUP BY word, form
"""
