"""Quality classification by a factorisation machine.

The features of a text are the shares of its hashed words, statistics of its structure and its length.
The machine adds to a linear model the products of all pairs of features, weighted by the inner
products of low-rank factors, summed in linear time as half of (square of sum less sum of squares).

The sample is bounded by ``ROWS`` labelled documents of each label.  Scoring is a map over whole texts.

Edge cases: null text is empty and is scored by its statistics alone; without labelled rows of both kinds
every score is 0.5; repeated rows have equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table, text_or_empty
from .labelled import fitted, fold, sample, series_udf

ROWS = 2500
BUCKETS, RANK = 1 << 13, 6
UPPER = bytes(range(65, 91))
LETTER = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
DIGIT = bytes(range(48, 58))
BLANK = b" \t\r\n\v\f"
TABLE = 100_000


def statistics(text: str, words: list[str]) -> list[float]:
    raw = text.encode()
    n, k = max(len(raw), 1), max(len(words), 1)
    without = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    letters, digits, blanks = without(LETTER), without(DIGIT), without(BLANK)
    lines = text.split("\n")
    distinct = len(set(words))
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    ends = Counter(w[-1] for w in words)
    return [
        without(UPPER), digits, 1 - letters - digits - blanks, raw.count(b"|") / k, raw.count(b"!") / k,
        lengths.mean() / 10, lengths.std() / 10, distinct / k, len(set(lines)) / len(lines),
        sum(c for e, c in ends.items() if e in "#$%&*@~^") / k, np.log1p(len(text)) / 10, np.log1p(len(lines)) / 5, k / len(lines) / 100,
        max(Counter(words).values()) / k if words else 0.0,
    ]


class Reader:
    """Hashed words of texts, with a table from word to bucket."""

    def __init__(self):
        self.table: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if len(self.table) > TABLE:
            self.table.clear()
        for w in set(words).difference(self.table):
            self.table[w] = crc32(w.encode()) % BUCKETS
        return np.fromiter(map(self.table.__getitem__, words), np.int32, len(words)), np.array(statistics(text, words))


def machine(w, v, words, dense, doc, docs):
    """Scores, and the sums of factors, of documents: ``words`` buckets with shares, ``dense`` standardised statistics."""
    index, share = words
    linear = dense @ w[BUCKETS:-1] + w[-1] + np.bincount(doc, share * w[index], docs)
    sums = np.stack([np.bincount(doc, share * v[index, f], docs) for f in range(RANK)], 1) + dense @ v[BUCKETS:]
    squares = np.bincount(doc, share**2 * (v[index] ** 2).sum(1), docs) + dense**2 @ (v[BUCKETS:] ** 2).sum(1)
    return linear + 0.5 * ((sums**2).sum(1) - squares), sums


def fit(pdf: pd.DataFrame, epochs: int = 60, rate: float = 0.03) -> bytes:
    """The pickled (mean, deviation, linear weights, factors); None without both labels."""
    if pdf["label"].nunique() < 2:
        return pickle.dumps(None)
    read = Reader()
    rows = [read(t) for t in pdf["text"]]
    y = pdf["label"].to_numpy(float)
    dense = np.array([s for _, s in rows])
    mean, deviation = dense.mean(0), dense.std(0) + 1e-6
    dense = np.clip((dense - mean) / deviation, -5, 5)
    n = len(rows)
    doc = np.repeat(np.arange(n), [len(i) for i, _ in rows])
    # One entry for each document and bucket.
    key, count = np.unique(doc.astype(np.int64) * BUCKETS + np.concatenate([i for i, _ in rows]), return_counts=True)
    doc, index = key // BUCKETS, (key % BUCKETS).astype(np.int64)
    share = count / np.array([max(len(i), 1) for i, _ in rows])[doc]
    rng = np.random.default_rng(7)
    w, v = np.zeros(BUCKETS + dense.shape[1] + 1), rng.normal(0, 0.02, (BUCKETS + dense.shape[1], RANK))
    state = [np.zeros_like(x) for x in (w, w, v, v)]
    for t in range(1, epochs + 1):  # Adam over the whole sample
        s, sums = machine(w, v, (index, share), dense, doc, n)
        g = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y) / n
        gs = g[doc] * share
        gw = np.concatenate((np.bincount(index, gs, BUCKETS), g @ dense, [g.sum()])) + 1e-4 * w
        gv = np.empty_like(v)
        for f in range(RANK):
            gv[:BUCKETS, f] = np.bincount(index, gs * (sums[doc, f] - v[index, f] * share), BUCKETS)
        gv[BUCKETS:] = (dense * g[:, None]).T @ sums - v[BUCKETS:] * (g @ dense**2)[:, None]
        gv += 1e-3 * v
        for x, gx, m, q in ((w, gw, state[0], state[1]), (v, gv, state[2], state[3])):
            m += 0.1 * (gx - m)
            q += 0.01 * (gx**2 - q)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.99**t)) + 1e-8)
    return pickle.dumps((mean, deviation, w, v.astype(np.float32)))


def train(docs: DataFrame, labels: DataFrame) -> bytes | None:
    return fitted(sample(docs, labels, "quality", 3, 1, {0: ROWS, 1: ROWS}), fit)


def score(df: DataFrame, model: bytes | None, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability that ``text`` is of quality 1."""
    if out in df.columns:
        raise ValueError(f"column exists already: {out}")

    def run(frames):
        fitted = pickle.loads(model) if model else None
        read = Reader()
        for t in frames:
            if fitted is None:
                yield pd.Series(0.5, index=t.index)
                continue
            mean, deviation, w, v = fitted
            scores = []
            for x in t:
                index, s = read(x)
                count = np.bincount(index, minlength=0)
                index = np.flatnonzero(count)
                share = count[index] / max(int(count.sum()), 1)
                dense = np.clip((s - mean) / deviation, -5, 5)
                vi = v[index]
                sums = share @ vi + dense @ v[BUCKETS:]
                squares = share**2 @ (vi**2).sum(1) + dense**2 @ (v[BUCKETS:] ** 2).sum(1)
                z = w[-1] + share @ w[index] + dense @ w[BUCKETS:-1] + 0.5 * ((sums**2).sum() - squares)
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield pd.Series(scores, index=t.index, dtype=float)

    return df.withColumn(out, series_udf(run)(text_or_empty(text)))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
