"""Toxicity by compression distance.

Two zstandard dictionaries are trained with the library's trainer, one on words of ordinary labelled text and
one on the toxic words of toxic text: those with a five-byte run that is ``LIFT`` times as frequent in toxic
documents.  A text is cut into overlapping windows of one and of ``WINDOW`` words.  A window's distance is its compressed
length under the ordinary dictionary less that under the toxic one; both see it behind a short header that both
dictionaries end in, since the format leaves shorter input uncompressed.  Words recur more often than windows, so
each word is a window of its own, compressed once a task, and a wider window is compressed only if one of its words
is shorter under the toxic dictionary; all others have distance 0.  Thresholds on the largest distances and
on the numbers and shares of windows beyond given distances are calibrated by logistic regression on labelled
documents that gave no words to the dictionaries; of several segment lengths of the trainer (``SEGMENTS``) the one
with the least loss there is kept.

The sample is bounded by ``TOXIC`` and ``ORDINARY`` labelled documents, the dictionaries by ``SIZES`` bytes.
Scoring is a map over all texts, whole; a task's table of words is emptied at ``TABLE`` entries.

Edge cases: null text is empty, has no window and gets the score of such; without labelled rows of both
kinds, or with too few words to train on, every score is 0.0; repeated rows have equal scores; an empty table
gives an empty result; a null doc_id belongs to no fold and is not held out; a column named as the output is
an error, other columns stay as they are.
"""

from __future__ import annotations

import pickle
import random
from collections import Counter
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table, text_batches, text_or_empty
from .labelled import fitted, fold, sample, series_udf

TOXIC, ORDINARY = 1500, 3000
SIZES = {"ordinary": 4096, "toxic": 2048}
COST = 2.5  # a toxic document that is missed counts as so many ordinary ones rejected
SAMPLES = {"ordinary": 60_000, "toxic": 20_000}
SEGMENTS = (24, 32, 48)
GRAM, LIFT, LEAST = 5, 8.0, (3, 0.02)  # bytes, times, toxic documents: so many and such a share
WINDOW = 2
TABLE = 100_000  # words that a task keeps, some 15 MB
HEADER = bytes(range(1, 33))
FAR = (3, 4, 5)


def framed(words: list[str]) -> bytes:
    return f" {' '.join(words)} ".encode()


def windows(text: str) -> list[bytes]:
    w = text.lower().encode().split()
    return [b" %b " % b" ".join(w[i : i + WINDOW]) for i in range(max(1, len(w) - WINDOW + 1))] if w else []


class Distance:
    """Distances of windows under a pair of trained dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as z

        # Lazy search with matches from three bytes, small tables: windows and dictionaries are short.
        p = z.ZstdCompressionParameters(
            window_log=15, hash_log=13, chain_log=13, search_log=5, min_match=3, target_length=32, strategy=z.STRATEGY_LAZY2,
            write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS,
        )
        self.compress = []
        for d in (ordinary, toxic):
            made = z.ZstdCompressionDict(d + HEADER, dict_type=z.DICT_TYPE_FULLDICT)
            made.precompute_compress(compression_params=p)
            self.compress.append(z.ZstdCompressor(dict_data=made, compression_params=p).compress)
        self.table: dict[bytes, int] = {}

    def of(self, cut: list[bytes]) -> np.ndarray:
        each = [HEADER + w for w in cut]
        plain, toxic = (np.fromiter(map(len, map(c, each)), np.int32, len(each)) for c in self.compress)
        return plain - toxic

    def along(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The distance of each word of ``text``, and of each window; 0 for windows without a word of positive distance."""
        words = text.lower().encode().split()
        if len(self.table) > TABLE:
            self.table.clear()
        new = list(set(words).difference(self.table))
        self.table.update(zip(new, self.of([b" %b " % w for w in new]).tolist(), strict=True))
        one = np.fromiter(map(self.table.__getitem__, words), np.int32, len(words))
        out = np.zeros(max(1, len(words) - WINDOW + 1) if words else 0, np.int32)
        at = np.flatnonzero(np.convolve(one > 0, np.ones(min(WINDOW, len(words)), int), "valid")) if words else []
        out[at] = self.of([b" %b " % b" ".join(words[i : i + WINDOW]) for i in at])
        return one, out

    def features(self, text: str) -> np.ndarray:
        parts = [np.log1p(len(text)), 1.0]
        for d in self.along(text):
            d = np.sort(d)[::-1] if len(d) else np.full(1, -9)
            many = [min(int((d >= k).sum()), 20) for k in FAR]
            parts += [d[0], d[min(WINDOW, len(d) - 1)], d[min(2 * WINDOW, len(d) - 1)], *many, 50 * (d >= 4).mean(), 50 * (d >= 2).mean(), *(d[0] >= k for k in range(9))]
        return np.array(parts, float)


def calibrated(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, np.ndarray]:
    """Loss and weights of a logistic regression, by Newton's steps with a ridge; toxic rows count as ``share`` of all."""
    n, own = len(y), y.mean()
    by = np.where(y > 0, COST * share / own, (1 - share) / (1 - own)) if 0 < own < 1 and 0 < share < 1 else np.ones(n)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (by * p * (1 - p))[:, None]) + 0.3 * np.eye(len(w)), x.T @ (by * (p - y)) + 0.3 * w)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return float(-np.mean(by * np.log(np.where(y > 0, p, 1 - p)))), w


def toxic_words(texts: list[str], labels: list[int]) -> list[bytes]:
    """Every occurrence in toxic texts of a word with a run of bytes that is far more frequent there."""
    grams, docs = [Counter(), Counter()], [0, 0]
    for text, label in zip(texts, labels, strict=True):
        docs[label] += 1
        grams[label].update({x[i : i + GRAM] for x in {framed([w]) for w in text.lower().split()} for i in range(len(x) - GRAM + 1)})
    share = lambda g, k: (grams[k][g] + 0.5) / (docs[k] + 1)
    marks = {g for g, n in grams[1].items() if n >= max(LEAST[0], LEAST[1] * docs[1]) and share(g, 1) >= LIFT * share(g, 0)}
    words = (framed([w]) for t, label in zip(texts, labels, strict=True) if label for w in t.lower().split())
    return [w for w in words if any(w[i : i + GRAM] in marks for i in range(len(w) - GRAM + 1))]


def fit(pdf: pd.DataFrame, share: float) -> bytes:
    """The pickled (ordinary dictionary, toxic dictionary, weights); weights None where there is too little to train on.

    ``share`` is that of toxic documents among all labelled ones, of which the sample holds another."""
    from zlib import crc32

    import zstandard as z

    nothing = pickle.dumps((b"", b"", None))
    if pdf["label"].nunique() < 2:
        return nothing
    apart = pdf["text"].map(lambda t: crc32(t.encode()) % 4 == 0).to_numpy()  # by text, so that copies fall together
    own = pdf[~apart]
    texts, labels = own["text"].tolist(), own["label"].astype(int).tolist()
    toxic = toxic_words(texts, labels)
    plain = [framed([w]) for t, label in zip(texts, labels, strict=True) if not label for w in t.lower().split()]
    random.Random(0).shuffle(plain)
    if not toxic or len(plain) < 100:
        return nothing
    try:
        ordinary = z.train_dictionary(SIZES["ordinary"], plain[: SAMPLES["ordinary"]], k=20, d=6, level=6).as_bytes()
        made = [z.train_dictionary(SIZES["toxic"], toxic * max(1, SAMPLES["toxic"] // len(toxic)), k=k, d=6, level=6).as_bytes() for k in SEGMENTS]
    except z.ZstdError:  # the trainer found too little that repeats
        return nothing
    kept = pdf[apart] if pdf[apart]["label"].nunique() == 2 else pdf
    y, found = kept["label"].to_numpy(float), []
    for d in made:
        distance = Distance(ordinary, d)
        found.append((*calibrated(np.array([distance.features(t) for t in kept["text"]]), y, share), d))
    _, w, d = min(found, key=lambda x: x[0])
    return pickle.dumps((ordinary, d, w))


def train(docs: DataFrame, labels: DataFrame) -> bytes | None:
    free = labels.where(fold(5) != 0).agg(F.avg("toxic").alias("share")).first()["share"] or 0.0
    return fitted(sample(docs, labels, "toxic", 5, 0, {1: TOXIC, 0: ORDINARY}), partial(fit, share=float(free)))


def score(df: DataFrame, model: bytes | None, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability that ``text`` is toxic."""
    if out in df.columns:
        raise ValueError(f"column exists already: {out}")

    text_batches(df.sparkSession)

    # A model of a few kilobytes goes to the tasks with the function.
    def run(frames):
        plain, toxic, w = pickle.loads(model) if model else (b"", b"", None)
        distance = Distance(plain, toxic) if w is not None else None
        for t in frames:
            if distance is None:
                yield pd.Series(0.0, index=t.index)
            else:
                yield pd.Series([float(1 / (1 + np.exp(-np.clip(distance.features(x) @ w, -30, 30)))) for x in t], index=t.index, dtype=float)

    return df.withColumn(out, series_udf(run)(text_or_empty(text)))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
