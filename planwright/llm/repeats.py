"""Suffix-array dedup: removal of bytes covered by a 100-byte string that also starts earlier.

1. Every 100-byte window has an anchor: the run of ``K`` bytes in it with the least hash, leftmost.  Equal
   windows have equal anchors at equal places.  A row is sent for each anchor, with a hash of its context:
   all bytes that its windows cover.  Anchors with one context each are settled at once: where the
   context repeats, all windows of this anchor but the first's do.  What repeats within a batch is known
   there and then, and is dealt out by its place, so that a text of one line over and over is no hot key.
2. Anchors with several contexts are looked at by bytes.  The contexts of one anchor are set side by side,
   the bytes that all share around the anchor as one symbol, cut where they are like no other; their
   suffixes are sorted, and equal windows, now neighbours, are marked but for the first.
3. The windows of an anchor with more than ``COLD`` contexts are cut into blocks of ``BLOCK`` places.  The
   bytes that all windows of a block have, with the anchor's, are a longer anchor, the bytes that some of
   them has its context, and blocks are settled as anchors are.  Only where a longer anchor still has more
   than ``COLD`` contexts are hashes of single windows aggregated over the cluster.

The suffix order is built by grouping, in linear time.  Suffixes whose Lyndon prefixes (up to the next smaller
suffix) are equal are a group, found by taking groups from the greatest down and letting each lengthen the
words of the previous smaller suffixes of its members.  The same pointers then give each group's order: a
suffix that has its place passes the one before it, and from there along the pointers, to the front of
their groups.  Nothing is renamed and no smaller problem is solved first.

Hashes are of 64 bits, over bytes replaced by random 64-bit numbers.

Edge cases: null text is empty; texts under 100 bytes lose nothing; rows that repeat an id with another
text are ordered by a hash of the text, rows that repeat id and text are one document; null ids stand as the
lowest id; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, text_or_empty

LENGTH = 100
K = 32
COLD = 1024
BLOCK = 9
LOWEST = -(2**63)
U = np.uint64
BYTES = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 2**64)


class Hashes:
    """Hashes of byte ranges of texts, through prefix sums."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, U)

    def of(self, raw: bytes) -> np.ndarray:
        n = len(raw) + 1
        if len(self.power) < n:
            for name, base in (("power", BASE), ("inverse", UNBASE)):
                p = np.full(2 * n, base, U)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=U))
        sums = np.zeros(n, U)
        np.cumsum(BYTES[np.frombuffer(raw, np.uint8)] * self.power[: n - 1], out=sums[1:])
        return sums

    def ranges(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        h = (sums[hi] - sums[lo]) * self.inverse[lo] + (hi - lo).astype(U) * U(0x94D049BB133111EB)
        h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
        return h ^ (h >> U(29))


def anchors(hashes: Hashes, raw: bytes, sums: np.ndarray):
    """(place, hash, first window, last window) of the anchors of a text of LENGTH bytes or more."""
    m, span = len(raw) - K + 1, LENGTH - K + 1
    at = np.arange(m)
    h = hashes.ranges(sums, at, at + K)
    value, place, have = h, at.astype(np.int32), 1
    while have < span:  # the least of `have` values each, doubled
        step = min(have, span - have)
        later = value[step:] < value[:-step]
        place = np.where(later, place[step:], place[:-step])
        value = np.where(later, value[step:], value[:-step])
        have += step
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:], [len(place)])) - 1
    a = place[first].astype(np.int64)
    return a, h[a], first, last


def suffix_order(text: str) -> list[int]:
    """The places of the suffixes of ``text`` in ascending order, in time linear in its length.

    A group holds the suffixes known to start with one word.  Groups are taken from the greatest down; when a
    group's turn comes its word is the Lyndon prefix of its suffixes, and the words of their previous smaller
    suffixes grow by it: these move to a group of their own just above, once for each time the word comes."""
    n = len(text)
    letters = sorted(set(text))
    number = {c: g for g, c in enumerate(letters)}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    below, above = list(range(-1, len(letters) - 1)), list(range(1, len(letters) + 1))
    before, known = [-1] * n, bytearray(n)  # previous smaller suffix
    g, lowest = len(letters) - 1, 0 if letters else -1
    while g >= 0:
        # Members that have moved up stay in the list of their old group.
        members[g] = own = [i for i in members[g] if group[i] == g]
        higher: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and known[j]:
                j = before[j]
            before[i] = j
            known[i] = 1
            if j >= 0:
                h = group[j]
                to = higher.get(h)
                if to is None:
                    to = higher[h] = len(members)
                    members.append([])
                    below.append(h)
                    above.append(above[h])
                    below[above[h]] = to  # g is above h, so there is one above
                    above[h] = to
                members[to].append(j)
                group[j] = to
        g = below[g]
    front, start, g = [0] * len(members), 0, lowest
    while start < n:
        front[g] = start
        start += len(members[g])
        g = above[g]
    order, placed = [-1] * n, bytearray(n)
    i, j = 0, n - 1
    while True:
        while j >= 0 and not placed[j]:
            g = group[j]
            order[front[g]] = j
            front[g] += 1
            placed[j] = 1
            j = before[j]
        if i == n:
            return order
        j = order[i] - 1
        i += 1


def settle(contexts: list[tuple[str, str, int, int]]) -> list[tuple[int, int, int]]:
    """(context, first offset, last offset) of the windows that an earlier context has.

    Contexts of one anchor, in order of their first places: the bytes before it from the nearest on, the
    bytes after it, and the least and greatest offset of its windows (the anchor's place less theirs)."""
    rest = LENGTH - K
    lefts, rights = [c[0] for c in contexts], [c[1] for c in contexts]
    cl, cr = len(commonprefix(lefts)), len(commonprefix(rights))

    def unlike(parts):
        """Lengths up to which a part is like another."""
        by = sorted(range(len(parts)), key=parts.__getitem__)
        like = [0] * len(parts)
        for a, b in zip(by, by[1:], strict=False):
            n = len(commonprefix((parts[a], parts[b])))
            like[a], like[b] = max(like[a], n), max(like[b], n)
        return like

    ll, lr = unlike(lefts), unlike(rights)
    text, anchor = [], []
    size = 0
    for k, (left, right, _, _) in enumerate(contexts):
        part = left[cl : ll[k]][::-1] + "ā" + right[cr : lr[k]] + "Ā"
        anchor.append(size + max(ll[k] - cl, 0))
        text.append(part)
        size += len(part)
    joined = "".join(text)
    order = suffix_order(joined)
    rank = [0] * size
    for r, p in enumerate(order):
        rank[p] = r
    marked = [[] for _ in contexts]
    for r in range(rest + 1):
        live = [k for k, c in enumerate(contexts) if c[2] <= r <= c[3] and r <= ll[k] and rest - r <= lr[k]]
        if len(live) < 2:
            continue
        back = max(r - cl, 0)
        width = back + 1 + max(rest - r - cr, 0)
        live.sort(key=lambda k: rank[anchor[k] - back])
        run = [live[0]]
        for k in live[1:] + [None]:
            if k is not None and joined[anchor[k] - back : anchor[k] - back + width] == joined[anchor[run[0]] - back : anchor[run[0]] - back + width]:
                run.append(k)
                continue
            first = min(run)
            for x in run:
                if x != first:
                    marked[x].append(r)
            run = [k]
    out = []
    for k, rs in enumerate(marked):
        s = 0
        for e in range(1, len(rs) + 1):
            if e == len(rs) or rs[e] != rs[e - 1] + 1:
                out.append((k, rs[s], rs[e - 1]))
                s = e
    return out


def anchor_rows(texts: DataFrame) -> DataFrame:
    """(doc, tie, anchor, context, at, repeat): an anchor of each text; repeat: an earlier row of the batch has its context.

    ``at`` packs the anchor's place, how far before it its first window starts, and how many more it has."""

    def run(batches):
        hashes = Hashes()
        for b in batches:
            doc, tie, raws = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            parts = []
            for d, t, raw in zip(doc, tie, raws, strict=True):
                if len(raw) >= LENGTH:
                    sums = hashes.of(raw)
                    a, h, lo, hi = anchors(hashes, raw, sums)
                    start, stop = np.maximum(a + K - LENGTH, 0), np.minimum(a + LENGTH, len(raw))
                    c = hashes.ranges(sums, start, stop) ^ (a - start).astype(U) * U(0xD6E8FEB86659FD93)
                    parts.append((np.full(len(a), d), np.full(len(a), t), h.view(np.int64), c.view(np.int64), a << 16 | (a - lo) << 8 | (hi - lo)))
            if parts:
                cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
                by = np.lexsort((cols[4], cols[1], cols[0], cols[3], cols[2]))
                cols = [c[by] for c in cols]
                new = np.concatenate(([True], (cols[2][1:] != cols[2][:-1]) | (cols[3][1:] != cols[3][:-1])))
                first = np.flatnonzero(new)[np.cumsum(new) - 1]
                repeat = np.any([c != c[first] for c in (cols[0], cols[1], cols[4])], axis=0)  # a row that repeats id and text is the same document
                apart = cols[2].view(U) ^ (cols[0].view(U) * U(BASE) + cols[4].astype(U)) * U(0xD6E8FEB86659FD93)
                cols[2] = np.where(repeat, apart.view(np.int64), cols[2])
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(repeat)], names=["doc", "tie", "anchor", "context", "at", "repeat"])

    return texts.mapInArrow(run, "doc bigint, tie bigint, anchor bigint, context bigint, at bigint, repeat boolean")


def windows_of(at):
    """(first, last) window of a packed anchor."""
    lo = F.shiftright(at, 16) - F.shiftright(at, 8).bitwiseAND(F.lit(255))
    return lo.cast("int").alias("lo"), (lo + at.bitwiseAND(F.lit(255))).cast("int").alias("hi")


def with_bytes(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, doc, tie, place, lo, hi, before, after): the bytes around the anchors asked for; before from the nearest on."""
    per = wanted.groupBy("doc", "tie").agg(F.collect_set(F.struct("anchor", "at", "many")).alias("at"))

    def run(batches):
        for b in batches:
            rows = []
            for d, t, raw, at in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                for x in at:
                    p = x["at"] >> 16
                    lo = p - (x["at"] >> 8 & 255)
                    rows.append((x["anchor"], d, t, p, lo, lo + (x["at"] & 255), x["many"], raw[max(p + K - LENGTH, 0) : p][::-1], raw[p + K : p + LENGTH]))
            for i in range(0, len(rows), 50_000):
                cols = list(zip(*rows[i : i + 50_000], strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["anchor", "doc", "tie", "place", "lo", "hi", "many", "before", "after"])

    # All columns of the texts are taken, so that one exchange of them serves every join by (doc, tie).
    return texts.join(per, ["doc", "tie"]).select("doc_id", "doc", "tie", "raw", "at").mapInArrow(run, "anchor bigint, doc bigint, tie bigint, place int, lo int, hi int, many bigint, before binary, after binary")


def settled(contexts: DataFrame) -> DataFrame:
    """(doc, tie, lo, hi): windows that repeat, of anchors with up to COLD contexts."""

    def run(batches):
        left = None
        for b in batches:
            t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            key = t.column("anchor").to_numpy()
            last = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
            if last:
                yield from work(t.slice(0, last))
            left = t.slice(last)
        if left is not None and left.num_rows:
            yield from work(left)

    def work(t):
        key = t.column("anchor").to_numpy()
        cols = [t.column(c).to_pylist() for c in ("doc", "tie", "place", "lo", "hi", "before", "after")]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        out = []
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            # A row repeated in the table comes twice.
            own = [k for k in range(s, e) if k == s or any(cols[c][k] != cols[c][k - 1] for c in range(3))]
            group = [(cols[5][k].decode("latin-1"), cols[6][k].decode("latin-1"), cols[2][k] - cols[4][k], cols[2][k] - cols[3][k]) for k in own]
            out += [(cols[0][own[k]], cols[1][own[k]], cols[2][own[k]] - hi, cols[2][own[k]] - lo) for k, lo, hi in settle(group)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc", "tie", "lo", "hi"])

    return contexts.repartition("anchor").sortWithinPartitions("anchor", "doc", "tie", "place").mapInArrow(run, "doc bigint, tie bigint, lo int, hi int")


def blocks_of(contexts: DataFrame) -> DataFrame:
    """A row for each block of windows of a context, with its longer anchor and its own context; repeat as in ``anchor_rows``."""
    rest = LENGTH - K
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())

    def run(batches):
        for b in batches:
            rows, hashed = [], []
            for anchor, d, t, p, lo, hi, before, after in zip(*(b.column(c).to_pylist() for c in ("anchor", "doc", "tie", "place", "lo", "hi", "before", "after")), strict=True):
                for least in range((p - hi) // BLOCK * BLOCK, p - lo + 1, BLOCK):
                    most = min(least + BLOCK - 1, rest)
                    a, z = max(least, p - hi), min(most, p - lo)
                    left, right = before[:z], after[: rest - a]
                    # What blocks hold beyond the longer anchor differs in length at the ends of texts only.
                    core = xxhash.xxh3_64_intdigest(before[:least] + after[: rest - most], anchor & (1 << 64) - 1 ^ least)
                    hashed.append((core, xxhash.xxh3_64_intdigest(left + right, z << 8 | a)))
                    rows.append((d, t, p, p - z, p - a, left, right))
            if rows:
                cols = list(zip(*rows, strict=True))
                anchor, context = np.array(hashed, U).T
                place = [np.array(c, np.int64) for c in cols[:3]]
                by = np.lexsort((*place[::-1], context, anchor))
                new = np.concatenate(([True], (anchor[by][1:] != anchor[by][:-1]) | (context[by][1:] != context[by][:-1])))
                first = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
                repeat = np.zeros(len(by), bool)
                repeat[by] = np.any([c[by] != c[first] for c in place], axis=0)
                apart = anchor ^ (place[0].view(U) * U(BASE) + place[2].astype(U)) * U(0xD6E8FEB86659FD93)
                anchor = np.where(repeat, apart, anchor).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(context.view(np.int64)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(repeat)],
                    names=["anchor", "context", "doc", "tie", "place", "lo", "hi", "before", "after", "repeat"],
                )

    return contexts.mapInArrow(run, "anchor bigint, context bigint, doc bigint, tie bigint, place int, lo int, hi int, before binary, after binary, repeat boolean")


def window_rows(contexts: DataFrame) -> DataFrame:
    """(window, doc, tie, lo): a hash of each window of an anchor with many contexts."""

    def run(batches):
        hashes = Hashes()
        for b in batches:
            anchor, doc, tie = (b.column(i).to_numpy() for i in range(3))
            place, lo, hi = (b.column(i).to_numpy() for i in (3, 4, 5))
            parts = []
            for k, (before, after) in enumerate(zip(b.column(6).to_pylist(), b.column(7).to_pylist(), strict=True)):
                raw = before[::-1] + after  # the anchor between them is the same for all
                at = np.arange(lo[k], hi[k] + 1)
                s = at - place[k] + len(before)
                h = hashes.ranges(hashes.of(raw), s, s + LENGTH - K) ^ anchor[k].view(U) ^ (place[k] - at).astype(U) * U(0xD6E8FEB86659FD93)
                parts.append((h.view(np.int64), np.full(len(at), doc[k]), np.full(len(at), tie[k]), at.astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["window", "doc", "tie", "lo"])

    return contexts.mapInArrow(run, "window bigint, doc bigint, tie bigint, lo int")


def repeated(texts: DataFrame) -> DataFrame:
    """(doc, tie, lo, hi): ranges of windows that start earlier elsewhere; ``texts`` has doc_id, doc, tie, raw."""
    rows = anchor_rows(texts.select("doc", "tie", "raw"))
    at = Window.partitionBy("anchor", "context").orderBy("doc", "tie", "at")
    by_context = Window.partitionBy("anchor").orderBy("context")
    many = rows.withColumn("nth", F.dense_rank().over(at)).withColumn("_c", F.dense_rank().over(by_context)).withColumn("many", F.max("_c").over(Window.partitionBy("anchor")).cast("long"))
    again = F.col("repeat") | (F.col("nth") > 1)
    many = cut(many.where(again | (F.col("many") > 1)).select("anchor", "doc", "tie", "at", "many", again.alias("again")))
    wanted = many.where("not again")
    cold = settled(with_bytes(texts, wanted.where(F.col("many") <= COLD)))
    blocks = blocks_of(with_bytes(texts, wanted.where(F.col("many") > COLD)))
    blocks = blocks.withColumn("nth", F.dense_rank().over(Window.partitionBy("anchor", "context").orderBy("doc", "tie", "place")))
    fresh = ~F.col("repeat") & (F.col("nth") == 1)
    sizes = blocks.where(fresh).groupBy("anchor").agg(F.count("*").alias("size")).where("size > 1").withColumnRenamed("anchor", "s")
    shared = blocks.where(fresh).join(sizes, F.col("anchor") == F.col("s"))
    own = ("anchor", "doc", "tie", "place", "lo", "hi", "before", "after")
    parts = [many.where("again").select("doc", "tie", *windows_of(F.col("at"))), blocks.where(~fresh).select("doc", "tie", "lo", "hi")]
    parts += [cold, settled(shared.where(F.col("size") <= COLD).select(*own))]
    windows = window_rows(shared.where(F.col("size") > COLD).select(*own))
    me = F.struct("doc", "tie", "lo")
    first = windows.groupBy("window").agg(F.min(me).alias("first"), F.count("*").alias("n")).where("n > 1").withColumnRenamed("window", "w")
    hot = windows.join(first, F.col("window") == F.col("w")).where(me != F.col("first")).select("doc", "tie", "lo", F.col("lo").alias("hi"))
    return reduce(DataFrame.unionByName, [*parts, hot])


def without_repeats(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, removed spans as (start, end), kept bytes) of every row of ``df`` (doc_id, text)."""
    rows = df.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", "doc", F.xxhash64("text").alias("tie"), F.encode("text", "UTF-8").alias("raw"))
    spans = repeated(rows).groupBy("doc", "tie").agg(F.collect_set(F.struct("lo", "hi")).alias("gone"))
    out = rows.join(spans, ["doc", "tie"], "left").select("doc_id", "raw", "gone")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                sizes, spans, kept = [], [], []
                for raw, gone in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    own = []
                    for lo, hi in sorted((g["lo"], g["hi"] + LENGTH) for g in gone or ()):
                        if own and lo <= own[-1][1]:
                            own[-1] = (own[-1][0], max(hi, own[-1][1]))
                        else:
                            own.append((lo, hi))
                    rest, end = [], 0
                    for lo, hi in own:
                        rest.append(raw[end:lo])
                        end = hi
                    sizes.append(len(raw))
                    spans.append([{"start": lo, "end": hi} for lo, hi in own])
                    kept.append(b"".join((*rest, raw[end:])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return out.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
