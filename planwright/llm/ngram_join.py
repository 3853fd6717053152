"""N-gram Jaccard join: documents linked by the likeness of their sets of word shingles.

A set is the distinct 5-word shingles of a text, as sorted 64-bit hashes.  Sets ``x``, ``y`` link when
``|x & y| / |x | y| >= 0.8``; then each holds four fifths of the other's size at least, and in any order
of the shingles one of the first ``n - ceil(0.8 n) + 1`` of ``x`` (its prefix) is also in the prefix of ``y``.

1. Documents with equal sets (128-bit names) are one class; all that follows is about classes.
2. Prefixes follow the order of hashes, but for frequent shingles, which come last: every task keeps
   ``HEAVY`` counters of the shingles it reads, and the ``HOT`` most frequent of all become a list of
   bounded size.  A passage that many documents share is thus in few prefixes.  Any list gives the same links.
3. Prefix shingles that only one class has are dropped.  Of the classes that hold another one, the first and
   the one with most of its prefix shared are its centres; every other one that the bitmaps allow to link with
   a centre is joined to it, and the components of these pairs are the first groups.  Shingles whose classes
   are all in one group are done.
4. The classes that share another shingle form tiles by bands of sizes, each band with the next lower one
   beside it; equal tiles of up to ``COLD`` classes are one.  Of more than ``BLOCK`` classes, those of the most
   frequent group meet the others in blocks; where the others are more than a block too, all meet in pairs
   of blocks.  Within a tile hashed bitmaps (parities of the shingles' low bits, as many bits as a set has
   shingles) bound the overlap from above: two sets differ in at least as many shingles as their bitmaps in
   bits.  A tile emits a spanning forest of the pairs of different groups whose bound allows a link.
5. The groups joined by those pairs get the whole sorted arrays, in blocks with ``LEADERS`` classes of the
   group in each.  Pairs not yet joined in the block pass the bitmap bound and then the exact intersection.
   What a large group's main component leaves out meets every block of the group once more.
6. Components of the links, distributed, give each class its least document.

No candidate is dropped or capped, so no link between components is lost.  Links are exact up to equal
64-bit hashes of different shingles; pairs that are joined already are not verified, so components come
out and numbers of links do not.  Sets travel once a block, never once a pair.

Edge cases: null and empty texts and those without words have the empty set and link with nothing; fewer
than five words are one shingle; repeated rows are one class; rows with a null id link like others and come
back with the least id of their component that is not null (null only if it has none); an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, small, text_batches, text_or_empty
from .graph import components, forest, stars

WORDS = 5
SHARE = (4, 5)  # 0.8
COLD, BLOCK, LEADERS = 64, 512, 8
HEAVY, HOT = 1 << 16, 1 << 18
#: Rows of two or three numbers that may be broadcast, once counted; beyond, Spark shuffles the texts once.
LOOKUP = 400_000
TABLE = 120_000  # words that a task keeps, some 20 MB
LOWEST = -(2**63)


class Shingles:
    """Sorted distinct shingle hashes of texts; A-Z are lower-cased, words end at ASCII blanks."""

    def __init__(self):
        self.table: dict[bytes, int] = {}

    def of(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.table) > TABLE:
            self.table.clear()
        for w in set(words).difference(self.table):
            self.table[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(self.table.__getitem__, words), np.uint64, len(words))
        k = min(WORDS, len(h))
        s = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):  # mixed after each word, so that order counts
            s = (s ^ h[j : len(h) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(29)
        return np.unique(s)


def prefix_length(n: int) -> int:
    return n - -(-SHARE[0] * n // SHARE[1]) + 1 if n else 0


def bits_for(n: int) -> int:
    """Width of a bitmap: a power of two of at least ``n`` bits, 64 at least."""
    return max(64, 1 << (n - 1).bit_length())


def bitmap(s: np.ndarray) -> np.ndarray:
    m = bits_for(len(s))
    odd = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def class_name(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def mark():
    return F.xxhash64(text_or_empty()).alias("mark")


class Frequent:
    """Counts of the most frequent of many numbers, each too low by ``short`` at most."""

    def __init__(self, most: int):
        self.most, self.short = most, 0
        self.key, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, numbers: np.ndarray) -> None:
        new, n = np.unique(numbers, return_counts=True)
        self.key, at = np.unique(np.concatenate([self.key, new]), return_inverse=True)
        self.n = np.bincount(at, np.concatenate([self.n, n]), len(self.key)).astype(np.int64)
        if len(self.key) > self.most:
            least = int(np.partition(self.n, -self.most - 1)[-self.most - 1])
            kept = self.n > least
            self.key, self.n, self.short = self.key[kept], self.n[kept] - least, self.short + least


def frequent(df: DataFrame) -> np.ndarray:
    """The sorted hashes of at most HOT shingles that the most texts hold."""

    def run(batches):
        shingles, counts, waiting, size = Shingles(), Frequent(HEAVY), [], 0
        for b in batches:
            for t in b.column(0):
                waiting.append(shingles.of(t.as_py()))
                size += len(waiting[-1])
                if size >= 1_000_000:
                    counts.add(np.concatenate(waiting))
                    waiting, size = [], 0
        if waiting:
            counts.add(np.concatenate(waiting))
        kept = counts.n > max(1, counts.short)
        yield pa.RecordBatch.from_arrays([pa.array(counts.key[kept].view(np.int64)), pa.array(counts.n[kept])], names=["key", "n"])

    found = df.select(text_or_empty().alias("text")).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    top = found.where(F.col("n") > COLD).orderBy(F.desc("n"), "key").limit(HOT).select("key")
    return np.sort(top.toArrow().column(0).to_numpy().view(np.uint64))


def sets(df: DataFrame) -> DataFrame:
    """(doc_id, mark, n, node, prefix, bits): mark is a hash of the text; node names the class of equal sets, null for the empty set.

    Of a class that a task meets again it leaves out the prefix and the bitmap."""
    text_batches(df.sparkSession)
    hot = df.sparkSession.sparkContext.broadcast(frequent(df))

    def order(s):
        k = prefix_length(len(s))
        late = np.zeros(len(s), bool)
        if len(hot.value):
            at = np.minimum(np.searchsorted(hot.value, s), len(hot.value) - 1)
            late = hot.value[at] == s
        return np.concatenate([s[~late], s[late]])[:k].view(np.int64)

    def run(batches):
        shingles, seen = Shingles(), set()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                if len(seen) > TABLE:
                    seen.clear()
                n, node, prefix, bits = [], [], [], []
                for t in part.column(1):
                    s = shingles.of(t.as_py())
                    name = class_name(s)
                    new = name is not None and name not in seen
                    seen.add(name)
                    n.append(len(s))
                    node.append(name)
                    prefix.append(order(s) if new else None)
                    bits.append(bitmap(s).tobytes() if new else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    names=["doc_id", "mark", "n", "node", "prefix", "bits"],
                )

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), mark()).mapInArrow(run, "doc_id bigint, mark bigint, n bigint, node binary, prefix array<bigint>, bits binary")


def band(n):
    """Linked sets are in one band of sizes or in two neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(SHARE[1] / SHARE[0])) + 1e-9).cast("int")


def block(k):
    return F.pmod(F.xxhash64("id"), k).cast("int")


def counted(n):
    return F.ceil(n / BLOCK).cast("int")


def by_tile(df: DataFrame, work, schema: str) -> DataFrame:
    """``work(tile numbers, arrow table)`` over whole tiles, many at a time."""

    def run(batches):
        left = None
        for b in batches:
            t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            tile = t.column("tile").to_numpy()
            last = np.searchsorted(tile, tile[-1], "left") if len(tile) else 0  # sorted within the partition
            if last:
                yield from work(tile[:last], t.slice(0, last))
            left = t.slice(last)
        if left is not None and left.num_rows:
            yield from work(left.column("tile").to_numpy(), left)

    return df.repartition("tile").sortWithinPartitions("tile", "n", "id").mapInArrow(run, schema)


def linkable(n1: np.ndarray, bits1: list[bytes], n2: np.ndarray, bits2: list[bytes]) -> np.ndarray:
    """Whether the bitmaps of each pair allow a link; sizes are known to."""
    most = (n1 + n2) * (SHARE[1] - SHARE[0]) // (SHARE[1] + SHARE[0])  # shingles that linked sets may differ in
    w1, w2 = (np.fromiter(map(len, b), np.int64, len(b)) // 8 for b in (bits1, bits2))
    out = np.zeros(len(n1), bool)
    for a, b in {*zip(w1.tolist(), w2.tolist(), strict=True)}:
        at = np.flatnonzero((w1 == a) & (w2 == b))
        for s in range(0, len(at), 20_000):
            c = at[s : s + 20_000]
            x = np.frombuffer(b"".join(bits1[k] for k in c), np.uint64).reshape(-1, a)
            y = np.frombuffer(b"".join(bits2[k] for k in c), np.uint64).reshape(-1, b)
            out[c] = differences(x, y) <= most[c]
    return out


def differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which rows of bitmaps differ; a bitmap of half the width is the sum of its halves."""
    while y.shape[1] > x.shape[1]:
        y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
    while x.shape[1] > y.shape[1]:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return np.bitwise_count(x ^ y).sum(1)


def possible(tile: np.ndarray, n: np.ndarray, bits: list[bytes], group: np.ndarray, guest: np.ndarray | None = None):
    """Chunks (i, j) of row pairs of one tile whose groups differ and whose sizes and bitmaps allow a link; rows ascend by (tile, n).

    Pairs of two guests are left out; guests are smaller than the other rows of a tile."""
    width = np.fromiter(map(len, bits), np.int64, len(bits)) // 8
    maps = {}
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        m = np.frombuffer(b"".join(bits[k] for k in own), np.uint64).reshape(len(own), w)
        place = np.full(len(bits), -1, np.int64)
        place[own] = np.arange(len(own))
        maps[int(w)] = (m, place)
    alive, lag = np.arange(len(tile)), 1
    while len(alive):
        alive = alive[alive + lag < len(tile)]
        alive = alive[tile[alive] == tile[alive + lag]]
        # Sizes ascend within a tile: once the ratio is too large it stays so.
        alive = alive[n[alive + lag] * SHARE[0] <= n[alive] * SHARE[1]]
        i = alive[group[alive] != group[alive + lag]]
        i = i if guest is None else i[~guest[i + lag]]
        j = i + lag
        found = np.zeros(len(i), bool)
        most = (n[i] + n[j]) * (SHARE[1] - SHARE[0]) // (SHARE[1] + SHARE[0])
        for wi, wj in {*zip(width[i].tolist(), width[j].tolist(), strict=True)}:
            at = np.flatnonzero((width[i] == wi) & (width[j] == wj))
            a, pa_ = maps[wi]
            b, pb = maps[wj]
            for s in range(0, len(at), 20_000):
                c = at[s : s + 20_000]
                found[c] = differences(a[pa_[i[c]]], b[pb[j[c]]]) <= most[c]
        if found.any():
            yield i[found], j[found]
        lag += 1


def linked_to_centres(shared: DataFrame, bits: DataFrame) -> DataFrame:
    """(a, b): classes that share a key with a centre of it, where the bitmaps allow a link.

    The centres of a key are its first class (lo) and the one with the largest part of its prefix shared:
    of near copies that is the one they were made from, or the one with the fewest changes."""
    part = shared.groupBy("id").agg(F.count("*").alias("k")).join(bits.select(F.col("id").alias("i"), "n"), F.col("id") == F.col("i")).select("i", (F.col("k") / F.col("n")).alias("part"))
    hub = F.max(F.struct("part", "id")).over(Window.partitionBy("key"))["id"]
    pairs = shared.join(part, F.col("id") == F.col("i")).select("id", "lo", hub.alias("hub")).select("id", F.explode(F.array("lo", "hub")).alias("centre")).where("id <> centre")
    pairs = pairs.select(F.least("id", "centre").alias("id"), F.greatest("id", "centre").alias("centre")).distinct()
    named = lambda k: bits.select(F.col("id").alias(k), F.col("n").alias(f"{k}_n"), F.col("bits").alias(f"{k}_bits"))
    both = pairs.join(named("x"), F.col("id") == F.col("x")).where("x_n is not null").join(named("y"), F.col("centre") == F.col("y"))
    both = both.where(f"x_n * {SHARE[0]} <= y_n * {SHARE[1]} and y_n * {SHARE[0]} <= x_n * {SHARE[1]}")

    def run(batches):
        for b in batches:
            c = [b.column(k) for k in range(6)]
            ok = pa.array(linkable(c[2].to_numpy(), c[3].to_pylist(), c[4].to_numpy(), c[5].to_pylist()))
            yield pa.RecordBatch.from_arrays([c[0].filter(ok), c[1].filter(ok)], names=["a", "b"])

    return both.select("id", "centre", "x_n", "x_bits", "y_n", "y_bits").mapInArrow(run, "a bigint, b bigint")


def key_tiles(shared: DataFrame) -> DataFrame:
    """(tile, id, n, label, guest) of the classes of different groups that share a key, from rows (key, id, n, label)."""
    # A guest meets the rows of the band above its own; guests meet one another at home.
    place = lambda up: F.struct(F.xxhash64("key", band(F.col("n")) + up).alias("group"), F.lit(bool(up)).alias("guest"))
    rows = shared.withColumn("at", F.explode(F.array(place(0), place(1)))).select("at.*", "id", "n", "label")
    count = rows.groupBy("group", "label").agg(F.count("*").alias("k"), F.min("guest").alias("g"))
    count = count.groupBy("group").agg(F.sum("k").alias("size"), F.count("*").alias("labels"), F.min("g").alias("empty"), F.max(F.struct("k", "label")).alias("main"))
    count = count.where("labels > 1 and not empty").select(F.col("group").alias("c"), "size", F.col("main.label").alias("main"), F.col("main.k").alias("mains"))
    rows = cut(rows.join(count, F.col("group") == F.col("c")).drop("c"))
    cold = rows.where(F.col("size") <= COLD).groupBy("group").agg(F.array_sort(F.collect_list(F.struct("id", "n", "label", "guest"))).alias("m"))
    cold = cold.select("m").distinct().select(F.xxhash64("m").alias("tile"), F.explode("m").alias("x")).select("tile", "x.*")
    rest, k = F.col("size") - F.col("mains"), counted(F.col("size"))
    own = block(k)
    over = lambda f: F.transform(F.sequence(F.lit(0), k - 1), f)
    pairs = over(lambda j: F.xxhash64("group", F.least(own, j), F.greatest(own, j)))
    few = F.when(F.col("label") == F.col("main"), F.array(F.xxhash64("group", own))).otherwise(over(lambda j: F.xxhash64("group", j)))
    hot = rows.where(F.col("size") > COLD).withColumn("tile", F.explode(F.when(F.col("size") <= BLOCK, F.array("group")).when(rest <= BLOCK, few).otherwise(pairs)))
    return cold.unionByName(hot.select("tile", "id", "n", "label", "guest"))


def candidate_links(tiles: DataFrame) -> DataFrame:
    """(a, b): for each tile (tile, id, n, bits, label, guest) a forest of the labels of the pairs that the bitmaps let pass."""

    def work(tile, t):
        label = t.column("label").to_numpy()
        pairs = list(possible(tile, t.column("n").to_numpy(), t.column("bits").to_pylist(), label, t.column("guest").to_numpy()))
        if pairs:
            a, b = stars(*(label[np.concatenate([p[k] for p in pairs])] for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return by_tile(tiles, work, "a bigint, b bigint")


def exact_links(tiles: DataFrame) -> DataFrame:
    """(a, b, large): each row of a tile (tile, id, n, label, large, shingles) that links, b, with the least id that it reaches in the tile.

    Rows of one label are joined already."""

    def work(tile, t):
        ids, n = t.column("id").to_numpy(), t.column("n").to_numpy()
        own = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        up = list(range(len(ids)))

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        a, b = [], []
        for i, j in possible(tile, n, [bitmap(s).tobytes() for s in own], t.column("label").to_numpy()):
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                rx, ry = root(x), root(y)
                if rx != ry:
                    both = len(np.intersect1d(own[x], own[y], assume_unique=True))
                    if SHARE[1] * both >= SHARE[0] * (n[x] + n[y] - both):
                        up[max(rx, ry)] = min(rx, ry)
                        a.append(x)
                        b.append(y)
        if a:
            label = forest(len(ids), np.array(a), np.array(b))
            at = np.flatnonzero(np.bincount(label, minlength=len(ids))[label] > 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[label[at]]), pa.array(ids[at]), t.column("large").take(pa.array(at)).combine_chunks()], names=["a", "b", "large"])

    return by_tile(tiles, work, "a bigint, b bigint, large boolean")


def whole_sets(df: DataFrame) -> DataFrame:
    """(node, shingles as bytes) of each row that has a set."""

    def run(batches):
        shingles = Shingles()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                own = [s for t in b.column(0).slice(lo, 500) if len(s := shingles.of(t.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array(map(class_name, own), pa.binary()), pa.array((s.tobytes() for s in own), pa.binary())], names=["node", "shingles"])

    return df.select(text_or_empty().alias("text")).mapInArrow(run, "node binary, shingles binary")


def group_components(held: DataFrame) -> DataFrame:
    """(node, component) of all that links within a group of ``held`` (id, n, group, size, shingles)."""
    own, is_large = block(counted(F.col("size"))), F.col("size") > BLOCK
    over = lambda k, f: F.transform(F.sequence(F.lit(0), k - 1), f)
    first = F.row_number().over(Window.partitionBy("group").orderBy("id"))
    leaders = held.select("id", "group", "size").where(is_large).withColumn("r", first).where(F.col("r") <= LEADERS).select(F.col("id").alias("l"))
    dealt = held.join(leaders, F.col("id") == F.col("l"), "left")
    dealt = dealt.withColumn("tile", F.explode(F.when(F.col("l").isNull(), F.array(F.xxhash64("group", own))).otherwise(over(counted(F.col("size")), lambda j: F.xxhash64("group", j)))))
    found = cut(exact_links(dealt.select("tile", "id", "n", F.col("id").alias("label"), is_large.alias("large"), "shingles")))
    whole = found.where("not large").select(F.col("b").alias("node"), F.col("a").alias("component"))
    large = cut(held.where(is_large).select("id", "n", "group", "size"))
    if large.isEmpty():
        return whole
    # Where a large group is not one component, what is outside the main one meets every block.
    links = found.where("large").select("a", "b")
    named = large.join(components(links), F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("component", "id"))
    named = cut(named.select("id", "n", "group", "size", "part"))
    part = named.groupBy("group", "part").agg(F.count("*").alias("k")).groupBy("group").agg(F.max(F.struct("k", "part")).alias("main"), F.sum("k").alias("all"))
    part = part.where("main.k < all").select(F.col("group").alias("g"), F.col("main.part").alias("main"), (F.col("all") - F.col("main.k")).alias("rest"))
    again = cut(named.join(part, F.col("group") == F.col("g")).select(F.col("id").alias("i"), F.col("part").alias("label"), "group", "size", "main", "rest"))
    if not again.isEmpty():
        held = held.select("id", "n", "shingles").join(again, F.col("id") == F.col("i"))
        few = block(counted(F.col("rest")))
        as_any = over(counted(F.col("rest")), lambda j: F.xxhash64("group", j, own))
        as_rest = F.when(F.col("label") != F.col("main"), over(counted(F.col("size")), lambda j: F.xxhash64("group", few, j))).otherwise(F.array().cast("array<bigint>"))
        held = held.withColumn("tile", F.explode(F.array_union(as_any, as_rest)))
        links = links.unionByName(cut(exact_links(held.select("tile", "id", "n", "label", F.lit(True).alias("large"), "shingles")).select("a", "b")))
    return whole.unionByName(components(links))


def placed(df: DataFrame) -> DataFrame:
    """(doc_id, mark, n, node, first, component) of every row of ``df`` (doc_id, text).

    ``first`` is the least id of the row's component that is not null; ``component`` names it by one of its classes, so that
    components with equal least ids stay apart.  Rows without a set have neither."""
    rows = cut(sets(df))
    key = F.coalesce("doc_id", F.lit(LOWEST))
    # The least of the equal rows of a class stands for it.
    classes = rows.where("node is not null").groupBy("node").agg(F.min(F.struct(key.alias("k"), "mark")).alias("row"), F.first("n").alias("n"), F.min("doc_id").alias("low"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("id"), "node", "n", F.col("row.k").alias("least"), "row.mark", "low"))
    name = classes.select("id", F.col("node").alias("c"))
    wide = rows.where("prefix is not null").join(name, F.col("node") == F.col("c")).dropDuplicates(["node"])
    over = Window.partitionBy("key")
    keys = wide.select(F.explode("prefix").alias("key"), "id").withColumns({"lo": F.min("id").over(over), "hi": F.max("id").over(over)})
    shared = cut(keys.where("lo < hi"))
    asked = shared.select(F.col("id").alias("s")).distinct()
    bits = cut(wide.select("id", "n", "bits").join(asked, F.col("id") == F.col("s"), "left_semi"))
    near = cut(linked_to_centres(shared, bits))
    group = components(near).select(F.col("node").alias("g"), F.col("component").alias("label"))
    info = cut(bits.select("id", "n").join(group, F.col("id") == F.col("g"), "left").select(F.col("id").alias("i"), "n", F.coalesce("label", "id").alias("label")))
    open_ = shared.join(info, F.col("id") == F.col("i")).select("key", "id", "n", "label").withColumns({"lo": F.min("label").over(over), "hi": F.max("label").over(over)})
    tiles = key_tiles(open_.where("lo < hi").select("key", "id", "n", "label"))
    tiles = tiles.join(bits.select(F.col("id").alias("b"), "bits"), F.col("id") == F.col("b")).select("tile", "id", "n", "bits", "label", "guest")
    joined = components(cut(candidate_links(tiles))).select(F.col("node").alias("l"), "component")
    groups = info.join(joined, F.col("label") == F.col("l"), "left").select(F.col("i").alias("g"), F.coalesce("component", "label").alias("group"))
    size = groups.groupBy("group").agg(F.count("*").alias("size")).where("size > 1").withColumnRenamed("group", "gc")
    member = groups.join(size, F.col("group") == F.col("gc")).select("g", "group", "size")
    member = cut(classes.join(member, F.col("id") == F.col("g")).select("id", F.col("node").alias("c"), "n", "least", F.col("mark").alias("m"), "group", "size"))
    # Only the rows that stand for a class with candidates are read again.
    same = (F.coalesce(df["doc_id"].cast("long"), F.lit(LOWEST)) == F.col("least")) & (mark() == F.col("m"))
    again = df.join(small(member.select("least", "m"), LOOKUP), same, "left_semi")
    held = whole_sets(again).join(member, F.col("node") == F.col("c")).dropDuplicates(["node"]).select("id", "n", "group", "size", "shingles")
    joined = group_components(held).withColumnRenamed("node", "x")
    least = joined.join(classes.select("id", "low"), F.col("x") == F.col("id")).select("x", "component", "low")
    first = least.groupBy("component").agg(F.min("low").alias("first")).withColumnRenamed("component", "fc")
    least = cut(least.join(first, F.col("component") == F.col("fc")).select("x", "component", "first"))
    full = classes.join(least, F.col("id") == F.col("x"), "left")
    full = full.select(F.col("node").alias("o"), F.coalesce("first", "low").alias("first"), F.coalesce("component", "id").alias("component"))
    return rows.select("doc_id", "mark", "n", "node").join(full, F.col("node") == F.col("o"), "left").drop("o")


def linked(df: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``df`` (doc_id, text)."""
    first = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first"))
    return placed(df).select("doc_id", F.col("n").alias("n_shingles"), first.alias("component_id"))


def distinct_documents(df: DataFrame) -> DataFrame:
    """``df`` with one row of each component: that of the least id (null first); of rows that repeat it, the least text.

    A row is known by its id and the hash of its text, so rows of one id with different texts go their own
    ways.  Of equal rows the least in its other columns stays.  Rows without a set are components of their
    own and all stay.  Other columns may have any name: rows are carried as one struct.  The texts are shuffled only where more than LOOKUP rows go, and then once, and once
    more where as many rows of a least id differ in text."""
    own = [F.col(f"`{c}`") for c in df.columns]
    rows = cut(placed(df.select("doc_id", "text")).where("node is not null").groupBy("component", "doc_id", "mark").agg(F.count("*").alias("times")))
    # Only components of several rows lose any.
    many = rows.groupBy("component").agg(F.sum("times").alias("size"), F.min(F.struct("doc_id")).alias("least")).where("size > 1").select(F.col("component").alias("c"), "least")
    could = F.col("doc_id").eqNullSafe(F.col("least.doc_id"))
    rows = cut(rows.join(many, F.col("component") == F.col("c")).select("component", F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), "times", could.alias("could")))
    same = F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_mark") == F.col("_m"))
    marked = df.select(F.struct(*own).alias("_row"), F.col("doc_id").cast("long").alias("_id"), mark().alias("_mark"), text_or_empty().alias("_t"))
    # Where rows of the least id differ in text, the texts decide.
    tied = rows.where("could").groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    tied = small(cut(rows.where("could").join(tied, "component", "left_semi").select("component", "_d", "_m")), LOOKUP)
    texts = marked.select("_id", "_mark", "_t").join(tied, same)
    won = texts.groupBy("component").agg(F.min(F.struct("_t", "_mark")).alias("w")).select(F.col("component").alias("c"), F.col("w._mark").alias("won"))
    rows = rows.join(cut(won), F.col("component") == F.col("c"), "left").withColumn("stays", F.col("could") & F.coalesce(F.col("_m") == F.col("won"), F.lit(True)))
    told = small(cut(rows.where("not stays or times > 1").select("_d", "_m", F.col("stays").alias("_again"))), LOOKUP)
    marked = marked.select("_row", "_id", "_mark").join(told, same, "left")
    again = marked.where("_again").groupBy("_id", "_mark").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*")
    return marked.where("_again is null").select("_row.*").unionByName(again)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir).select("doc_id", "text"))


OP3_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
t AS (SELECT k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM d),
s AS (SELECT k, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM t),
e AS (SELECT k, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.k AS x, b.k AS y, count(*) AS i, any_value(a.n) AS nx, any_value(b.n) AS ny FROM e a JOIN e b USING (g) WHERE a.k < b.k GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * i >= 80 * (nx + ny - i)),
b AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT k AS v, k AS m FROM d UNION SELECT b.y, r.m FROM r JOIN b ON b.x = r.v),
c AS (SELECT r.v, min(d.doc_id) AS least FROM r JOIN d ON d.k = r.m GROUP BY r.v)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.least AS component_id FROM s JOIN c ON c.v = s.k
"""
