"""Filter audit, SimHash and spelling variants on edge rows, against SQL and brute force."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
import xxhash
from conftest import compare
from pyspark.sql import functions as F

from planwright.llm import filter_audit, simhash, spelling
from planwright.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NEW = ("op11_filter_audit", "op12_simhash", "op13_spelling")
rng = random.Random(5)
WORDS = ["harbour", "harbor", "colour", "color", "theatre", "theater", "grey", "été", "ÀÉÎõü", "straße", "lantern", "lanterns", "lantrn", "meadow", "meadows", "of", "the"]
LONG = " ".join(rng.choice(WORDS) for _ in range(30_000))


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE = prose(300)


def edited(k):
    w = BASE.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


#: Nulls in every column, empty and blank texts, one to four words, repeated rows and ids, exact and near copies, a long text, junk.
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\x0b\n", "en", "a", 4), (4, "one two", "en", "b", 7), (5, "One TWO", "en", "b", 7), (None, "one two", "en", "b", 7),
    (None, "only here", "en", "c", 9), (None, "only here", "en", "c", 9), (6, BASE, "en", "a", 1), (7, BASE, "en", None, 1), (7, BASE, "en", None, 1), (6, BASE, "en", "a", 1), (8, LONG, "en", "", 1),
    (9, "A1 B2 #C     D", "en", "a", 1), (10, "a|b " * 60, "en", "a", 1), (11, "x" * 20_000 + " " + "ab" * 10_000, "en", "a", 1), (12, "é😀 harbour×÷ HARBOUR", "en", "b", 1), (13, "\xa0", "fr", "b", 1),
    *[(20 + k, edited(k % 9), "en", "abc"[k % 3], 1) for k in range(60)], *[(100 + k, prose(rng.randrange(1, 9)), "en", "d", 1) for k in range(80)],
]
LABELS = [(6, 1, 0), (7, 0, 1), (8, 1, None), (8, None, 1), (None, 1, 1), (999, 1, 1), (21, 1, 1), (21, 1, 1), (22, None, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    clashing = {c: F.lit(7) for c in ("fp", "word", "id", "key", "mask", "part", "n", "least")}
    spark.createDataFrame(ROWS, SCHEMA).withColumns(clashing).repartition(5).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


@pytest.mark.parametrize("name", [n for n in NEW if n in ORACLES])
def test_edge_rows_equal_sql(spark, folder, name):
    compare(spark, name, QUERIES[name], ORACLES[name], folder)


@pytest.mark.parametrize("name", NEW)
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


# -- filter audit


def test_audit_equals_applying_the_filters(spark, folder):
    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any(j is not None and i is not None and j < i and (u or "") == t for j, u, *_ in ROWS)
        return {f for f, no in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t), smaller), strict=True) if no}

    rows = [(i, s or "", fails(i, t or "")) for i, t, _, s, _ in ROWS]
    one = {k: {i for i, *x in LABELS if x[k] == 1 and i is not None} for k in (0, 1)}
    want = {}
    for part in {p for _, p, _ in rows}:
        gone = Counter()
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[1] == part]
            for k, f in enumerate(order):
                out = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                own = [r for r in rows if r[1] == part and f in r[2]]
                gone[f] += len(out)
                want[part, "".join(order), k + 1] = [len(left), len(out), len(own) - len(out), sum(r[2] == {f} for r in own), *(sum(r[0] in one[j] for r in out) for j in (0, 1))]
        for p, order, k in want:
            if p == part:
                want[p, order, k].append(gone[order[k - 1]])
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.op11(spark, folder).collect()}
    assert got == want and len(got) == 600 * 5


def test_repeats_of_a_text_over_many_partitions(spark):
    rows = [(i, "same", "a") for i in range(500)] + [(None, "same", "a")] * 20 + [(i, f"t{i % 7}", "b") for i in range(300)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = filter_audit.failures(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6))
        n = {(r.part, r.e): r["count"] for r in got.groupBy("part", (F.col("mask") >= 16).alias("e")).count().collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert n == {("a", False): 21, ("a", True): 499, ("b", False): 7, ("b", True): 293}


def test_turns_cover_all_orders():
    turns = filter_audit._turns()
    assert len(turns) == 80 and sum(w for *_, w in turns) == 600


# -- SimHash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def brute_components(fps):
    """The least id that each fingerprint of a list of (id, fingerprint) reaches."""
    up = {f: f for _, f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    own = sorted(up)
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return {f: least.get(root(f)) for f in own}


@pytest.mark.parametrize("group", [64, 1])
def test_simhash_equals_brute_force(spark, folder, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    fps = [(i, brute_fingerprint(t)) for i, t, *_ in ROWS]
    least = brute_components(fps)
    want = sorted((str(i), f"{f:016x}", str(least[f])) for i, f in fps)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.op12(spark, folder).collect()) == want
    assert len(set(least.values())) < len(least)  # some link


def test_spark_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("été of the"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("été of the".encode(), 42)


@pytest.mark.parametrize("group", [64, 2])
def test_no_link_of_near_fingerprints_is_lost(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    fps = {0, 2**64 - 1}
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(12):  # walks of one to five bits, within one block and over several
            fps.add(x)
            span = rng.choice([(0, 64), (0, 16), (48, 64), (14, 18)])
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(*span)
    signed = {f - 2**64 if f >> 63 else f: f for f in fps}
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    assert all((signed[r.a] ^ signed[r.b]).bit_count() <= 3 for r in found)
    from planwright.llm.graph import forest

    import numpy as np

    order = sorted(signed)
    at = {s: k for k, s in enumerate(order)}
    got = forest(len(order), np.array([at[r.a] for r in found]), np.array([at[r.b] for r in found]))
    want = brute_components([(at[s], f) for s, f in signed.items()])
    assert {signed[s]: int(got[k]) for k, s in enumerate(order)} == want


def test_long_texts_are_counted_in_slices(monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert simhash.fingerprint(BASE) == brute_fingerprint(BASE)


# -- spelling


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    form, near = {}, {}
    for w in n:
        near[w] = [x for x in n if one_apart(w, x)]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, str(form[w]), root(w), n[w], len(near[w]), str(n.get(form[w]))) for w in n)


def rows_of(df):
    return sorted((r.word, str(r.form), r.root, r.n, r.n_near, str(r.form_n)) for r in df.collect())


def test_spelling_equals_brute_force(spark, folder):
    got = rows_of(spelling.op13(spark, folder))
    assert got == brute_spelling([(i, t) for i, t, *_ in ROWS])
    assert any(r[1] != "None" for r in got)


def test_roots_follow_chains_of_forms(spark):
    words = [("aaaaaa", 6), ("aaaaab", 31), ("aaaabb", 160), ("aaabbb", 900), ("aabbbb", 5000), ("zzzzzz", 5), ("zzzzzzz", 24), ("aaabbbc", 5), ("caabbbb", 5)]
    rows = [(7, " ".join([w] * n)) for w, n in words] + [(8, "zzzzzzz 😀zzzzzzz")]
    got = rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute_spelling(rows)
    assert {r[2] for r in got if r[0].startswith("a")} == {"aabbbb"}


def test_random_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TABLE", 10)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(250)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) ** 1.3 for k in range(250)], k=200))) for i in range(60)]
    got = rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute_spelling(rows)
    assert sum(r[4] for r in got) > 50


def test_keys_are_hashes_of_the_deletions():
    for w in ("abbbc", "éééé", "a", "zyzyzy", "x" * 5000):
        key, lo, hi = spelling.keys_of(w)
        less = {w[:i] + w[i + 1 :]: i for i in range(len(w))}
        assert len(key) == len(less) + 1 and {int(k) for k in key[1:]} == {int(spelling.keys_of(x)[0][0]) if x else 0 for x in less}
        for a, b in zip(lo[1:], hi[1:], strict=True):
            assert len(set(w[a - 1 : b])) == 1
