"""Secret scans through a trigram index.

From each rule's regular expression a Boolean trigram query is derived: an OR of sets of trigrams
that every match must contain.  The index holds, for the trigrams that some query asks for, the ids
of the documents whose lower-cased text has them; a document is a candidate of a rule if the postings
of one of its sets all hold it.  Only candidates are searched with the expression itself.  A rule with
a match that needs no trigram (long hexadecimal runs) searches every document.

Everything runs as DataFrame expressions.  Matches come from ``regexp_extract_all``; the text between
them from ``split`` by the same expression, whose lengths add up to code-point positions.

Scale: a posting is one short row for each document and query trigram, a bounded number a document,
grouped by document; the candidates join back by id.

Edge cases: null text is empty and has no spans; rows with a null doc_id skip the index and are
searched by every rule; rows that repeat a doc_id share its postings, which only widens the search;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    least: int  # characters that ``group`` must have
    group: int = 0


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
#: Rules that only add spans; their order is the order of kinds at one start.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("json_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("map_key", r"AIza[A-Za-z0-9_-]+", 39),
)
RULES = BASE + MORE
#: Character classes of up to so many characters are spelt out in a query.
SPELL = 6
CHUNK = 128
PIECE = 256


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Sets of lower-case trigrams of which every match of ``regex`` has one set in full; None if some match may have none."""

    def add(states, chars):
        out = set()
        for tail, need in states:
            for c in chars:
                s = tail + c.lower()
                out.add((s[-2:], need | {s}) if len(s) == 3 else (s, need))
        return out

    def walk(states, items):
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                states = add(states, [chr(arg)])
            elif name == "IN":
                chars = [chr(c) for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1) if str(o) == "RANGE" else range(SPELL + 1))]
                negated = str(arg[0][0]) == "NEGATE"
                states = add(states, chars) if len(chars) <= SPELL and not negated else {("", need) for _, need in states}
            elif name == "SUBPATTERN":
                states = walk(states, arg[3])
            elif name == "BRANCH":
                states = set().union(*(walk(states, branch) for branch in arg[1]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, item = arg
                if (low, high) == (0, 1):
                    states = states | walk(states, item)
                else:
                    for _ in range(min(low, 3)):
                        states = walk(states, item)
                    if low > 3 or high != low:
                        states = {("", need) for _, need in states}
            elif name != "AT":
                states = {("", need) for _, need in states}
        return states

    found = {need for _, need in walk({("", frozenset())}, parser.parse(regex))}
    least = [a for a in found if not any(b < a for b in found)]
    return None if frozenset() in found else sorted(least, key=sorted)


def postings(df: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id): the rows of the index, for the trigrams asked for."""
    low = F.lower(text_or_empty())
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    return df.where("doc_id is not null").select(F.explode(held).alias("trigram"), "doc_id").distinct()


def candidates(df: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, rules): the numbers of the rules whose trigram queries the document answers.

    Each set of a query is an intersection of postings: the documents that stand in the lists of all its trigrams."""
    sets = [(k, n, t, len(s)) for k, r in enumerate(rules) for n, s in enumerate(trigram_query(r.regex) or ()) for t in s]
    asked = df.sparkSession.createDataFrame(sets, "rule int, n int, t string, size int")
    index = postings(df, sorted({t for _, _, t, _ in sets}))
    met = index.join(F.broadcast(asked), F.col("trigram") == F.col("t"))  # a row for each trigram of the rules
    met = met.groupBy("doc_id", "rule", "n").agg(F.count("*").alias("lists"), F.first("size").alias("size")).where("lists = size")
    return met.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, op, zero: Column) -> Column:
    """``op`` of all values up to each one, in chunks, so that the work stays near linear in their number."""

    def rows(v):
        chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / CHUNK).cast("int") - 1), lambda c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK)))
        return bound(chunks, lambda own: bound(F.transform(own, lambda c: F.reduce(c, zero, op)), lambda whole: F.flatten(F.transform(own, lambda c, k: upto(c, F.reduce(F.slice(whole, F.lit(1), k), zero, op))))))

    def upto(chunk, base):
        return bound(base, lambda b: F.transform(chunk, lambda _, j: F.reduce(F.slice(chunk, F.lit(1), j + 1), b, op)))

    return bound(values, lambda v: F.when(F.size(v) > 0, rows(v)).otherwise(F.array().cast("array<int>")))


def rule_spans(text: Column, number: int, rule: Rule) -> Column:
    """Array of (start, kind number, end) of the rule's matches, in code points, end exclusive."""
    regex = F.lit(rule.regex if rule.kind != "hex" else f"[0-9a-f]{{{rule.least},}}")  # the same runs, fewer matches to drop
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    value = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else whole
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def spans(m):
        gaps = F.transform(F.split(text, regex, -1), lambda s: F.char_length(s))
        ends = running(F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda g, x: g + F.char_length(x)), lambda a, b: a + b, F.lit(0))
        rows = F.arrays_zip(ends.alias("end"), m.alias("m"), (value if rule.group else m).alias("v"))
        long = F.filter(rows, lambda x: F.char_length(x["v"]) >= rule.least)
        return F.transform(long, lambda x: F.struct((x["end"] - F.char_length(x["m"])).alias("start"), F.lit(number).alias("kind"), x["end"].alias("end")))

    return bound(whole, lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(none))


def scan(df: DataFrame, rules=RULES, spans: str = "spans") -> DataFrame:
    """``df`` with a column ``spans``: array of (start, kind number, end), by start, then kind; an error if there is one already."""
    if spans in df.columns:
        raise ValueError(f"column exists already: {spans}")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = candidates(df, rules).select(F.col("doc_id").alias("_id"), F.col("rules").alias("_rules"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), text_or_empty().alias("_text"))
    # Null ids find no posting; their own text deals them out over the join's tasks.
    rows = rows.withColumn("_key", F.coalesce(F.col("_row.doc_id").cast("long"), F.xxhash64("_text")))
    joined = rows.join(found, F.col("_key") == F.col("_id"), "left")
    parts = []
    for k, rule in enumerate(rules):
        asked = F.lit(True) if trigram_query(rule.regex) is None else F.col("_row.doc_id").isNull() | F.coalesce(F.array_contains("_rules", k), F.lit(False))
        parts.append(F.when(asked, rule_spans(F.col("_text"), k, rule)).otherwise(none))
    return joined.select("_row.*", F.array_sort(F.concat(*parts)).alias(spans))


def shown(spans: Column, rules=RULES) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(df: DataFrame, mask: str = "[secret]", rules=RULES) -> DataFrame:
    """``df`` with every span's characters replaced: overlapping spans by one mask; n_chars follows.

    Kept text is cut out of blocks of PIECE code points, so that a text of any length is walked through once."""
    if clash := {"_spans", "_new"} & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    scanned = scan(df.withColumn("text", text_or_empty()), rules, "_spans")

    def masked(reach, blocks):
        # A span that starts behind all before it closes a piece of kept text.
        before = F.concat(F.array(F.lit(0)), F.slice(reach, 1, F.size(reach) - 1))
        first = F.filter(F.zip_with("_spans", before, lambda x, b: F.struct(x["start"].alias("start"), b.alias("b"))), lambda x: x["start"] >= x["b"])

        def piece(b, end):
            held = F.array_join(F.slice(blocks, F.floor(b / PIECE).cast("int") + 1, F.floor(end / PIECE).cast("int") - F.floor(b / PIECE).cast("int") + 1), "")
            return F.substring(held, b % PIECE + 1, end - b)

        kept = F.transform(first, lambda x: F.concat(piece(x["b"], x["start"]), F.lit(mask)))
        return F.concat(F.array_join(kept, ""), F.substring(F.col("text"), F.array_max(reach) + 1, F.length("text")))

    reaches = running(F.transform("_spans", lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    done = bound(F.struct(reaches.alias("r"), pieces.alias("p")), lambda x: bound(x["r"], lambda r: bound(x["p"], lambda p: masked(r, p))))
    out = scanned.withColumn("_new", F.when(F.size("_spans") > 0, done).otherwise(F.col("text")))
    again = {"text": F.col("_new")} | ({"n_chars": F.when(F.size("_spans") > 0, F.char_length("_new").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in df.columns else {})
    return out.withColumns(again).select(*[F.col(f"`{c}`") for c in df.columns])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"),
    )


def _op9_sql() -> str:
    quote = lambda s: s.replace("'", "''")
    parts = [
        f"SELECT rid, {k} AS kind, '{r.kind}' AS name, {r.least} AS least, text, regexp_extract_all(text, '{quote(r.regex)}') AS m, "
        f"regexp_extract_all(text, '{quote(r.regex)}', {r.group}) AS v, string_split_regex(text, '{quote(r.regex)}') AS g FROM d"
        for k, r in enumerate(RULES)
    ]
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({' UNION ALL '.join(parts)}),
e AS (SELECT rid, kind, name, least, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g FROM f WHERE len(m) > 0),
p AS (SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS stop FROM e),
s AS (SELECT rid, kind, name || ':' || (stop - length(m)) || ':' || stop AS span, stop - length(m) AS start FROM p WHERE length(v) >= least),
a AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM s GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)
"""


OP9_SQL = _op9_sql()
