"""Secret scan with a trigram index, in DataFrame functions only.

Each rule is a regular expression. From its syntax tree follows a Boolean query: an OR of clauses, each the AND of trigrams (in lower case)
that a text must hold for the rule to match by that clause. A rule with a clause without trigrams has none, and scans every text fully.

The index has a posting list for each trigram of the queries and each bucket of documents: the sorted keys of the documents that hold it. A clause's
candidates are the intersection of its trigrams' lists, smallest first, bucket by bucket; a rule's are the union over its clauses. Buckets hold some BUCKET documents
however many there are, so no list grows with the corpus. A key is a hash of the row; rows that share one share their candidates,
which can only add some. A text is then searched by those rules alone whose candidate it is, and by those that scan fully.

Matches are leftmost and do not overlap within a rule. Their places follow from the lengths of the matches and of what stands between them, summed
in chunks, so that the work is nearly in proportion to the number of matches.

Null and empty texts hold nothing. Repeated rows and rows without an id get a row each. An empty table gives no rows. Texts of any length are
searched whole. Columns other than the id and the text are not read, whatever their names. Places count code points from 0, ends are exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as kind
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written


@dataclass(frozen=True)
class Rule:
    """name; pattern; group and least: a match stands if that group has so many characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
]
# Public formats of tokens and keys.
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("bearer", r"(?i:bearer) +[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("url", r"://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/@]{3,64}@"),
]
RULES = [*BASE, *MORE]
BUCKET, MOST_STRINGS, MOST_CLAUSES, CHUNK = 8192, 64, 64, 64
Query = frozenset[frozenset[str]]
ALWAYS: Query = frozenset([frozenset()])


def _least(clauses) -> Query:
    """Without clauses that another one implies."""
    clauses = frozenset(clauses)
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _all_of(strings: set[str]) -> Query:
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _both(a: Query, b: Query) -> Query:
    out = _least(x | y for x in a for y in b)
    return out if len(out) <= MOST_CLAUSES else a


def _item(op, value) -> tuple[set[str] | None, Query]:
    """The strings that a node matches, where they are few, and what a text must hold."""
    if op is kind.LITERAL:
        return {chr(value).lower()}, ALWAYS
    if op is kind.IN:
        chars: set[str] = set()
        for what, v in value:
            if what is kind.LITERAL:
                chars.add(chr(v).lower())
            elif what is kind.RANGE and v[1] - v[0] < 8:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None, ALWAYS
        return (chars, ALWAYS) if len(chars) <= 8 else (None, ALWAYS)
    if op is kind.SUBPATTERN:
        return _sequence(value[-1])
    if op is kind.BRANCH:
        parts = [_sequence(b) for b in value[1]]
        exact = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
        return exact, _least(c for p in parts for c in p[1])
    if op in (kind.MAX_REPEAT, kind.MIN_REPEAT):
        low, high, of = value
        exact, need = _sequence(of)
        if exact is not None and high <= 8:
            powers, out = {""}, {""} if low == 0 else set()
            for n in range(1, high + 1):
                powers = {a + b for a in powers for b in exact}
                out |= powers if n >= low else set()
                if len(powers) > MOST_STRINGS or len(out) > MOST_STRINGS:
                    return None, need if low else ALWAYS
            return out, ALWAYS
        return None, need if low else ALWAYS
    if op in (kind.AT, kind.ASSERT, kind.ASSERT_NOT):
        return {""}, ALWAYS
    return None, ALWAYS


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    strings, need, whole = {""}, ALWAYS, True
    for op, value in nodes:
        exact, also = _item(op, value)
        if exact is not None and len(strings) * len(exact) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in exact}
        else:  # what comes after may not stand next to what came before
            need, whole = _both(_both(need, _all_of(strings)), _both(also, _all_of(exact) if exact is not None else ALWAYS)), False
            strings = {""}
    need = _both(need, _all_of(strings))
    return (strings if whole else None), need


def trigram_query(pattern: str) -> Query:
    """An OR of ANDs of trigrams; with an empty AND every text may match."""
    return _sequence(_parser.parse(pattern))[1]


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))


def build_index(rows: DataFrame, grams: list[str]) -> DataFrame:
    """gram, bucket, keys: the documents that hold each trigram, as a written table. rows: doc_id and text."""
    buckets = max(1, -(-rows.count() // BUCKET))
    vocabulary = F.array(*map(F.lit, grams))
    # a lambda's argument is computed once; a column inside a lambda, once for each element
    held = F.flatten(F.transform(F.array(F.lower("text")), lambda low: F.filter(vocabulary, lambda g: F.contains(low, g))))
    hits = rows.select(_row_key().alias("key"), F.explode(held).alias("gram"))
    hits = hits.groupBy("gram", F.pmod("key", F.lit(buckets)).alias("bucket"))
    return written(hits.agg(F.sort_array(F.collect_set("key")).alias("keys")), "secret-postings")


def find_candidates(index: DataFrame, queries: list[Query]) -> DataFrame:
    """key, rules: which rows each query (by its number, as a bit) may match, by intersecting posting lists."""
    clauses = [(r, c, gram, len(grams)) for r, q in enumerate(queries) for c, grams in enumerate(sorted(map(sorted, q))) for gram in grams]
    asked = index.sparkSession.createDataFrame(clauses, "rule int, clause int, gram string, need int")  # as large as the rules
    lists = index.join(F.broadcast(asked), "gram").groupBy("bucket", "rule", "clause", "need")
    lists = lists.agg(F.array_sort(F.collect_list(F.struct(F.size("keys").alias("n"), "keys"))).alias("lists")).filter(F.size("lists") == F.col("need"))
    shared = F.aggregate(F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(0))), F.col("lists")[0]["keys"], lambda a, x: F.array_intersect(a, x["keys"]))
    found = lists.select("rule", F.explode(shared).alias("key"))
    return found.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def _places(text: Column, rule: Rule, number: int) -> Column:
    """start, number, end of the rule's matches."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    stands = F.transform(measured, lambda m: F.length(m) >= rule.least)
    gaps = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))), stands, lambda x, ok: F.struct(x["g"].alias("g"), x["m"].alias("m"), ok.alias("ok")))
    span = "struct<start:int,rule:int,end:int>"

    def add(a: Column, x: Column) -> Column:
        start = a["at"] + x["g"]
        new = F.struct(start.alias("start"), F.lit(number).alias("rule"), (start + x["m"]).alias("end"))
        return F.struct((start + x["m"]).alias("at"), F.when(x["ok"], F.concat(a["out"], F.array(new))).otherwise(a["out"]).alias("out"))

    def chunk(a: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(a["at"].alias("at"), F.array().cast(f"array<{span}>").alias("out")), add)
        both = F.transform(F.array(inner), lambda i: F.struct(i["at"].alias("at"), F.concat(a["out"], F.array(i["out"])).alias("out")))
        return F.get(both, F.lit(0))

    def summed(found: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int")), lambda c: F.slice(found, c * CHUNK + 1, CHUNK))
        all_of = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{span}>>").alias("out")), chunk)
        return F.flatten(all_of["out"])

    none = F.array().cast(f"array<{span}>")
    return F.flatten(F.transform(F.array(lengths), lambda found: F.when(F.size(found) > 0, summed(found)).otherwise(none)))


def _long_run(rule: Rule) -> Column:
    """For one class, repeated and of a least length: whether so many stand in a row anywhere. Else true."""
    one_class = rule.least and not rule.group and re.fullmatch(r"\[[^\]\[]+\]\+", rule.pattern)
    return F.col("text").rlike(f"{rule.pattern[:-1]}{{{rule.least}}}") if one_class else F.lit(True)


def scan(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (start, rule, end; by start, then rule's number in rules), a row for each row of docs."""
    rows = _rows(docs, id_col, text_col)
    queries = [trigram_query(r.pattern) for r in rules]
    fully = {r for r, q in enumerate(queries) if frozenset() in q}
    indexed = [frozenset() if r in fully else q for r, q in enumerate(queries)]
    grams = sorted({g for q in indexed for c in q for g in c})
    candidates = written(find_candidates(build_index(rows, grams), indexed), "secret-candidates")
    rows = rows.withColumn("key", _row_key()).join(candidates, "key", "left").select("doc_id", "text", F.coalesce("rules", F.lit(0)).alias("rules"))
    none = F.array().cast("array<struct<start:int,rule:int,end:int>>")
    found = []
    for r, rule in enumerate(rules):
        may = _long_run(rule) if r in fully else F.col("rules").bitwiseAND(F.lit(1 << r)) != 0
        found.append(F.when(may, _places(F.col("text"), rule, r)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def _count(rule: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["rule"] == rule)).cast("long")


def digests(found: DataFrame, rules: list[Rule] = RULES, base: int = len(BASE)) -> DataFrame:
    """doc_id, n_<rule> of the base rules, base_sha256, spans (as kind:start:end, by commas)."""
    names = F.array(*(F.lit(r.name) for r in rules))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rule"]), s["start"], s["end"])), ",")
    counts = [_count(r).alias(f"n_{rules[r].name}") for r in range(base)]
    return found.select("doc_id", *counts, F.sha2(text(F.filter("spans", lambda s: s["rule"] < base)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
