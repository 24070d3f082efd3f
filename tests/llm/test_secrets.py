"""Secret scan against Python's own regular expressions; trigram queries against all strings that a pattern makes."""

import hashlib
import re

import numpy as np
import pytest

from quillrank.llm import secret_scan as s


def brute(text):
    found = []
    for n, rule in enumerate(s.RULES):
        for m in re.finditer(rule.pattern.replace("(?i:", "(?ai:"), text or ""):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), n, m.end()))
    return sorted(found)


def expected(doc_id, text):
    found = brute(text)
    say = lambda spans: ",".join(f"{s.RULES[n].name}:{a}:{b}" for a, n, b in spans)
    return (doc_id, *(sum(n == k for _, n, _ in found) for k in range(3)), hashlib.sha256(say(f for f in found if f[1] < 3).encode()).hexdigest(), say(found))


PARTS = [
    *("password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "api-key", "word", "tok", "ſecret", "toKen", "AKIA", "AKIAAKIA", "akia", "deadbeef", "0123456789abcdef", "é", "\U0001f511", "x" * 14, "A1" * 9),
    *('"', "'", " ", "  ", ":", "=", ": ", "= '", "\n", ".", "-", "ghp_" + "a1" * 20, "xoxb-1234567890-ab", "AIza" + "b" * 36, "sk_live_" + "9" * 20, "eyJhbGciOi.eyJzdWIiOi.SflKxwRJSM", "-----BEGIN RSA PRIVATE KEY-----"),
    *("Bearer " + "t" * 24, "https://me:pass@host", "://", "npm_" + "c" * 36, "glpat-" + "d" * 22),
]


def test_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(PARTS, rng.integers(0, 30)))) for i in range(400)]
    rows += [(None, "token=" + "z" * 12), (None, None), (7, None), (8, ""), (9, rows[3][1]), (9, rows[3][1]), (10, "token: secret=abcdefghijklmnop password: token: abcdefghijklmnop"), (11, "0123456789abcdef " * 3000 + "token='abcdefghijkl'"), (12, "a" * 300_000)]
    docs = spark.createDataFrame([(*r, 1, "s", "g") for r in rows], "doc_id long, text string, rules int, spans string, gram string")
    want = sorted((expected(*r) for r in rows), key=repr)
    for bucket in (8192, 32):
        monkeypatch.setattr(s, "BUCKET", bucket)
        assert sorted(map(tuple, s.digests(s.scan(docs)).collect()), key=repr) == want
    assert s.digests(s.scan(docs.limit(0))).count() == 0
    only_full = s.scan(docs, s.BASE[2:]).collect()
    assert sum(len(r["spans"]) for r in only_full) == sum(n == 2 for _, t in rows for _, n, _ in brute(t))


def test_candidates_hold_all_of_a_clause(spark):
    texts = ["my password", "pass word", "passwd and token", "an api_key", "AKIA", "nothing"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = [s.trigram_query(r.pattern) for r in s.BASE[:2]]
    found = s.find_candidates(s.build_index(rows, sorted({g for q in queries for c in q for g in c})), queries)
    keys = rows.withColumn("key", s._row_key())
    assert sorted((r["text"], r["rules"]) for r in keys.join(found, "key").collect()) == [("AKIA", 2), ("an api_key", 1), ("my password", 1), ("passwd and token", 1)]


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("abc", {"abc"}),
        ("abcd|xyz", {"abc bcd", "xyz"}),
        ("ab+c", {""}),
        ("(foo|bar)baz", {"arb bar baz rba", "baz foo oba oob"}),
        ("abc.*xyz", {"abc xyz"}),
        ("a[bc]d?", {""}),
        ("x(abc)?y", {""}),
        ("(?i:ABC)[0-9]+", {"abc"}),
        ("(abc){2}", {"abc bca cab"}),
        ("(abc)+", {"abc"}),
        ("[a-z]+", {""}),
        (r"\bkey\b", {"key"}),
        ("abc|abcd", {"abc"}),
    ],
)
def test_queries(pattern, want):
    assert {" ".join(sorted(c)) for c in s.trigram_query(pattern)} == want
