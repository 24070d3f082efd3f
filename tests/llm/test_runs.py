"""Runs of words against a search over all starts and periods."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillrank.llm import runs


def brute(words, least_words=6, least_times=4):
    n, found = len(words), []
    for q in range(1, n + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least_words, least_times * q):
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(r for r in found if not any(o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1] for o in found))


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            words, word = words + [word] * (word != ""), ""
        else:
            word += c
    words = planted(doc_id, words)
    found = brute(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=5), st.sampled_from([(6, 4), (2, 2), (1, 3)]))
def test_all_runs(texts, least):
    got = runs.runs_of(np.array([w for t in texts for w in t], np.int64), np.array(list(map(len, texts)), np.int64), *least)
    assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in sorted(brute(t, *least))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.data())
def test_minima(values, data):
    pairs = data.draw(st.lists(st.tuples(st.integers(0, len(values) - 1), st.integers(1, len(values))).filter(lambda p: p[0] < p[1]), max_size=30))
    low, high = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
    assert runs.minima(np.array(values), low, high).tolist() == [min(values[a:b]) for a, b in pairs]


@pytest.mark.parametrize("group_words", [200_000, 50])
def test_rows(spark, monkeypatch, group_words):
    monkeypatch.setattr(runs, "GROUP_WORDS", group_words)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["a", "b", "çé", "d e", " "], rng.integers(0, 60))) + " x y" * int(rng.integers(0, 9) ** 2 // 8)) for i in range(160)]
    rows += [(None, "a " * 9), (None, None), (7, None), (8, ""), (9, " \t\r\n\v\f "), (10, "a\tb\va\fb\ra\nb a b"), (10, "a\tb\va\fb\ra\nb a b"), (11, "w" * 100_000), (1000, "q " * 30_000)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, runs int, kept string")
    got = list(map(tuple, runs.digests(runs.find_runs(docs, planted=True)).collect()))
    assert sorted(map(repr, (r for r in got if r[0] != 1000))) == sorted(repr(expected(*r)) for r in rows[:-1])
    long = [r for r in got if r[0] == 1000 and r[3] == 30_000]
    assert len(long) == 1 and long[0][1:6] == (1, 0, 30_000, 1, 30_000_000)
    assert runs.find_runs(docs.limit(0)).count() == 0


def test_long_text_of_nested_periods():
    unit = [1, 2] * 4 + [3]
    words = np.array(unit * 4000 + list(range(10, 5000)), np.int64)
    got = runs.runs_of(words, np.array([len(words)]), 6, 4)
    assert [tuple(r[1:]) for r in got.tolist() if r[3] == 9] == [(0, 36_000, 9)] and sum(r[3] == 2 for r in got.tolist()) == 4000
