"""Counts and ratios of texts against the stated rules in plain Python."""

import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.functions import linguistics as Z
from quillrank.functions.text import ACTION_VERBS, STOP_WORDS


def expected(text):
    if not text or not text.strip():
        return [None] * 15
    words = re.findall(r"\b[a-zA-Z0-9']+\b", text)
    lettered = [w for w in words if re.search("[a-zA-Z]", w)]
    low = [w.lower() for w in words]
    n, sentences = len(words), sum(bool(p.strip()) for p in re.split("[.!?]+", text))
    chars, marks = len(text.translate({32: None, 10: None})), sum(c in string.punctuation for c in text)
    per = lambda x, y: x / y if y else None
    syllables = per(sum(max(1, len(re.findall("[aeiou]+", w.lower().rstrip("e")))) for w in lettered), len(lettered))
    ease = None if syllables is None else min(100.0, max(0.0, 206.835 - 1.015 * n / max(1, sentences) - 84.6 * syllables))
    ratios = [len(set(low)), sum(low.count(w) == 1 for w in set(low)), sum(w in STOP_WORDS for w in low), sum(w.isdigit() for w in words), sum(w.isupper() and len(w) > 1 for w in words)]
    bullets = len(re.findall(r"(?m)^\s*[-•*–]|\b\d+\.\s", text))
    return [n, sentences, chars, per(sum(map(len, lettered)), len(lettered)), n / max(1, sentences), *(per(r, n) for r in ratios), syllables, ease, per(marks, chars), bullets, len(re.findall(r"(?i)\b(%s)\b" % "|".join(ACTION_VERBS), text))]


TEXTS = [
    "Don't use A1 tools (fast) – 2. done.",
    "café d'où l'été aujourd'hui x_y 'tis dogs' a'é é'abc é'' '''",
    "- one\n\u2022 two\n  * three\n\u2013 four\n1. five 22. six a3. no\n\n \t- seven -no",
    "Led a team; MANAGED two. misled re-designed built_in",
    "!!! ... ",
    "12 345 6.7 8,9",
    "E ee eE bee the A.B.C.",
    *(None, "", " \n\t ", "\u00a0\u2003"),
    "w" * 20_000 + " " + "'" * 20_000 + "é",
    "\n" * 20_000 + "- x",
]


def test_features(spark):
    rng = np.random.default_rng(7)
    signs = list("aeeiouybcstAEX019''..!? \n\t\u00e9\u00a0_-*\u2022\u2013\u0663\u00b2") + ["led", "1. ", "\n- ", "the "]
    texts = TEXTS + ["".join(rng.choice(signs, n)) for n in rng.integers(1, 60, 400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    rows = Z.features(df, "v", "t").withColumn("verbs", F.when(Z.said(F.col("v")).isNotNull(), Z.count_verbs(F.col("v")))).collect()
    for r in rows:
        got = [r[f"t_{f}"] for f in Z.FEATURES] + [r["verbs"]]
        assert got == [None if w is None else pytest.approx(w, abs=1e-9) for w in expected(texts[r["i"]])], repr(texts[r["i"]][:200])
    assert set(Z.features(df, "v", "t").columns) >= {"i", "v"} and not any(c.startswith("_") for c in Z.features(df, "v", "t").columns)


def test_overlap(spark):
    pairs = [("abc1 3rd x_y Data don't data lake", "the data lake, café lake data"), (None, "x"), ("", ""), ("the", "of"), ("data", "of")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: (r["x"], r["token_jaccard"], r["jd_coverage"], r["bigram_jaccard"]) for r in df.select("i", Z.content_words(F.col("a")).alias("x"), *(c.alias(k) for k, c in Z.overlap(F.col("a"), F.col("b")).items())).collect()}
    # one text: data data lake; the other: data lake lake data; stop words (don, t) go
    assert got[0] == (["data", "data", "lake"], 1.0, 1.0, 0.25)
    assert got[1][1:] == got[2][1:] == got[3][1:] == (None, None, None) and got[4][1:] == (0.0, None, None)
