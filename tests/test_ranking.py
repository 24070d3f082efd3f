"""Ranking metrics against hand-computed answers and brute force over all orders of ties."""

import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillrank.operators import bootstrap as B
from quillrank.operators import ranking as R

ROWS = [("q", "c1", 9.0, 10.0, "female"), ("q", "c2", 7.0, 8.0, "female"), ("q", "c3", 7.0, 8.0, "male"), ("q", "c4", 7.0, 4.0, "neutral"), ("q", "c5", 3.0, 2.0, "male"), ("q", "c6", 3.0, 1.0, "neutral")]
SCHEMA = "jd_id string, cv string, score double, gt double, grp string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_gain_and_weights(rows):
    gain = {r["cv"]: r["gain"] for r in R.with_gain(rows).collect()}
    assert gain == {"c1": 6, "c2": 4.5, "c3": 4.5, "c4": 3, "c5": 2, "c6": 1}
    top = R.Threshold("top_k", 2)
    got = {r["cv"]: (r["a"], r["b"]) for r in rows.select("cv", top.weight("score", "jd_id").alias("a"), top.weight("gt", "jd_id").alias("b")).collect()}
    want = {"c1": (1, 1), "c2": (1 / 3, 0.5), "c3": (1 / 3, 0.5), "c4": (1 / 3, 0), "c5": (0, 0), "c6": (0, 0)}
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_values(rows):
    assert R.precision_per_query(rows, 2).first()["precision"] == pytest.approx(0.666667, abs=1e-6)
    e = R.errors_per_query(rows).first()
    assert (e["rmse"], e["mae"]) == (pytest.approx(1.683251, abs=1e-6), 1.5)
    g = R.with_gain(rows)
    assert R.ndcg_per_query(g).first()["ndcg"] == pytest.approx(0.988890, abs=1e-6)
    assert R.ndcg_per_query(g, 3).first()["ndcg"] == pytest.approx(0.949008, abs=1e-6)


def test_deltas(rows):
    by = R.errors_per_query(rows, ["jd_id", "grp"])
    got = {r["contrast"]: r["delta"] for r in R.unpaired_deltas(by, ["female", "male", "neutral"], "rmse").collect()}
    assert got["female-male"] == pytest.approx(0) and got["female-neutral"] == pytest.approx(-1.549510, abs=1e-6)
    assert R.delta_identity(R.unpaired_deltas(by, ["female", "male", "neutral"], "rmse"), "female", "male", "neutral").first()["holds"]


def test_half_even_fraction(rows):
    for share, k in ((0.25, 2), (0.75, 4)):
        assert rows.select(R.Threshold("top_fraction", share).weight("score", "jd_id").alias("w")).agg(F.sum("w")).first()[0] == pytest.approx(k)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.ndcg_per_query(R.with_gain(empty)).count() == 0 and R.errors_per_query(empty).count() == 0
    odd = spark.createDataFrame([("q", "a", None, 1.0, None), ("q", "b", 2.0, 1.0, "x"), ("r", "c", 5.0, 5.0, None), (None, "d", 1.0, 1.0, "x")], SCHEMA)
    assert {r["jd_id"]: r["n"] for r in R.errors_per_query(odd).collect()} == {"q": 1, "r": 1}
    assert R.precision_per_query(odd, 0).filter("precision is not null").count() == 0
    assert all(r["precision"] == 1 for r in R.precision_per_query(odd, 9).collect())
    assert R.Threshold("top_k", 3).describe() == "top_k=3, ties=expected"


def brute(scores, gains, k):
    best = sum(g / math.log2(i + 2) for i, g in enumerate(sorted(gains, reverse=True)[:k]))
    values = []
    for order in itertools.permutations(range(len(scores))):
        if all(scores[a] >= scores[b] for a, b in zip(order, order[1:])):
            values.append(sum(gains[j] / math.log2(i + 2) for i, j in enumerate(order[:k])))
    return sum(values) / len(values) / best


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 4)), min_size=1, max_size=6), st.integers(1, 7))
def test_ndcg_is_the_mean_over_orders_of_ties(spark, pairs, k):
    df = spark.createDataFrame([("q", float(s), float(g)) for s, g in pairs], "jd_id string, score double, gain double")
    got = R.ndcg_per_query(df, k).first()["ndcg"]
    assert got == pytest.approx(brute([s for s, _ in pairs], [g for _, g in pairs], k)) and 0 <= got <= 1 + 1e-9
    w = df.select(R.Threshold("top_k", k).weight("score", "jd_id").alias("w")).agg(F.sum("w")).first()[0]
    assert w == pytest.approx(min(k, len(pairs)))


def test_bootstrap_is_the_weighted_resampling(spark):
    import numpy as np

    values = [1.0, 5.0, 2.0, 8.0, 3.0, 3.0]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(values)], "q int, num double, den int")

    def mix(x):
        for _ in range(2):
            x = ((x ^ (x >> 16)) * 73244475) % (1 << 32)
        return x ^ (x >> 16)

    def weight(i, b):
        x, below, k = mix(mix((mix(i % (1 << 32)) + (b + 1) * 2654435769) % (1 << 32)) ^ mix(i >> 32)), math.exp(-1), 0
        while x >= math.floor(below * (1 << 32)) and k < 12:
            k += 1
            below += math.exp(-1) / math.factorial(k)
        return k

    units = np.array([0, 1, 5, (1 << 32) - 1, 1 << 32, (7 << 32) + 5])
    assert B.poisson_weights(units, 40).tolist() == [[weight(int(i), b) for b in range(40)] for i in units]
    draws = [[weight(i, b) for i in range(6)] for b in range(60)]
    means = [np.average(values, weights=w) for w in draws if sum(w)]
    for parts in (1, 3):
        got = B.intervals(df.repartition(parts), 60, ["q"]).first()
        assert (got["value"], got["ci_lower"], got["ci_upper"]) == pytest.approx((np.mean(values), *np.percentile(means, [2.5, 97.5])))
        assert got["n_valid"] == len(means)
    none = B.intervals(df.limit(0), 50, ["q"]).first()
    assert none["ci_lower"] is None and none["n_valid"] == 0
    assert B.intervals(df, 9, ["q"]).first()["ci_lower"] is None  # too few draws


def test_weights_are_poisson_and_independent():
    import numpy as np

    w = B.poisson_weights(np.arange(200_000), 20).astype(float)
    assert np.allclose(w.mean(0), 1, atol=0.012) and np.allclose(w.var(0), 1, atol=0.03)
    for a, b in ((w[:, 0], w[:, 1]), (w[:-1, 0], w[1:, 0]), (w[:-1, 3], w[1:, 4]), (w[:100_000, 5], w[100_000:, 5])):
        assert abs(np.corrcoef(a, b)[0, 1]) < 0.012
    assert np.abs(np.bincount(w.astype(int).ravel(), minlength=6)[:6] / w.size - [math.exp(-1) / math.factorial(k) for k in range(6)]).max() < 0.002


def test_intervals_have_the_width_of_the_normal_ones(spark):
    import numpy as np

    values = np.random.default_rng(2).normal(3, 2, 4000)
    df = spark.createDataFrame([(i, float(v), 1) for i, v in enumerate(values)], "q int, num double, den int")
    got = B.intervals(df, 1000, ["q"]).first()
    half = 1.96 * values.std(ddof=1) / math.sqrt(len(values))
    assert got["ci_upper"] - got["ci_lower"] == pytest.approx(2 * half, rel=0.1) and abs((got["ci_upper"] + got["ci_lower"]) / 2 - values.mean()) < 0.1 * half


def test_numbers_of_equal_rows(spark):
    df = spark.createDataFrame([(7,)] * 50 + [(k,) for k in range(20)], "q int").repartition(5)
    rows = B.numbered(df, "q").collect()
    assert sorted(r["i"] for r in rows) == list(range(70)) and [r["q"] for r in sorted(rows, key=lambda r: r["i"])] == sorted(r["q"] for r in df.collect())
