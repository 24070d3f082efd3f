"""The feature table against the rules in plain Python."""

import json
import math

import numpy as np
import pytest

from quillrank.operators.features import enriched
from quillrank.operators.profiles import KINDS

LEVELS = ("required education", "related experience")


def expected(cv, jd):
    own = lambda i: 5.0 if i.get("kind") in LEVELS else 1.0 if i.get("importance") is None else i["importance"]
    kind = lambda i: i.get("kind") or "unknown"

    def held(code, item):
        prefix, dot, level = code.rpartition(".")
        if kind(item) in LEVELS and dot and level.isdigit():
            others = [c.rpartition(".") for c, i in cv.items() if kind(i) == kind(item)]
            return any(p == prefix and d and lv.isdigit() and int(lv) >= int(level) for p, d, lv in others)
        return code in cv

    if cv is None or jd is None:
        return {"gt_score_1_10": None, "comp_item_overlap": None}
    rows = [(kind(i), own(i), held(c, i)) for c, i in jd.items()]
    total, hit = sum(w for _, w, _ in rows), sum(w for _, w, h in rows if h)
    if not rows:
        return {"gt_score_1_10": 5.5, "comp_item_overlap": None, "comp_jd_n_requirements": None, "cv_skill_total_importance": None}
    share = lambda a, b: a / b if b else None
    out = {"gt_score_1_10": max(1.0, min(10.0, 1 + 9 * 2 * hit / (2 * total))) if total else 5.5, "comp_item_overlap": share(hit, total)}
    for k in KINDS:
        key, mine = k.replace(" ", "_"), [(w, h) for kk, w, h in rows if kk == k]
        met, left = [w for w, h in mine if h], [w for w, h in mine if not h]
        cells = {f"comp_overlap_{key}_matched": len(met), f"comp_overlap_{key}_unmatched": len(left), f"{key}_matched_importance": sum(met), f"{key}_unmatched_importance": sum(left), f"comp_overlap_{key}_avg_matched_importance": share(sum(met), len(met))}
        cells |= {f"comp_overlap_{key}_avg_unmatched_importance": share(sum(left), len(left)), f"comp_overlap_{key}_ratio": share(sum(met), sum(met + left)), f"comp_jd_{key}_n_items": len(mine), f"comp_jd_{key}_importance_share": share(sum(met + left), total)}
        cells |= {f"comp_jd_{key}_avg_importance": share(sum(met + left), len(mine)), f"comp_jd_{key}_max_importance": max(met + left, default=None)}
        out |= {c: v if mine else None for c, v in cells.items()}
        theirs = [own(i) for i in cv.values() if kind(i) == k]
        out[f"cv_{key}_total_importance"] = sum(theirs) if theirs else None
    mean = total / len(rows)
    shape = [len(rows), total, mean, max(w for _, w, _ in rows), math.sqrt(sum((w - mean) ** 2 for _, w, _ in rows) / len(rows)), sum(k in LEVELS for k, _, _ in rows) / len(rows)]
    return out | dict(zip((f"comp_jd_{c}" for c in ("n_requirements", "sum_importance", "avg_importance", "max_importance", "importance_std", "edu_exp_ratio")), shape))


def test_enriched(spark):
    rng = np.random.default_rng(4)
    codes = ["1.A", "1.B", "2.D.1.6", "2.D.1.8", "2.D.1.10", "3.A.1.9", "abc", "x.y"]

    def profile(n):
        return {c: {k: v for k, v in (("kind", [*KINDS, "odd", None][rng.integers(10)]), ("name", c), ("importance", [None, 0.0, 2.5, 4.0][rng.integers(4)])) if v is not None} for c in rng.choice(codes, n, replace=False)}

    pairs = [(profile(rng.integers(0, 7)), profile(rng.integers(0, 7))) for _ in range(150)] + [(None, profile(3)), (profile(2), None), ({}, profile(2)), (profile(2), {})]
    text = lambda p: None if p is None else json.dumps(p)
    rows = [(i, f"j{i}", text(cv), text(jd), "Led a team. Built data tools" if i % 2 else None, "data tools " * (i % 3), "plain", i) for i, (cv, jd) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "cv_id long, jd_id string, cv_profile_dict string, jd_profile_dict string, cv_profile_text string, jd_profile_text string, cv_style string, group_id int")
    for r in enriched(df).collect():
        got, want = r.asDict(), expected(*pairs[r["cv_id"]])
        assert {k: got[k] for k in want} == {k: None if v is None else pytest.approx(v) for k, v in want.items()}
        assert got["group_id"] == f"{r['cv_id']}_j{r['cv_id']}" and got["cv_ling_style"] == "plain" and "jd_ling_style" not in got
        assert got["cv_ling_action_verb_count"] == (2 if r["cv_id"] % 2 else None) and got["jd_ling_word_count"] == (2 * (r["cv_id"] % 3) or None)
        assert got["ling_text_jd_coverage"] == (1.0 if r["cv_id"] % 2 and r["cv_id"] % 3 else None)
    assert enriched(df.limit(0)).count() == 0
    assert set(df.columns) <= set(enriched(df).columns)


def test_one_shuffle(spark):
    from quillrank.plans.catalogue import QUERIES

    plan = QUERIES["enriched_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 0


def test_the_last_duplicate_of_a_code_stays(spark):
    from quillrank.operators import profiles as P

    rows = spark.createDataFrame([("d", "c", "z", 1, 0), ("d", "c", "a", 1, 1), ("d", "b", "k", 0, 5), ("d", "c", "m", 0, 9)], "d string, code string, name string, file int, at int")
    got = P.item_map(rows, ["d"], "code", "name", order=["file", "at"]).first()["profile"]
    assert {k: v["name"] for k, v in got.items()} == {"c": "a", "b": "k"}
    assert P.item_map(rows, ["d"], "code", "name").first()["profile"]["c"]["name"] == "z"
