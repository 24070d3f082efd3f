"""The feature table of scored pairs: seven steps on each row, in one plan without a join or a shuffle.

A row holds both documents: cv_profile_dict and jd_profile_dict (maps from an item's code to its kind, name, description and importance, or the same as
JSON text), cv_profile_text and jd_profile_text, and styles. A profile that is null or can't be read leaves what rests on it null, as does an empty one of the
query; kinds that a query does not ask for are null too. Items without an importance weigh 1, education and experience always LEVEL_WEIGHT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linguistics as Z
from .profiles import KINDS, LEVEL_KINDS, level_parts, on_scale, weight

ITEM_JSON = "map<string,struct<kind:string,name:string,description:string,importance:double>>"
#: What each kind has, besides its total on the candidate's side.
PER_KIND = "comp_overlap_{}_matched comp_overlap_{}_unmatched {}_matched_importance {}_unmatched_importance comp_overlap_{}_avg_matched_importance comp_overlap_{}_avg_unmatched_importance comp_overlap_{}_ratio comp_jd_{}_n_items comp_jd_{}_importance_share comp_jd_{}_avg_importance comp_jd_{}_max_importance".split()


def _profile(rows: DataFrame, column: str) -> Column:
    return F.from_json(column, ITEM_JSON) if dict(rows.dtypes)[column] == "string" else F.col(column)


def _items(profile: str) -> Column:
    """code, kind, w, prefix, level of each item; prefix and level of those that match by level."""

    def item(e: Column) -> Column:
        kind = F.coalesce(e["value"]["kind"], F.lit("unknown"))
        prefix, level = level_parts(e["key"])
        return F.struct(e["key"].alias("code"), kind.alias("kind"), weight(e["value"]["importance"], kind).alias("w"), prefix.alias("prefix"), F.when(e["key"].contains("."), level).alias("level"))

    return F.transform(F.map_entries(profile), item)


def _matched() -> Column:
    """Of each of the query's items, whether the candidate holds it: by its code or, for level kinds whose code ends in a level, an item of its kind
    and prefix with a level at least as high."""

    def one(i: Column) -> Column:
        higher = F.exists("_cv_items", lambda c: (c["kind"] == i["kind"]) & (c["prefix"] == i["prefix"]) & (c["level"] >= i["level"]))
        by_level = i["kind"].isin(*LEVEL_KINDS) & i["level"].isNotNull()
        return F.struct(i["kind"].alias("kind"), i["w"].alias("w"), F.when(by_level, F.coalesce(higher, F.lit(False))).otherwise(F.map_contains_key("_cv", i["code"])).alias("hit"))

    return F.transform("_jd_items", one)


def _sums(items: Column) -> Column:
    """n, w, top, squares, and n and w of the matched, of an array of kind, w and hit."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("top"), F.lit(0).alias("hits"), F.lit(0.0).alias("hit_w"))

    def add(a: Column, x: Column) -> Column:
        hit = F.when(x["hit"], 1).otherwise(0)
        return F.struct((a["n"] + 1).alias("n"), (a["w"] + x["w"]).alias("w"), F.greatest(a["top"], x["w"]).alias("top"), (a["hits"] + hit).alias("hits"), (a["hit_w"] + hit * x["w"]).alias("hit_w"))

    return F.aggregate(items, zero, add)


def _share(part: Column, whole: Column) -> Column:
    return part / F.when(whole != 0, whole)


def _competences(rows: DataFrame) -> DataFrame:
    """Steps 2, 3 and 6: ground truth, overlap by kind, and the query's structure."""
    rows = rows.withColumns({"_cv": _profile(rows, "cv_profile_dict"), "_jd": _profile(rows, "jd_profile_dict")})
    rows = rows.withColumns({"_cv_items": _items("_cv"), "_jd_items": _items("_jd")}).withColumn("_met", _matched()).withColumn("_all", _sums(F.col("_met")))
    key = lambda kind: kind.replace(" ", "_")
    of = lambda array, kind: F.filter(array, lambda x: x["kind"] == kind)
    rows = rows.withColumns({f"_k_{key(k)}": _sums(of("_met", k)) for k in KINDS} | {f"_c_{key(k)}": F.transform(of("_cv_items", k), lambda x: x["w"]) for k in KINDS})
    whole, asked = F.col("_all"), (F.col("_all.n") > 0) & F.col("_cv").isNotNull()
    made = {
        "gt_score_1_10": F.when(F.col("_cv").isNotNull() & F.col("_jd").isNotNull(), on_scale(2 * whole["hit_w"] - whole["w"], whole["w"])),
        "comp_item_overlap": F.when(asked, _share(whole["hit_w"], whole["w"])),
    }
    for kind in map(key, KINDS):
        s, held = F.col(f"_k_{kind}"), F.col(f"_c_{kind}")
        left, left_w = s["n"] - s["hits"], s["w"] - s["hit_w"]
        cells = [s["hits"], left, s["hit_w"], left_w, _share(s["hit_w"], s["hits"]), _share(left_w, left), _share(s["hit_w"], s["w"]), s["n"], _share(s["w"], whole["w"]), _share(s["w"], s["n"]), s["top"]]
        made |= {name.format(kind): F.when(asked & (s["n"] > 0), c) for name, c in zip(PER_KIND, cells)}
        made[f"cv_{kind}_total_importance"] = F.when(asked & (F.size(held) > 0), F.aggregate(held, F.lit(0.0), lambda a, w: a + w))
    n, mean = whole["n"], whole["w"] / F.when(whole["n"] > 0, whole["n"])
    squares = F.aggregate("_met", F.lit(0.0), lambda a, x: a + (x["w"] - whole["w"] / whole["n"]) * (x["w"] - whole["w"] / whole["n"]))
    levels = F.size(F.filter("_jd_items", lambda x: x["kind"].isin(*LEVEL_KINDS)))
    shape = {"n_requirements": n, "sum_importance": whole["w"], "avg_importance": mean, "max_importance": whole["top"], "importance_std": F.when(n > 1, F.sqrt(squares / n)).otherwise(F.lit(0.0)), "edu_exp_ratio": levels / F.when(n > 0, n)}
    made |= {f"comp_jd_{k}": F.when(n > 0, c) for k, c in shape.items()}
    rows = rows.withColumns(made)
    return rows.drop("_cv", "_jd", "_cv_items", "_jd_items", "_met", "_all", *(f"_{s}_{key(k)}" for s in "kc" for k in KINDS))


def enriched(parsed: DataFrame) -> DataFrame:
    """parsed with group_id, gt_score_1_10, comp_*, <kind>_*_importance, cv_ling_*, jd_ling_* and ling_text_*."""
    rows = _competences(parsed.withColumn("group_id", F.concat_ws("_", F.col("cv_id").cast("string"), F.col("jd_id").cast("string"))))
    for side in ("cv", "jd"):
        rows = Z.features(rows, f"{side}_profile_text", f"{side}_ling").drop(*(f"{side}_ling_{k}" for k in ("punctuation", "syllables", "distinct")))
    said = Z.said(F.col("cv_profile_text"))
    rows = Z.with_overlap(rows, "cv_profile_text", "jd_profile_text", "ling_text_").withColumn("cv_ling_action_verb_count", F.when(said.isNotNull(), Z.count_verbs(said)))
    return rows.withColumns({f"{side}_ling_style": F.col(f"{side}_style") for side in ("cv", "jd") if f"{side}_style" in parsed.columns})
