"""Profiles of competence items: ground-truth scores, overlap and structure.

A profile is a map from an item's code to struct<kind, name, description, importance>, or the same exploded. An item without an importance
weighs 1. Scores lie in 1 ... 10 and are 5.5 where they are not defined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEGENERATE = 5.5
#: Kinds whose weight is fixed, and which match by level instead of by code.
LEVEL_KINDS, LEVEL_WEIGHT = ("required education", "related experience"), 5.0
# The eight kinds of items.
KINDS = ["skill", "knowledge", "abilities", "task", "tech_skill", "work_style", "required education", "related experience"]


def items(profiles: DataFrame, profile: str, *keys: str) -> DataFrame:
    """keys, code, kind, name, description, importance: a row for each item."""
    return profiles.select(*keys, F.explode(profile).alias("code", "_i")).select(*keys, "code", "_i.*")


def item_map(rows: DataFrame, by: list[str], code: str, *fields: str, order: list[str] | None = None) -> DataFrame:
    """by, profile: a map of structs; of items with one code the last by order stays (without an order, that with the largest fields)."""
    item = F.struct(*fields)
    one = rows.groupBy(*by, code).agg((F.max_by(item, F.struct(*order, *fields)) if order else F.max(item)).alias("_i"))
    return one.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(code, "_i")))).alias("profile"))


def merged(first: Column, second: Column) -> Column:
    """Both maps' entries; second's where both have a key."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def weight(importance: Column, kind: Column | None = None, whole: bool = False) -> Column:
    w = F.coalesce(importance, F.lit(1.0)).cast("double")
    w = F.bround(w) if whole else w
    return w if kind is None else F.when(kind.isin(*LEVEL_KINDS), F.lit(LEVEL_WEIGHT)).otherwise(w)


def on_scale(total: Column, most: Column) -> Column:
    """total in -most ... most moved to 1 ... 10, and 5.5 if most is 0 or null."""
    return F.when(most > 0, F.greatest(F.lit(1.0), F.least(F.lit(10.0), 1 + 9 * (total + most) / (2 * most)))).otherwise(F.lit(DEGENERATE))


def ground_truth(rows: DataFrame, by: list[str], weight_col: str = "w", matched: str = "matched") -> DataFrame:
    """by, gt_score: weights of matched items less those of the others, on the scale."""
    w = F.col(weight_col)
    return rows.groupBy(*by).agg(on_scale(F.sum(F.when(F.col(matched), w).otherwise(-w)), F.sum(w)).alias("gt_score"))


def level_parts(code: Column) -> tuple[Column, Column]:
    """(prefix, level): a code split at its last dot; without one, the whole code and null."""
    at = F.regexp_extract(code, r"^(.*)\.([^.]*)$", 1)
    has = code.contains(".")
    return F.when(has, at).otherwise(code), F.when(has, F.regexp_extract(code, r"\.([^.]*)$", 1).try_cast("int"))


def level_matches(wanted: Column, held: Column) -> Column:
    """Equal codes, or equal prefixes with a level at least as high."""
    (wp, wl), (hp, hl) = level_parts(wanted), level_parts(held)
    return (wanted == held) | F.coalesce((wp == hp) & (hl >= wl), F.lit(False))


def breakdown(rows: DataFrame, by: list[str], code: str = "code", weight_col: str = "w", matched: str = "matched") -> DataFrame:
    """by, matched_items, unmatched_items: codes by weight, heaviest first, then by code."""
    item = F.struct((-F.col(weight_col)).alias("w"), F.col(code).alias("code"))
    lists = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, item))), lambda x: x["code"])
    return rows.groupBy(*by).agg(lists(F.col(matched)).alias("matched_items"), lists(~F.col(matched)).alias("unmatched_items"))


def kind_overlap(rows: DataFrame, by: list[str], kinds: list[str], kind: str = "kind", weight_col: str = "w", matched: str = "matched") -> DataFrame:
    """by and, for each kind, the number and weight of matched and unmatched items, ratio, share of all items' weight, and maximum."""
    out = []
    total = F.sum(weight_col)
    for i, k in enumerate(kinds):
        own, name = F.col(kind) == k, f"k{i}"
        hit = own & F.col(matched)
        w, n = (lambda c: F.coalesce(F.sum(F.when(c, F.col(weight_col))), F.lit(0.0))), (lambda c: F.count(F.when(c, True)))
        out += [
            n(hit).alias(f"{name}_matched"),
            n(own & ~F.col(matched)).alias(f"{name}_unmatched"),
            w(hit).alias(f"{name}_weight_matched"),
            F.coalesce(n(hit) / F.nullif(n(own), F.lit(0)), F.lit(0.0)).alias(f"{name}_ratio"),
            F.coalesce(w(own) / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias(f"{name}_share"),
            F.coalesce(F.max(F.when(own, F.col(weight_col))), F.lit(0.0)).alias(f"{name}_max"),
        ]
    return rows.groupBy(*by).agg(*out)


def structure(rows: DataFrame, by: list[str], weight_col: str = "w", high: float = 4.0) -> DataFrame:
    """by, n_items, total, mean, spread (population deviation, 0 for one item), heaviest, high_ratio."""
    w = F.col(weight_col)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_items"), F.sum(w).alias("total"), F.avg(w).alias("mean"), F.stddev_pop(w).alias("spread"), F.max(w).alias("heaviest"), (F.count(F.when(w >= high, True)) / F.count("*")).alias("high_ratio")
    )


def prompt_text(profile: Column, with_importance: bool) -> Column:
    """One line an item, by code: name, description and, if asked for, importance."""
    line = lambda e: F.concat_ws(" - ", e["value"]["name"], e["value"]["description"], *([F.concat(F.lit("importance "), e["value"]["importance"].cast("string"))] if with_importance else []))
    return F.array_join(F.transform(F.array_sort(F.map_entries(profile)), line), "\n")
