"""The feature table: the two sides of an order are a pair, its returned or open lines the query's and the candidate's items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import PER_KIND, enriched
from ..operators.profiles import KINDS, LEVEL_KINDS
from ..functions.linguistics import FEATURES
from .tables import dealt, query, rounded, table
from .text import _CONTENT, _LING, _LONG, _PAIRS_OF, _STOP, _VERBS

_KEYS = [k.replace(" ", "_") for k in KINDS]
_NAMES = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"


def _parsed(spark, sf_dir):
    """A row for each order with both profiles, their texts and styles: one shuffle, by the order."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_size", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("jd_id"), F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("ln"), F.col("l_suppkey").alias("cv_id"), (F.col("l_returnflag") == "N").alias("asked"))
    rows = lines.join(part, "k")
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("k") % 8).cast("int"))
    level = F.concat(F.lit("L"), (F.col("k") % 2).cast("string"), F.lit("."), (F.col("p_size") % 7).cast("string"))
    code = F.when(kind.isin(*LEVEL_KINDS), level).otherwise(F.concat(F.lit("c"), (F.col("k") % 5).cast("string")))
    item = F.struct(kind.alias("kind"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("description"), F.when(F.col("k") % 11 != 0, 1 + (F.col("p_size") % 9) / 2).alias("importance"))
    rows = dealt(rows.withColumns({"code": code, "item": item}), table(spark, sf_dir, "lineitem").count(), "jd_id").groupBy("jd_id", "asked", "code")
    rows = rows.agg(F.max_by("item", F.struct("ln", "k", "cv_id")).alias("item"), F.min("cv_id").alias("cv_id"), F.max("p_brand").alias("style"))  # the last of a code counts
    side = lambda asked: F.array_sort(F.collect_list(F.when(F.col("asked") == asked, F.struct("code", "item"))))
    both = rows.groupBy("jd_id").agg(F.min("cv_id").alias("cv_id"), side(True).alias("jd"), side(False).alias("cv"), F.min("style").alias("cv_style"), F.max("style").alias("jd_style"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["item"]["name"]), ". ")
    return both.select("cv_id", "jd_id", "cv_style", "jd_style", *(c for s in ("cv", "jd") for c in (F.map_from_entries(s).alias(f"{s}_profile_dict"), text(s).alias(f"{s}_profile_text"))))


def _per_kind_sql() -> str:
    out = []
    for kind, key in zip(KINDS, _KEYS):
        n, hit, w, hit_w = (f"count(*) FILTER (kind = '{kind}')", f"count(*) FILTER (kind = '{kind}' AND hit)", f"sum(w) FILTER (kind = '{kind}')", f"coalesce(sum(w) FILTER (kind = '{kind}' AND hit), 0)")
        cells = [hit, f"{n} - {hit}", hit_w, f"{w} - {hit_w}", f"{hit_w} / nullif({hit}, 0)", f"({w} - {hit_w}) / nullif({n} - {hit}, 0)", f"{hit_w} / {w}", n, f"{w} / sum(w)", f"{w} / {n}", f"max(w) FILTER (kind = '{kind}')"]
        for name, c in zip(PER_KIND, cells):
            whole = name.endswith(("_matched", "_unmatched", "_n_items"))
            out.append(f"CASE WHEN {n} > 0 THEN {f'({c})::INTEGER' if whole else f'round(({c})::DOUBLE, 6)'} END AS {name.format(key)}")
    return ", ".join(out)


_TEXTS = "documents AS (SELECT doc_id * 2 + 1 AS doc_id, jd_text AS text FROM s UNION ALL SELECT doc_id * 2, cv_text FROM s)"
_LINE_SQL = f"""r AS (SELECT l_orderkey AS o, l_returnflag = 'N' AS asked, l_linenumber AS ln, l_partkey AS k, l_suppkey AS cv_id, p_name AS name, p_brand AS brand, {_NAMES}[l_partkey % 8 + 1] AS kind,
  CASE WHEN l_partkey % 11 <> 0 THEN 1 + (p_size % 9) / 2.0 ELSE 1.0 END::DOUBLE AS importance, CASE WHEN l_partkey % 8 >= 6 THEN 'L' || l_partkey % 2 || '.' || p_size % 7 ELSE 'c' || l_partkey % 5 END AS code, CASE WHEN l_partkey % 8 >= 6 THEN p_size % 7 END AS level
  FROM lineitem JOIN part ON l_partkey = p_partkey),
 i AS (SELECT *, CASE WHEN level IS NOT NULL THEN 5.0 ELSE importance END AS w FROM r QUALIFY row_number() OVER (PARTITION BY o, asked, code ORDER BY ln DESC, k DESC, cv_id DESC) = 1),
 b AS (SELECT o, asked, code, max(brand) AS style FROM r GROUP BY ALL),
 s AS (SELECT o AS doc_id, min(cv_id) AS cv_id, coalesce((SELECT string_agg(name, '. ' ORDER BY code) FROM i WHERE i.o = r.o AND asked), '') AS jd_text, coalesce((SELECT string_agg(name, '. ' ORDER BY code) FROM i WHERE i.o = r.o AND NOT asked), '') AS cv_text FROM r GROUP BY o),
 st AS (SELECT o, min(style) AS cv_style, max(style) AS jd_style FROM b GROUP BY o),
 m AS (SELECT *, CASE WHEN level IS NOT NULL THEN EXISTS (SELECT 1 FROM i c WHERE c.o = i.o AND NOT c.asked AND c.kind = i.kind AND split_part(c.code, '.', 1) = split_part(i.code, '.', 1) AND c.level >= i.level) ELSE EXISTS (SELECT 1 FROM i c WHERE c.o = i.o AND NOT c.asked AND c.code = i.code) END AS hit FROM i WHERE asked),
 g AS (SELECT o, round(greatest(1.0, least(10.0, 1 + 9 * (2 * sum(CASE WHEN hit THEN w ELSE 0 END)) / (2 * sum(w)))), 6) AS gt_score_1_10, round(coalesce(sum(w) FILTER (hit), 0) / sum(w), 6) AS comp_item_overlap, {_per_kind_sql()},
  count(*)::INTEGER AS comp_jd_n_requirements, round(sum(w), 6) AS comp_jd_sum_importance, round(avg(w), 6) AS comp_jd_avg_importance, max(w) AS comp_jd_max_importance, round(stddev_pop(w), 6) AS comp_jd_importance_std, round(count(*) FILTER (level IS NOT NULL)::DOUBLE / count(*), 6) AS comp_jd_edu_exp_ratio FROM m GROUP BY o),
 t AS (SELECT o, {", ".join(f"round(sum(w) FILTER (kind = '{k}'), 6) AS cv_{key}_total_importance" for k, key in zip(KINDS, _KEYS))} FROM i WHERE NOT asked GROUP BY o)"""


def _ling_columns(side: str, alias: str) -> str:
    cells = {f: _LONG[f].format(stop=_STOP) for f in FEATURES}
    return ", ".join((f"round({c}, 6)" if "/" in c or "per_" in c else f"({c})::INTEGER") + f" AS {side}_ling_{f}" for f, c in cells.items())


_OVERLAP = f"""c AS (SELECT doc_id, {_CONTENT.format(c="cv_text")} AS a, {_CONTENT.format(c="jd_text")} AS b FROM s),
 ov AS (SELECT doc_id, round(len(list_intersect(p, q))::DOUBLE / nullif(len(list_distinct(list_concat(p, q))), 0), 6) AS ling_text_token_jaccard, round(len(list_intersect(p, q))::DOUBLE / nullif(len(q), 0), 6) AS ling_text_jd_coverage,
  round(len(list_intersect(x, y))::DOUBLE / nullif(len(list_distinct(list_concat(x, y))), 0), 6) AS ling_text_bigram_jaccard FROM (SELECT *, list_distinct(a) AS p, list_distinct(b) AS q, {_PAIRS_OF.format(c="a")} AS x, {_PAIRS_OF.format(c="b")} AS y FROM c))"""
_VERB = rf"CASE WHEN trim(cv_text) <> '' THEN len(list_filter(string_split_regex(lower(cv_text), '[^\pL\pN_]+'), lambda x: list_contains({_VERBS}, x))) END"


@query(
    f"""WITH {_LINE_SQL}, {_TEXTS}, {_LING}, {_OVERLAP}, zc AS (SELECT doc_id // 2 AS o, {_ling_columns("cv", "f")} FROM f WHERE doc_id % 2 = 0), zj AS (SELECT doc_id // 2 AS o, {_ling_columns("jd", "f")} FROM f WHERE doc_id % 2 = 1)
 SELECT s.cv_id, s.doc_id AS jd_id, s.cv_id || '_' || s.doc_id AS group_id, st.cv_style AS cv_ling_style, st.jd_style AS jd_ling_style, coalesce(gt_score_1_10, 5.5) AS gt_score_1_10, g.* EXCLUDE (o, gt_score_1_10),
  {", ".join(f"CASE WHEN g.o IS NOT NULL THEN cv_{key}_total_importance END AS cv_{key}_total_importance" for key in _KEYS)}, zc.* EXCLUDE (o), zj.* EXCLUDE (o), ov.* EXCLUDE (doc_id), ({_VERB})::INTEGER AS cv_ling_action_verb_count
 FROM s JOIN st ON st.o = s.doc_id LEFT JOIN g ON g.o = s.doc_id LEFT JOIN t ON t.o = s.doc_id JOIN zc ON zc.o = s.doc_id JOIN zj ON zj.o = s.doc_id JOIN ov ON ov.doc_id = s.doc_id"""
)
def enriched_pairs(spark, sf_dir):
    return rounded(enriched(_parsed(spark, sf_dir)).drop("cv_style", "jd_style", *(f"{s}_profile_{x}" for s in ("cv", "jd") for x in ("dict", "text"))))
