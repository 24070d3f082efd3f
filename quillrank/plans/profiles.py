"""Profile scores and overlap: a query's profile is an order's parts, a candidate's the parts that one of its suppliers supplies anywhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles as P
from .tables import dealt, query, rounded, table

KINDS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_ITEMS = """i AS (SELECT l_orderkey AS jd, l_partkey AS code, any_value(p_type) AS kind, any_value(1 + p_size % 5)::DOUBLE AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
_PAIRS = _ITEMS + """, h AS (SELECT DISTINCT l_suppkey AS cv, l_partkey AS code FROM lineitem), q AS (SELECT DISTINCT l_suppkey AS cv, l_orderkey AS jd FROM lineitem),
 m AS (SELECT q.cv, q.jd, i.code, kind, w, h.code IS NOT NULL AS matched FROM q JOIN i ON q.jd = i.jd LEFT JOIN h ON h.cv = q.cv AND h.code = i.code)"""


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.col("p_type").alias("kind"), (1 + F.col("p_size") % 5).cast("double").alias("w"))


def _items(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    n = rows.count()  # out of the files' footers
    lines = dealt(rows.select(F.col("l_orderkey").alias("jd"), F.col("l_partkey").alias("code")), n, "code").distinct()
    return dealt(lines.join(_parts(spark, sf_dir), "code"), n, "jd")


def _matches(spark, sf_dir, *of):
    """Each pair's items with of (columns of the part), partitioned by query. An item is matched by its own lines, or by a line of the supplier in another order:
    only pairs' items without a line of their own are moved to be looked up, as bare keys, and only those found are moved back."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("jd"), F.col("l_suppkey").alias("cv"), F.col("l_partkey").alias("code"))
    n = lines.count()  # out of the files' footers
    part = _parts(spark, sf_dir).select("code", *of, F.lit(True).alias("listed"))
    rows = dealt(dealt(lines, n, "code").join(part, "code", "left"), n, "jd").filter("jd is not null")
    queries = rows.groupBy("jd").agg(F.collect_set(F.struct("cv", "code", "listed", *of)).alias("lines"))
    item = lambda x: F.struct(x["code"].alias("code"), *(x[c].alias(c) for c in of))
    queries = queries.withColumn("items", F.array_distinct(F.transform(F.filter("lines", lambda x: x["listed"]), item)))
    suppliers = F.explode(F.array_distinct(F.transform("lines", lambda x: x["cv"]))).alias("cv")
    codes = lambda name: F.transform(F.filter(name, lambda x: x["cv"] == F.col("cv")), lambda x: x["code"])
    pairs = queries.select("jd", "lines", "items", suppliers)
    asked = pairs.filter("cv is not null").select("jd", "cv", F.explode(F.array_except(F.col("items")["code"], codes("lines"))).alias("code"))
    held = lines.select("cv", "code").filter("cv is not null and code is not null")
    found = dealt(asked, n, "cv", "code").join(dealt(held, n, "cv", "code"), ["cv", "code"], "left_semi")
    found = dealt(found, n, "jd").groupBy("jd").agg(F.collect_list(F.struct("cv", "code")).alias("found"))
    pairs = queries.join(found, "jd", "left").select("jd", "lines", "found", "items", suppliers)
    has = F.concat(codes("lines"), F.coalesce(codes("found"), F.array()))
    each = pairs.select("jd", "cv", has.alias("has"), F.explode("items").alias("item")).select("jd", "cv", "has", "item.*")
    return each.withColumn("matched", F.coalesce(F.array_contains("has", F.col("code")), F.lit(False))).drop("has")


_SCORE = "CASE WHEN sum({w}) > 0 THEN greatest(1.0, least(10.0, 1 + 9 * (sum(CASE WHEN matched THEN {w} ELSE -{w} END) + sum({w})) / (2 * sum({w})))) ELSE 5.5 END"


@query(f"WITH {_PAIRS} SELECT cv, jd, round({_SCORE.format(w='w')}, 6) AS gt_score FROM m GROUP BY cv, jd")
def gt_score(spark, sf_dir):
    return rounded(P.ground_truth(_matches(spark, sf_dir, "w"), ["cv", "jd"]))


@query(f"WITH {_PAIRS}, r AS (SELECT cv, jd, matched, round_even(w + 0.5, 0) AS w FROM m) SELECT cv, jd, round({_SCORE.format(w='w')}, 6) AS gt_score FROM r GROUP BY cv, jd")
def gt_score_rounded(spark, sf_dir):
    rows = _matches(spark, sf_dir, "w").withColumn("w", P.weight(F.col("w") + 0.5, whole=True))
    return rounded(P.ground_truth(rows, ["cv", "jd"]))


@query(f"WITH {_PAIRS} SELECT cv, jd, coalesce(string_agg(code::VARCHAR, ',' ORDER BY w DESC, code) FILTER (matched), '') AS matched_items, coalesce(string_agg(code::VARCHAR, ',' ORDER BY w DESC, code) FILTER (NOT matched), '') AS unmatched_items FROM m GROUP BY cv, jd")
def gt_breakdown(spark, sf_dir):
    rows = P.breakdown(_matches(spark, sf_dir, "w"), ["cv", "jd"])
    return rows.select("cv", "jd", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("matched_items", "unmatched_items")))


def _kind_sql() -> str:
    out = []
    for i, k in enumerate(KINDS):
        own = f"kind = '{k}'"
        out += [
            f"count(*) FILTER ({own} AND matched) AS k{i}_matched",
            f"count(*) FILTER ({own} AND NOT matched) AS k{i}_unmatched",
            f"round(coalesce(sum(w) FILTER ({own} AND matched), 0), 6) AS k{i}_weight_matched",
            f"round(coalesce(count(*) FILTER ({own} AND matched)::DOUBLE / nullif(count(*) FILTER ({own}), 0), 0), 6) AS k{i}_ratio",
            f"round(coalesce(coalesce(sum(w) FILTER ({own}), 0) / nullif(sum(w), 0), 0), 6) AS k{i}_share",
            f"round(coalesce(max(w) FILTER ({own}), 0), 6) AS k{i}_max",
        ]
    return ", ".join(out)


@query(f"WITH {_PAIRS} SELECT cv, jd, {_kind_sql()} FROM m GROUP BY cv, jd")
def kind_overlap(spark, sf_dir):
    return rounded(P.kind_overlap(_matches(spark, sf_dir, "kind", "w"), ["cv", "jd"], KINDS))


@query(f"WITH {_ITEMS} SELECT jd, count(*) AS n_items, round(sum(w), 6) AS total, round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS spread, round(max(w), 6) AS heaviest, round(count(*) FILTER (w >= 4)::DOUBLE / count(*), 6) AS high_ratio FROM i GROUP BY jd")
def profile_structure(spark, sf_dir):
    return rounded(P.structure(_items(spark, sf_dir), ["jd"]))


def _map_of(spark, sf_dir, flag):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_type")
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("jd"), "l_partkey").join(part, "l_partkey")
    lines = lines.select("jd", F.col("p_type").alias("code"), (F.col("p_size") + (0 if flag == "A" else 100)).alias("importance"))
    return P.item_map(lines, ["jd"], "code", "importance")


_MAPS = "a AS (SELECT l_orderkey AS jd, p_type AS code, max(p_size) AS importance FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' GROUP BY ALL), r AS (SELECT l_orderkey AS jd, p_type AS code, max(p_size) + 100 AS importance FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY ALL)"


@query(f"WITH {_MAPS} SELECT jd, code, importance FROM a")
def item_map(spark, sf_dir):
    return P.items(_map_of(spark, sf_dir, "A"), "profile", "jd")


@query(f"WITH {_MAPS} SELECT jd, code, coalesce(r.importance, a.importance) AS importance FROM a FULL JOIN r USING (jd, code) WHERE jd IN (SELECT jd FROM a) AND jd IN (SELECT jd FROM r)")
def map_merge(spark, sf_dir):
    a, r = _map_of(spark, sf_dir, "A"), _map_of(spark, sf_dir, "R").withColumnRenamed("profile", "other")
    both = a.join(r, "jd").select("jd", P.merged(F.col("profile"), F.col("other")).alias("profile"))
    return P.items(both, "profile", "jd")


@query("WITH b AS (SELECT p_partkey, p_brand || '.' || p_size AS own, first_value(p_brand || '.' || p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS other, p_size, first_value(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS other_size FROM part) SELECT p_partkey, other_size >= p_size AS matched FROM b")
def level_code_match(spark, sf_dir):
    from pyspark.sql import Window

    code = F.concat_ws(".", "p_brand", F.col("p_size").cast("string"))
    rows = table(spark, sf_dir, "part").withColumn("other", F.first(code).over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    return rows.select("p_partkey", P.level_matches(code, F.col("other")).alias("matched"))


@query("SELECT l_orderkey AS jd, string_agg(DISTINCT p_type, chr(10) ORDER BY p_type) AS prompt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def profile_text(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("name"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("jd"), "l_partkey").join(part, "l_partkey")
    rows = rows.withColumns({"code": F.col("name"), "description": F.lit(None).cast("string")})
    return P.item_map(rows, ["jd"], "code", "name", "description").select("jd", P.prompt_text(F.col("profile"), False).alias("prompt"))
