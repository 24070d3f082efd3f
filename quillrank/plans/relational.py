"""Joins, choices, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap as B
from ..operators import relational as L
from .tables import SCORED, query, rounded, scored, table


def _people(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cv_id"), F.col("c_nationkey").alias("occ"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("jd_id"), F.col("s_nationkey").alias("occ"))
    return c, s


@query("SELECT c_custkey AS cv_id, s_suppkey AS jd_id, c_nationkey AS occ FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def occ_pairs(spark, sf_dir):
    return L.pairs_within(*_people(spark, sf_dir), "occ").select("cv_id", "jd_id", "occ")


@query("SELECT (SELECT count(*) FROM nation) * (SELECT count(*) FROM supplier) AS n")
def all_pairs_count(spark, sf_dir):
    return L.pairs_all(table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")).agg(F.count("*").alias("n"))


@query("SELECT cv_id, jd_id, occ FROM (SELECT c_custkey AS cv_id, c_nationkey AS occ, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) JOIN (SELECT s_suppkey AS jd_id, s_nationkey AS occ, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier) USING (occ, rn)")
def zip_pairs(spark, sf_dir):
    return L.pairs_zipped(*_people(spark, sf_dir), "occ", "cv_id", "jd_id").select("cv_id", "jd_id", "occ")


@query("SELECT c_custkey AS cv_id, s_suppkey AS jd_id, c_nationkey AS occ FROM customer JOIN supplier ON c_nationkey = s_nationkey ORDER BY md5(concat_ws('__', c_custkey, s_suppkey)), 1, 2 LIMIT 100")
def hash_subsample(spark, sf_dir):
    c, s = _people(spark, sf_dir)
    sizes = L.pair_sizes(c, s, "occ")
    low = lambda share: L.low_pairs_within(c, s, "occ", "cv_id", "jd_id", share, sizes).select("cv_id", "jd_id", "occ")
    return L.subsample(L.pairs_within(c, s, "occ", sizes).select("cv_id", "jd_id", "occ"), 100, "cv_id", "jd_id", total=sizes[1], low=low)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def resume_anti(spark, sf_dir):
    """Work whose key is in no order."""
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return L.not_done(table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey")


@query("SELECT user_id, coalesce(n.v, o.v) AS value, n.v IS NOT NULL AND o.v IS NOT NULL AS replaced FROM (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY user_id) o FULL JOIN (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'error' GROUP BY user_id) n USING (user_id)")
def retry_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    of = lambda kind: e.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.max("value").alias("value"))
    return L.retry_merge(of("click"), of("error"), "user_id", "value")


@query("WITH n AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal > 0), o AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier) SELECT k, v FROM n UNION ALL SELECT k, v FROM o WHERE k NOT IN (SELECT k FROM n)")
def keep_enriched(spark, sf_dir):
    new = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return L.upsert(old, new, "k")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_run(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return L.latest(rows, ["user_id"], "ts", "event_id").drop("ts")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def dedupe_first(spark, sf_dir):
    return L.first_of(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("WITH t AS (SELECT p_brand AS major, p_type AS detailed, p_size AS v FROM part), i AS (SELECT major, detailed, sum(v) AS inner_total FROM t GROUP BY ALL), o AS (SELECT major, sum(inner_total) AS outer_total FROM i GROUP BY major ORDER BY outer_total DESC, major LIMIT 10) SELECT major, detailed, inner_total::BIGINT AS inner_total, outer_total::BIGINT AS outer_total, row_number() OVER (PARTITION BY major ORDER BY inner_total DESC, detailed) AS rank FROM i JOIN o USING (major) QUALIFY rank <= 3")
def top_major_detailed(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("major"), F.col("p_type").alias("detailed"), F.col("p_size").alias("v"))
    return L.top_within(parts, "major", "detailed", "v", 10, 3).select("major", "detailed", "inner_total", "outer_total", "rank")


@query("SELECT p_brand AS major, p_type AS detailed, sum(p_size)::BIGINT AS total FROM part GROUP BY ROLLUP (p_brand, p_type)")
def rollup_major(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("major"), F.col("p_type").alias("detailed"), "p_size").rollup("major", "detailed").agg(F.sum("p_size").alias("total"))


@query("SELECT l_orderkey, min(l_quantity) FILTER (l_returnflag = 'A') AS importance, min(l_quantity) FILTER (l_returnflag = 'R') AS level FROM lineitem GROUP BY l_orderkey")
def pivot_first(spark, sf_dir):
    return L.pivot_first(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", {"A": "importance", "R": "level"}, "l_quantity")


@query("SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
def semi_selected(spark, sf_dir):
    rich = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").join(rich, "n_nationkey", "left_semi").select("n_nationkey", "n_name")


@query(f"WITH {SCORED} SELECT experiment, count(*) AS n, round(avg(score), 6) AS score, round(avg(extra), 6) AS extra FROM (SELECT 'first' AS experiment, score, gt AS extra FROM c WHERE grp = 'A' UNION ALL SELECT 'second', score, NULL FROM c WHERE grp = 'R') GROUP BY experiment")
def union_groups(spark, sf_dir):
    rows = scored(spark, sf_dir)
    both = L.union_labelled({"first": rows.filter("grp = 'A'").select("score", F.col("gt").alias("extra")), "second": rows.filter("grp = 'R'").select("score")})
    return rounded(both.groupBy("experiment").agg(F.count("*").alias("n"), F.avg("score").alias("score"), F.avg("extra").alias("extra")))


@query("WITH l AS (SELECT l_orderkey, l_returnflag, p_partkey, p_type AS prefix, p_size AS lvl FROM lineitem JOIN part ON l_partkey = p_partkey), h AS (SELECT l_orderkey, prefix, max(lvl) AS best FROM l WHERE l_returnflag = 'R' GROUP BY ALL) SELECT l.l_orderkey, p_partkey, coalesce(best >= lvl, false) AS matched FROM l LEFT JOIN h ON l.l_orderkey = h.l_orderkey AND l.prefix = h.prefix WHERE l_returnflag = 'A'")
def range_level_match(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("prefix"), F.col("p_size").alias("lvl"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey")
    wanted, held = lines.filter("l_returnflag = 'A'"), lines.filter("l_returnflag = 'R'")
    return L.level_matched(wanted, held, ["l_orderkey"], "prefix", "lvl").select("l_orderkey", "p_partkey", "matched")


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(total, 1.0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def left_join_default(spark, sf_dir):
    sums = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    joined = L.many_to_one(table(spark, sf_dir, "customer").select("c_custkey"), sums, ["c_custkey"])
    return joined.select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("total", F.lit(1.0)).alias("total"))


@query("SELECT o_orderstatus, count(*) AS n FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 'Y' ELSE 'N' END AS s, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'Y' ELSE 'N' END AS r FROM orders) WHERE s <> 'Y' AND (r IS NULL OR r <> 'Y') GROUP BY o_orderstatus")
def suppression_filter(spark, sf_dir):
    flag = lambda m: F.when(F.col("o_orderkey") % m == 0, None).when(F.col("o_orderkey") % m == 1, "Y").otherwise("N")
    return table(spark, sf_dir, "orders").filter(L.shown(flag(7), flag(5))).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_rows, count(DISTINCT l_partkey) AS n_queries, count(DISTINCT (l_orderkey, l_linenumber)) AS n_pairs FROM lineitem")
def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n_rows"), F.count_distinct("l_partkey").alias("n_queries"), F.count_distinct("l_orderkey", "l_linenumber").alias("n_pairs"))


@query("SELECT s_nationkey AS code FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def common_occupations(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("code"))
    return a.intersect(table(spark, sf_dir, "customer").select("c_nationkey"))


@query("SELECT e.user_id, e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'error' AND d.user_id = e.user_id AND d.event_type = e.event_type)")
def delete_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return L.delete_where(e, e.filter("event_type = 'error'"), "user_id", "event_type").select("user_id", "event_id")


@query("WITH r AS (SELECT o_orderkey AS name, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS source, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey - o_orderkey % 3 END AS copied FROM orders) SELECT r.name, coalesce(r.source, s.source) AS source FROM r LEFT JOIN r s ON r.copied = s.name")
def run_lookup(spark, sf_dir):
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(k.alias("name"), F.when(k % 3 == 0, F.col("o_orderpriority")).alias("source"), F.when(k % 3 != 0, k - k % 3).alias("copied"))
    return L.run_source(runs, "name", "source", "copied")


@query("SELECT grp, cv, key, w FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN w2 > 0 THEN -ln((('0x' || substr(md5('42:' || cv), 1, 8))::BIGINT::DOUBLE + 1) / 4294967297.0) / w2 END NULLS LAST, cv) AS rn, cv AS key FROM (SELECT p_type AS grp, p_partkey AS cv, (p_size % 6)::DOUBLE AS w, CASE WHEN sum((p_size % 6)::DOUBLE) OVER (PARTITION BY p_type) > 0 THEN (p_size % 6)::DOUBLE ELSE 1.0 END AS w2 FROM part)) WHERE rn <= 5")
def weighted_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("grp"), F.col("p_partkey").alias("cv"), F.col("p_partkey").alias("key"), (F.col("p_size") % 6).cast("double").alias("w"))
    return B.weighted_sample(rows, 5, ["grp"], "w", "cv", "42")


@query("SELECT s_suppkey || '::cf_' || variant AS id, CASE WHEN info = '' THEN s_name ELSE info || chr(10) || chr(10) || s_name END AS text, variant FROM supplier CROSS JOIN (VALUES ('neutral', ''), ('female', 'she'), ('male', 'he')) v(variant, info) WHERE s_acctbal > 5000 UNION ALL SELECT s_suppkey::VARCHAR, s_name, 'original' FROM supplier WHERE s_acctbal <= 5000")
def counterfactual_expand(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("text"), (F.col("s_acctbal") > 5000).alias("cv"))
    variants = spark.createDataFrame([("neutral", ""), ("female", "she"), ("male", "he")], "variant string, info string")
    return L.counterfactuals(rows, variants, F.col("cv"), "id", "text").select("id", "text", "variant")


@query("WITH a AS (SELECT l_partkey AS k, avg(l_quantity) AS own FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, avg(l_quantity) AS other FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) SELECT k, round(coalesce(other, own), 6) AS score FROM a LEFT JOIN b USING (k)")
def score_override(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    of = lambda flag, name: rows.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("k")).agg(F.avg("l_quantity").alias(name))
    return rounded(of("A", "own").join(of("N", "other"), "k", "left").select("k", F.coalesce("other", "own").alias("score")))


@query("SELECT coef, rank FROM (SELECT s_acctbal - 5000 AS coef, row_number() OVER (ORDER BY abs(s_acctbal - 5000) DESC, s_acctbal) AS rank FROM supplier) WHERE rank <= 10")
def top_absolute(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "supplier").select((F.col("s_acctbal") - 5000).alias("coef"))
    best = rows.orderBy(F.desc(F.abs("coef")), "coef").limit(10)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("coef")), "coef")))


