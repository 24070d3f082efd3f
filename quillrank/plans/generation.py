"""Batches, results and incremental parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generation as N
from ..session import scratch
from ..streaming import incremental
from .tables import query, table


@query("SELECT side || '::b1::' || p_partkey || '::' || style || '::' || idx AS custom_id, side, p_partkey AS occ, style, idx::INTEGER AS idx FROM part CROSS JOIN (VALUES ('formal'), ('plain')) s(style) CROSS JOIN (VALUES ('jd'), ('cv')) d(side) CROSS JOIN range(2) r(idx)")
def batch_requests(spark, sf_dir):
    occ = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("occ"))
    return N.requests(occ, spark.createDataFrame([("formal",), ("plain",)], "style string"), 2, "b1")


@query("SELECT 'cv::' || c_custkey AS custom_id, c_name AS title, o_orderpriority AS text FROM orders JOIN customer ON o_custkey = c_custkey")
def compile_final(spark, sf_dir):
    key = lambda c: F.concat(F.lit("cv::"), F.col(c).cast("string"))
    results = table(spark, sf_dir, "orders").select(N.compact(key("o_custkey")).alias("id"), F.col("o_orderpriority").alias("text"))
    return N.compiled(results, table(spark, sf_dir, "customer").select(key("c_custkey").alias("custom_id"), F.col("c_name").alias("title"))).select("custom_id", "title", "text")


@query(
    """WITH o AS (SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'Token limit reached' WHEN min(o_orderkey) % 7 = 0 THEN '' END AS error, CASE WHEN bool_or(o_orderstatus = 'F') THEN 500 ELSE 200 END AS code FROM orders GROUP BY 1)
 SELECT CASE WHEN o.o_custkey IS NULL THEN 'missing' WHEN error <> '' THEN 'token_limit' WHEN code <> 200 THEN 'http_error' ELSE 'success' END AS category, count(*) AS n FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY 1"""
)
def batch_outcomes(spark, sf_dir):
    has = lambda status: F.bool_or(F.col("o_orderstatus") == status)
    error = F.when(has("P"), "Token limit reached").when(F.min("o_orderkey") % 7 == 0, "")
    results = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custom_id")).agg(error.alias("error"), F.when(has("F"), 500).otherwise(200).alias("status_code"))
    inputs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custom_id"))
    return N.outcomes(inputs, results).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT event_id AS custom_id, 'Check: ' || props || ' please' AS prompt FROM events")
def next_requests(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("custom_id"), F.concat(F.lit("```json\n"), "props", F.lit("\n```")).alias("text"))
    return N.next_requests(rows, "Check: {input} please")


@query("WITH r AS (SELECT p_type AS occ, profile, p_partkey AS item, -ln((('0x' || substr(md5('7:' || profile || '/' || p_partkey), 1, 8))::BIGINT::DOUBLE + 1) / 4294967297.0) / (p_size * p_size)::DOUBLE AS k, profile || '/' || p_partkey AS key FROM part CROSS JOIN range(3) t(profile)) SELECT occ, profile::INTEGER AS profile, item FROM r QUALIFY row_number() OVER (PARTITION BY occ, profile ORDER BY k, key) <= 4")
def sampled_profiles(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_type").alias("occ"), F.col("p_partkey").alias("item"), F.col("p_size").cast("double").alias("w"))
    return N.sampled_profiles(items, 3, 4, ["occ"], "w", "item", "7")


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN regexp_extract(props, '([0-9]+)', 1)::DOUBLE END AS score, CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'no_score' END AS parse_status FROM events")
def incremental_completions(spark, sf_dir):
    source, sink = scratch(spark, "arrivals"), scratch(spark, "parsed")
    done = F.concat(F.lit('{"score": '), F.regexp_extract("props", "([0-9]+)", 1), F.lit("}"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, done).otherwise("none").alias("completion"))
    for part in ("completion = 'none'", "true"):  # the second arrival repeats keys of the first one
        rows.filter(part).write.mode("append").json(source)
        incremental.parse_new(spark, source, "id BIGINT, completion STRING", sink, f"{sink}-state")
    return spark.read.schema("id BIGINT, score DOUBLE, parse_status STRING").parquet(sink)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    return incremental.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")


_DRAWN = """i AS (SELECT p_type AS occ, 'k' || p_partkey % 3 AS kind, p_partkey AS code, CASE WHEN p_partkey % 4 > 0 OR p_partkey % 3 = 2 THEN p_size::DOUBLE END AS w, CASE p_partkey % 3 WHEN 0 THEN 2 ELSE 3 END AS n, p_retailprice AS price FROM part WHERE p_partkey % 3 < 2 OR p_partkey % 5 > 0),
 g AS (SELECT *, bool_or(coalesce(w > 0, FALSE)) OVER (PARTITION BY occ, kind) AS any_w FROM i WHERE kind IN ('k0', 'k1')),
 d AS (SELECT *, -ln((('0x' || substr(md5('3:' || attempt || '/' || profile || '/' || kind || '/' || code), 1, 8))::BIGINT::DOUBLE + 1) / 4294967297.0) / CASE WHEN any_w THEN w * w ELSE 1.0 END AS k, attempt || '/' || profile || '/' || kind || '/' || code AS key FROM g CROSS JOIN range(4) a(attempt) CROSS JOIN range(3) b(profile)),
 c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY occ, attempt, profile, kind ORDER BY CASE WHEN w > 0 OR NOT any_w THEN k END NULLS LAST, key) <= n),
 v AS (SELECT occ, profile, attempt FROM c GROUP BY ALL HAVING bool_and(coalesce(w > 0, FALSE) OR NOT any_w) AND sum(price) % 3 < 1),
 f AS (SELECT occ, profile, min(attempt) AS attempt FROM v GROUP BY ALL)"""


def _built(spark, sf_dir):
    k = F.col("p_partkey")
    items = table(spark, sf_dir, "part").select(F.col("p_type").alias("occ"), F.concat(F.lit("k"), (k % 3).cast("string")).alias("kind"), k.alias("code"), F.when((k % 4 > 0) | (k % 3 == 2), F.col("p_size").cast("double")).alias("w"), F.col("p_retailprice").alias("price"))
    return N.built_profiles(items, {"k0": 2, "k1": 3}, 3, ["occ"], "kind", "code", "w", "3", valid=F.sum("price") % 3 < 1)


@query(f"WITH {_DRAWN} SELECT occ, profile::INTEGER AS profile, kind, code, attempt::INTEGER AS attempt FROM c JOIN f USING (occ, profile, attempt)")
def built_profiles(spark, sf_dir):
    return _built(spark, sf_dir)[0]


@query(f"WITH {_DRAWN} SELECT DISTINCT occ, profile::INTEGER AS profile FROM d WHERE (occ, profile) NOT IN (SELECT (occ, profile) FROM f)")
def unfilled_profiles(spark, sf_dir):
    return _built(spark, sf_dir)[1]
