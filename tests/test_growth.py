"""Work that is dealt out over tasks as the input grows, with the same rows."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quillrank.operators import digests
from quillrank.operators import relational as L
from quillrank.plans import catalogue, features, graphs, profiles, tables
from quillrank.plans import relational as R
from tests.conftest import SMALL
from tests.oracle import difference


def one_group(spark, n, m):
    left = spark.range(n, numPartitions=1).select(F.col("id").alias("cv_id"), F.lit(7).alias("occ"))
    right = spark.range(m, numPartitions=1).select(F.col("id").alias("jd_id"), F.lit(7).alias("occ"))
    return left, right


def test_subsample_of_one_large_group_is_shared_by_tasks_and_exact(spark):
    left, right = one_group(spark, 3000, 40)
    sizes = L.pair_sizes(left, right, "occ")
    assert sizes[1] == 120000
    pairs = L.pairs_within(left, right, "occ", sizes)
    got = [(r.cv_id, r.jd_id) for r in L.subsample(pairs, 30, "cv_id", "jd_id", total=sizes[1]).collect()]
    want = sorted((hashlib.md5(f"{a}__{b}".encode()).hexdigest(), a, b) for a in range(3000) for b in range(40))[:30]
    assert got == [(a, b) for _, a, b in want]


def test_subsample_raises_a_bound_that_keeps_too_few(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    want = L.subsample(rows, 50, "k").collect()
    assert L.subsample(rows, 50, "k", total=10**9).collect() == want and len(want) == 50
    assert L.subsample(rows, 600, "k", total=500).count() == 500


def test_digests_of_pairs_are_those_of_hashlib():
    left, right = [None, "", "7", "12", "é" * 30, "x" * 200, *map(str, range(90, 120))], [None, "", "b" * 53, "b" * 54, "b" * 55, "q" * 64, "z\0", *map(str, range(990, 1020))]
    low = [int(hashlib.md5("__".join(t for t in (a, b) if t is not None).encode()).hexdigest()[:8], 16) <= 1 << 30 for a in left for b in right]
    i, j = digests.low_pairs(left, right, "__", 1 << 30)
    assert sorted((i * len(right) + j).tolist()) == [at for at, kept in enumerate(low) if kept]


def test_subsample_of_pairs_makes_no_row_of_each(spark, tmp_path, monkeypatch):
    left, right = one_group(spark, 3000, 40)
    odd = spark.createDataFrame([(None, 7), (-5, 7), (-5, 7), (9, None), (8, 3)], "k long, occ int")
    left.selectExpr("cv_id AS c_custkey", "occ AS c_nationkey").union(odd).write.parquet(f"{tmp_path}/customer.parquet")
    right.selectExpr("jd_id AS s_suppkey", "occ AS s_nationkey").union(odd.filter("k IS NULL OR k > 8")).write.parquet(f"{tmp_path}/supplier.parquet")
    pairs_within, c = L.pairs_within, duckdb.connect()
    monkeypatch.setattr(L, "pairs_within", lambda *args: pairs_within(*args).withColumn("cv_id", F.raise_error(F.lit("a row of a pair")).cast("long")))
    monkeypatch.setattr(L, "DIGEST_SIDE", 500)
    for t in ("customer", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.execute(catalogue.ORACLES["hash_subsample"]).fetchall()
    assert [tuple(r) for r in catalogue.QUERIES["hash_subsample"](spark, str(tmp_path)).collect()] == want and len(want) == 100


def test_low_pairs_with_null_and_negative_keys(spark):
    left = spark.createDataFrame([(None, 7), (-5, 7), (-5, 7), (12, 7), (3, 8), (4, None)], "cv_id long, occ int")
    right = spark.createDataFrame([("a", 7), (None, 7), ("", 7), ("c" * 80, 8), ("d", None)], "jd_id string, occ int")
    sizes, digest = L.pair_sizes(left, right, "occ"), F.md5(F.concat_ws("__", "cv_id", "jd_id"))
    want = L.pairs_within(left, right, "occ", sizes).filter(digest < "8").select("occ", "cv_id", "jd_id").collect()
    got = L.low_pairs_within(left, right, "occ", "cv_id", "jd_id", 0.5, sizes).filter(digest < "8").collect()
    key = lambda r: repr(tuple(r))
    assert sorted(got, key=key) == sorted(want, key=key) and 0 < len(got) < 13


def test_a_pair_of_tables_with_one_group_is_more_than_one_task(spark):
    left, right = one_group(spark, 9000, 20)
    pairs = L.pairs_within(left, right, "occ")
    assert pairs.distinct().count() == pairs.count() == 180000
    assert pairs.select(F.spark_partition_id()).distinct().count() > 1


def test_copies_of_rows_for_cells_are_made_in_bounded_tasks(spark, monkeypatch):
    left, right = one_group(spark, 600, 90)
    monkeypatch.setattr(L, "CELL_SIDE", 8)
    monkeypatch.setattr(L, "TASK_COPIES", 500)
    pairs = L.pairs_within(left, right, "occ")
    assert pairs.distinct().count() == pairs.count() == 54000
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    copies = {600 * 12, 90 * 75}  # 75 x 12 cells
    assert all(f"Repartition {-(-n // 500)}, true" in plan for n in copies)


def test_resume_takes_every_order_as_done(spark, tmp_path):
    spark.range(5).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(30, 0), (31, 1), (32, 3)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r[0] for r in R.resume_anti(spark, str(tmp_path)).collect()} == {2, 4}


#: Queries whose tables are partitioned into tasks of a stated number of rows.
DEALT = "precision_delta ndcg_delta precision_micro precision_macro cluster_bootstrap_ci ndcg_per_query ndcg_mean ndcg_bootstrap_ci top_fraction topk_probability edge_fix shadow_nodes profile_structure kind_overlap gt_breakdown hop_paths enriched_pairs".split()


@pytest.mark.parametrize("name", DEALT)
def test_tasks_grow_with_the_rows(spark, monkeypatch, name):
    asked, dealt = [], tables.dealt
    for module in (tables, features, graphs, profiles):
        monkeypatch.setattr(module, "dealt", lambda rows, n, *by: asked.append(n) or dealt(rows, n, *by), raising=False)
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    catalogue.QUERIES[name](spark, SMALL)
    lines = tables.table(spark, SMALL, "lineitem").count()
    assert asked and min(asked) >= lines
    rows = dealt(spark.range(lines), lines, "id")
    assert rows.rdd.getNumPartitions() == -(-lines // 500)


def test_words_of_a_turn_are_found_once(spark):
    plan = catalogue.QUERIES["content_coverage"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


#: Queries over each pair's items.
PAIRED = "gt_score gt_score_rounded gt_breakdown kind_overlap".split()


@pytest.mark.parametrize("name", PAIRED)
def test_items_are_not_moved_by_pair(spark, name):
    plan = catalogue.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    moved = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert moved and not any("[cv#" in line and "jd#" in line.split("]")[0] for line in moved)


@pytest.mark.parametrize("name", PAIRED)
def test_pairs_with_items_of_other_orders_and_odd_lines(spark, tmp_path, name):
    lines = [(1, 10, 100), (1, 10, 100), (1, 11, 101), (2, 10, 101), (3, 12, 999), (3, 11, 100), (4, 12, 999), (5, None, 100), (5, 10, None), (None, 10, 100), (6, 11, 102), (6, 10, 102), (6, 10, 103)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(100, "ECONOMY", 7), (101, "LARGE", 4), (102, None, 9), (103, "PROMO", 3)]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    c = duckdb.connect()
    for t in ("lineitem", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert not difference(spark, c, str(tmp_path), catalogue.QUERIES[name], catalogue.ORACLES[name])
