"""Regression, correlation and standardising over order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from .tables import query, rounded, table

FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query("SELECT a, b, round(r, 6) AS r FROM (SELECT 'l_quantity' AS a, 'l_discount' AS b, corr(l_quantity, l_discount) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_extendedprice', corr(l_quantity, l_extendedprice) FROM lineitem UNION ALL SELECT 'l_discount', 'l_extendedprice', corr(l_discount, l_extendedprice) FROM lineitem)")
def corr_matrix(spark, sf_dir):
    return rounded(S.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"]))


def _frame(spark, rows, schema):
    return rounded(spark.createDataFrame(rows, schema))


@query("SELECT 'intercept' AS feature, round(regr_intercept(l_extendedprice, l_quantity), 4) AS coef FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem")
def ols_coef(spark, sf_dir):
    m = S.moments(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return rounded(spark.createDataFrame([(n, float(c)) for n, c in zip(m.names, S.coefficients(m))], "feature string, coef double"), 4)


@query("SELECT round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(1 - (1 - regr_r2(l_extendedprice, l_quantity)) * (count(*) - 1) / (count(*) - 2), 6) AS adjusted FROM lineitem")
def ols_r2(spark, sf_dir):
    m = S.moments(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return _frame(spark, [tuple(map(float, S.r_squared(m)))], "r2 double, adjusted double")


# X'X beside the unit matrix, reduced row by row; the sandwich of the groups' scores; two-sided normal p-values by Simpson's rule.
_X = "[1.0, l_quantity, l_discount, l_tax]"
_CLUSTERED = f"""WITH RECURSIVE r AS (SELECT {_X}::DOUBLE[] AS x, l_extendedprice AS y, l_suppkey AS g FROM lineitem),
 m AS (SELECT {", ".join(f"sum(x[{i}] * x[{j}]) AS x{i}{j}" for i in range(1, 5) for j in range(1, 5))}, {", ".join(f"sum(x[{i}] * y) AS y{i}" for i in range(1, 5))}, count(*) AS n, count(DISTINCT g) AS g FROM r),
 e(k, a) AS (SELECT 0, [{", ".join("[" + ", ".join([f"x{i}{j}" for j in range(1, 5)] + [str(float(i == j)) for j in range(1, 5)]) + "]" for i in range(1, 5))}] FROM m
  UNION ALL SELECT k + 1, list_transform(range(1, 5), lambda i: list_transform(range(1, 9), lambda j: CASE WHEN i = k + 1 THEN a[k + 1][j] / a[k + 1][k + 1] ELSE a[i][j] - a[i][k + 1] * a[k + 1][j] / a[k + 1][k + 1] END)) FROM e WHERE k < 4),
 v AS (SELECT list_transform(a, lambda row: row[5:8]) AS v FROM e WHERE k = 4),
 b AS (SELECT list_transform(v, lambda row: row[1] * y1 + row[2] * y2 + row[3] * y3 + row[4] * y4) AS b FROM v, m),
 u AS (SELECT g, {", ".join(f"sum(x[{i}] * (y - (b[1] + b[2] * x[2] + b[3] * x[3] + b[4] * x[4]))) AS u{i}" for i in range(1, 5))} FROM r, b GROUP BY g),
 s AS (SELECT {", ".join(f"sum(u{i} * u{j}) AS s{i}{j}" for i in range(1, 5) for j in range(1, 5))} FROM u),
 f AS (SELECT i, ['intercept', 'l_quantity', 'l_discount', 'l_tax'][i] AS feature, b[i] AS coef, sqrt(({" + ".join(f"v[i][{j}] * s{j}{k} * v[i][{k}]" for j in range(1, 5) for k in range(1, 5))}) * (g / (g - 1.0)) * ((n - 1.0) / (n - 4.0))) AS se FROM range(1, 5) t(i), v, b, s, m)
 SELECT feature, round(coef, 4) AS coef, round(se, 4) AS se, round(coef / se, 4) AS t, round(greatest(0, 1 - 2 / sqrt(pi()) * least(abs(coef / se) / sqrt(2), 6) / 6000 *
  list_sum(list_transform(range(2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(least(abs(coef / se) / sqrt(2), 6) * i / 2000, 2))))), 4) AS p FROM f"""


@query(_CLUSTERED)
def ols_cluster_se(spark, sf_dir):
    rows = S.ols(table(spark, sf_dir, "lineitem"), "l_extendedprice", FEATURES, "l_suppkey")
    return rounded(spark.createDataFrame([(r["feature"], *(None if v is None else float(v) for v in list(r.values())[1:])) for r in rows], "feature string, coef double, se double, t double, p double"), 4)


@query("WITH m AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem) SELECT l_returnflag, count(*) AS n, round(avg((l_quantity - m) / s), 6) AS z, round(max((l_quantity - m) / s), 6) AS most FROM lineitem, m GROUP BY l_returnflag")
def zscore(spark, sf_dir):
    rows = S.standardised(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), ["l_quantity"])
    return rounded(rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("z"), F.max("l_quantity").alias("most")))


@query("SELECT l_linestatus, round(avg((l_returnflag = 'A')::INTEGER), 6) AS flag_a, round(avg((l_returnflag = 'R')::INTEGER), 6) AS flag_r FROM lineitem GROUP BY l_linestatus")
def one_hot(spark, sf_dir):
    rows = S.one_hot(table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_returnflag").alias("flag")), "flag", ["A", "N", "R"], "N")
    return rounded(rows.groupBy("l_linestatus").agg(F.avg("flag_A").alias("flag_a"), F.avg("flag_R").alias("flag_r")))


@query()
def feature_select(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("twice", F.col("l_quantity") * 2)
    return spark.createDataFrame([(c,) for c in S.select_features(rows, "l_extendedprice", [*FEATURES, "twice"])], "feature string")
