"""Ranking metrics, group deltas and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap as B
from ..operators import ranking as R
from .tables import GAINED, SCORED, query, ranked, rounded, scored

GROUPS = ["A", "R", "N"]


def _ndcg_sql(by: str, k: str = "1000000000") -> str:
    return f"""d AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {by} ORDER BY score DESC) <= {k} THEN 1 / log2(row_number() OVER (PARTITION BY {by} ORDER BY score DESC) + 1) ELSE 0 END AS disc,
 CASE WHEN row_number() OVER (PARTITION BY {by} ORDER BY gain DESC) <= {k} THEN 1 / log2(row_number() OVER (PARTITION BY {by} ORDER BY gain DESC) + 1) ELSE 0 END AS ideal FROM g),
 b AS (SELECT {by}, score, avg(gain) * sum(disc) AS dcg, sum(gain * ideal) AS idcg FROM d GROUP BY {by}, score),
 n AS (SELECT {by}, sum(dcg) / sum(idcg) AS ndcg FROM b GROUP BY {by} HAVING sum(idcg) > 0)"""


def _top(col: str, k: str, by: str = "jd_id") -> str:
    above = f"(rank() OVER (PARTITION BY {by} ORDER BY {col} DESC) - 1)"
    return f"greatest(0.0, least(1.0, (least({k}, count(*) OVER (PARTITION BY {by})) - {above})::DOUBLE / count(*) OVER (PARTITION BY {by}, {col})))"


def _deltas(metric: str) -> str:
    pairs = [("A", "R"), ("A", "N"), ("R", "N")]
    return " UNION ALL ".join(f"SELECT '{a}-{b}' AS contrast, round(avg(CASE WHEN grp = '{a}' THEN {metric} END) - avg(CASE WHEN grp = '{b}' THEN {metric} END), 6) AS delta FROM n" for a, b in pairs)


@query(f"WITH {GAINED}, {_ndcg_sql('jd_id', '15')} SELECT jd_id, round(ndcg, 6) AS ndcg FROM n")
def ndcg_per_query(spark, sf_dir):
    return rounded(R.ndcg_per_query(R.with_gain(ranked(spark, sf_dir)), 15))


@query(f"WITH {GAINED}, {_ndcg_sql('jd_id')} SELECT round(avg(ndcg), 6) AS ndcg, count(*) AS n FROM n")
def ndcg_mean(spark, sf_dir):
    return rounded(R.ndcg_per_query(R.with_gain(ranked(spark, sf_dir))).agg(F.avg("ndcg").alias("ndcg"), F.count("*").alias("n")))


@query(f"WITH {GAINED} SELECT jd_id, gt, gain, count(*) AS n FROM g GROUP BY ALL")
def gain_avg_rank(spark, sf_dir):
    return R.with_gain(ranked(spark, sf_dir)).groupBy("jd_id", "gt", "gain").agg(F.count("*").alias("n"))


def _weights(sql: str) -> str:
    return f"WITH {SCORED}, w AS (SELECT jd_id, score, {sql} AS weight FROM c) SELECT jd_id, score, round(weight, 6) AS weight, count(*) AS n FROM w GROUP BY ALL"


def _weighted(spark, sf_dir, threshold):
    rows = scored(spark, sf_dir) if threshold.mode == "absolute" else ranked(spark, sf_dir)
    return rows.select("jd_id", "score", F.round(threshold.weight("score", "jd_id"), 6).alias("weight")).groupBy("jd_id", "score", "weight").agg(F.count("*").alias("n"))


@query(_weights(_top("score", "5")))
def topk_probability(spark, sf_dir):
    return _weighted(spark, sf_dir, R.Threshold("top_k", 5))


@query(_weights("(rank() OVER (PARTITION BY jd_id ORDER BY score DESC) <= 5)::DOUBLE"))
def topk_include(spark, sf_dir):
    return _weighted(spark, sf_dir, R.Threshold("top_k", 5, "include"))


@query(f"WITH {SCORED}, o AS (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY score DESC) AS rn FROM c), k AS (SELECT jd_id, min(score) AS cut FROM o WHERE rn <= 5 GROUP BY jd_id) SELECT jd_id, score, (score > cut)::DOUBLE AS weight, count(*) AS n FROM c JOIN k USING (jd_id) GROUP BY ALL")
def topk_exclude(spark, sf_dir):
    return _weighted(spark, sf_dir, R.Threshold("top_k", 5, "exclude"))


@query(_weights(_top("score", "round_even(0.25 * count(*) OVER (PARTITION BY jd_id), 0)::BIGINT")))
def top_fraction(spark, sf_dir):
    return _weighted(spark, sf_dir, R.Threshold("top_fraction", 0.25))


@query(f"WITH {SCORED} SELECT jd_id, score, (score >= 6)::DOUBLE AS weight, count(*) AS n FROM c GROUP BY ALL")
def absolute_threshold(spark, sf_dir):
    return _weighted(spark, sf_dir, R.Threshold("absolute", 6))


@query(f"WITH {SCORED}, w AS (SELECT {_top('score', '5')} AS p, {_top('gt', '5')} AS q FROM c) SELECT round(sum(p * q) / sum(p), 6) AS precision FROM w")
def precision_micro(spark, sf_dir):
    top = R.Threshold("top_k", 5)
    return rounded(R.precision_micro(ranked(spark, sf_dir), top, top))


@query(f"WITH {SCORED}, w AS (SELECT jd_id, {_top('score', '9')} AS p, {_top('gt', '9')} AS q FROM c), n AS (SELECT jd_id, sum(p * q) / least(9, count(*)) AS v FROM w GROUP BY jd_id) SELECT round(avg(v), 6) AS precision, count(*) AS n FROM n")
def precision_macro(spark, sf_dir):
    return rounded(R.precision_per_query(ranked(spark, sf_dir), 9).agg(F.avg("precision").alias("precision"), F.count("*").alias("n")))


@query(f"WITH {SCORED} SELECT jd_id, count(*) AS n, round(avg(abs(score - gt)), 6) AS mae, round(sqrt(avg((score - gt) * (score - gt))), 6) AS rmse FROM c GROUP BY jd_id")
def rmse_per_query(spark, sf_dir):
    return rounded(R.errors_per_query(scored(spark, sf_dir)))


@query(f"WITH {SCORED}, n AS (SELECT jd_id, avg(abs(score - gt)) AS mae, sqrt(avg((score - gt) * (score - gt))) AS rmse FROM c GROUP BY jd_id) SELECT round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse FROM n")
def mae_rmse_overall(spark, sf_dir):
    return rounded(R.errors_per_query(scored(spark, sf_dir)).agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse")))


@query(f"WITH {GAINED}, {_ndcg_sql('jd_id, grp')} {_deltas('ndcg')}")
def ndcg_delta(spark, sf_dir):
    rows = R.with_gain(ranked(spark, sf_dir))  # gains over the whole pool, before it is cut into groups
    return rounded(R.unpaired_deltas(R.ndcg_per_query(rows, query=["jd_id", "grp"]), GROUPS, "ndcg"))


@query(f"WITH {SCORED}, n AS (SELECT jd_id, grp, sqrt(avg((score - gt) * (score - gt))) AS rmse FROM c GROUP BY jd_id, grp) {_deltas('rmse')}")
def rmse_delta(spark, sf_dir):
    return rounded(R.unpaired_deltas(R.errors_per_query(scored(spark, sf_dir), ["jd_id", "grp"]), GROUPS, "rmse"))


@query(f"WITH {SCORED}, w AS (SELECT grp, {_top('score', '2', 'jd_id, grp')} AS p, {_top('gt', '2', 'jd_id, grp')} AS q FROM c), n AS (SELECT grp, sum(p * q) / sum(p) AS v FROM w GROUP BY grp) {_deltas('v')}")
def precision_delta(spark, sf_dir):
    top = R.Threshold("top_k", 2)
    return rounded(R.unpaired_deltas(R.precision_micro(ranked(spark, sf_dir), top, top, groups=["grp"]), GROUPS, "precision"))


_PAIRED = f"WITH {SCORED}, n AS (SELECT jd_id, grp, sqrt(avg((score - gt) * (score - gt))) AS v FROM c GROUP BY jd_id, grp), w AS (SELECT jd_id, max(v) FILTER (grp = 'A') AS a, max(v) FILTER (grp = 'R') AS r, max(v) FILTER (grp = 'N') AS n FROM n GROUP BY jd_id)"


@query(f"{_PAIRED} SELECT 'A-R' AS contrast, round(avg(a - r), 6) AS delta, count(a - r) AS n FROM w UNION ALL SELECT 'A-N', round(avg(a - n), 6), count(a - n) FROM w UNION ALL SELECT 'R-N', round(avg(r - n), 6), count(r - n) FROM w")
def bias_row_deltas(spark, sf_dir):
    return rounded(R.paired_deltas(R.errors_per_query(scored(spark, sf_dir), ["jd_id", "grp"]), GROUPS, "rmse"))


@query(f"{_PAIRED} SELECT jd_id, round(a, 6) AS \"A\", round(n, 6) AS \"N\" FROM w WHERE a IS NOT NULL AND n IS NOT NULL")
def paired_wide(spark, sf_dir):
    values = R.errors_per_query(scored(spark, sf_dir), ["jd_id", "grp"])
    return rounded(values.groupBy("jd_id").pivot("grp", ["A", "N"]).agg(F.max("rmse")).na.drop())


@query(f"WITH {SCORED}, n AS (SELECT jd_id, sqrt(avg((score - gt) * (score - gt))) AS v FROM c GROUP BY jd_id) SELECT count(v) AS n, round(avg(v), 6) AS mean, round(avg(v) - 1.959963984540054 * stddev_samp(v) / sqrt(count(v)), 6) AS low, round(avg(v) + 1.959963984540054 * stddev_samp(v) / sqrt(count(v)), 6) AS high FROM n")
def normal_ci(spark, sf_dir):
    return rounded(R.normal_interval(R.errors_per_query(scored(spark, sf_dir)), "rmse"))


@query(f"WITH {SCORED}, n AS (SELECT jd_id, grp, sqrt(avg((score - gt) * (score - gt))) AS v FROM c GROUP BY jd_id, grp), m AS (SELECT avg(v) FILTER (grp = 'A') AS a, avg(v) FILTER (grp = 'R') AS r, avg(v) FILTER (grp = 'N') AS n FROM n) SELECT round(abs((a - r) - ((a - n) - (r - n))), 6) AS gap, abs((a - r) - ((a - n) - (r - n))) <= 1e-6 AS holds FROM m")
def delta_identity(spark, sf_dir):
    values = R.unpaired_deltas(R.errors_per_query(scored(spark, sf_dir), ["jd_id", "grp"]), GROUPS, "rmse")
    return R.delta_identity(values, "A", "R", "N").withColumn("gap", F.round(F.abs("gap"), 6))


@query(f"WITH {SCORED}, n AS (SELECT jd_id, sqrt(avg((score - gt) * (score - gt))) AS rmse, avg(abs(score - gt)) AS mae FROM c GROUP BY jd_id) SELECT metric, round(avg(v), 6) AS mean, count(v) AS n FROM (SELECT 'rmse' AS metric, rmse AS v FROM n UNION ALL SELECT 'mae', mae FROM n) GROUP BY metric")
def metric_means(spark, sf_dir):
    long = R.errors_per_query(scored(spark, sf_dir)).unpivot(["jd_id"], ["rmse", "mae"], "metric", "v")
    return rounded(long.groupBy("metric").agg(F.avg("v").alias("mean"), F.count("v").alias("n")))


def _mixed_sql(x: str) -> str:
    return f"list_reduce([({x})::BIGINT, 1, 1, 2], lambda a, k: CASE WHEN k = 1 THEN (xor(a, a >> 16) * {B.MIX}) % 4294967296 ELSE xor(a, a >> 16) END)"


def _boot_cte(partials: str, order: str, draws: int, columns: str, values: str, more: str = "") -> str:
    """drawn: a row for each draw, by the weights of its units; w: the values without weights."""
    cells = [c.strip() for c in columns.split(",")]
    weight = " + ".join(f"(x >= {bound})::INT" for bound in B.BOUNDS)
    return f"""WITH {SCORED}{more}, p AS ({partials}), u AS (SELECT {columns}, row_number() OVER (ORDER BY {order}, {columns}) - 1 AS i FROM p),
 l AS (SELECT *, {_mixed_sql("i % 4294967296")} AS low, {_mixed_sql("i >> 32")} AS high FROM u),
 m AS (SELECT l.*, b.b, {_mixed_sql(f"(low + (b.b + 1) * {B.STEP}) % 4294967296")} AS y FROM l CROSS JOIN range({draws}) b(b)),
 x AS (SELECT *, {_mixed_sql("xor(y, high)")} AS x FROM m),
 k AS (SELECT b, {", ".join(f"({weight}) * {c} AS {c}" for c in cells)} FROM x),
 drawn AS (SELECT b, {values} FROM k GROUP BY b), w AS (SELECT {values} FROM p)"""


def _boot_row(v: str) -> str:
    return f"round((SELECT {v} FROM w), 6) AS value, round(quantile_cont({v}::DOUBLE, 0.025), 6) AS ci_lower, round(quantile_cont({v}::DOUBLE, 0.975), 6) AS ci_upper, count({v}) AS n_valid FROM drawn"


def _boot_sql(partials: str, order: str, draws: int, more: str = "") -> str:
    return f"{_boot_cte(partials, order, draws, 'num, den', 'sum(num) / nullif(sum(den), 0)::DOUBLE AS v', more)} SELECT {_boot_row('v')}"


@query(_boot_sql("SELECT jd_id, sqrt(avg((score - gt) * (score - gt))) AS num, 1 AS den FROM c GROUP BY jd_id", "jd_id", 200))
def vector_bootstrap_ci(spark, sf_dir):
    partials = R.errors_per_query(scored(spark, sf_dir)).select("jd_id", F.col("rmse").alias("num"), F.lit(1).alias("den"))
    return rounded(B.intervals(partials, 200, ["jd_id"]))


@query(_boot_sql(f"SELECT jd_id, sum(p * q) AS num, sum(p) AS den FROM (SELECT jd_id, {_top('score', '5')} AS p, {_top('gt', '5')} AS q FROM c) GROUP BY jd_id", "jd_id", 200))
def cluster_bootstrap_ci(spark, sf_dir):
    top = R.Threshold("top_k", 5)
    rows = ranked(spark, sf_dir).withColumn("p", top.weight("score", "jd_id")).withColumn("q", top.weight("gt", "jd_id"))
    partials = rows.groupBy("jd_id").agg(F.sum(F.col("p") * F.col("q")).alias("num"), F.sum("p").alias("den"))
    return rounded(B.intervals(partials, 200, ["jd_id"]))


@query(_boot_sql("SELECT jd_id, ndcg AS num, 1 AS den FROM n", "jd_id", 200, ", " + GAINED.removeprefix(SCORED + ", ") + ", " + _ndcg_sql("jd_id", "15")))
def ndcg_bootstrap_ci(spark, sf_dir):
    values = R.ndcg_per_query(R.with_gain(ranked(spark, sf_dir)), 15)
    return rounded(B.intervals(values.select("jd_id", F.col("ndcg").alias("num"), F.lit(1).alias("den")), 200, ["jd_id"]))


_SIDES = "SELECT jd_id, " + ", ".join(f"coalesce(max(v) FILTER (grp = '{g}'), 0) AS n{g}, count(v) FILTER (grp = '{g}') AS d{g}" for g in GROUPS) + " FROM (SELECT jd_id, grp, sqrt(avg((score - gt) * (score - gt))) AS v FROM c GROUP BY jd_id, grp) GROUP BY jd_id"
_CONTRASTS = [("A", "R"), ("A", "N"), ("R", "N")]
_DIFFERENCES = ", ".join(f"sum(n{a}) / nullif(sum(d{a}), 0) - sum(n{b}) / nullif(sum(d{b}), 0) AS v{a}{b}" for a, b in _CONTRASTS)


@query(_boot_cte(_SIDES, "jd_id", 200, ", ".join(f"n{g}, d{g}" for g in GROUPS), _DIFFERENCES) + " UNION ALL ".join(f" SELECT '{a}-{b}' AS metric, {_boot_row(f'v{a}{b}')}" for a, b in _CONTRASTS))
def delta_bootstrap_ci(spark, sf_dir):
    values = R.errors_per_query(scored(spark, sf_dir), ["jd_id", "grp"])
    of = lambda g: F.when(F.col("grp") == g, F.col("rmse"))
    sides = values.groupBy("jd_id").agg(*(f(of(g)) for g in GROUPS for f in (lambda c, g=g: F.coalesce(F.max(c), F.lit(0.0)).alias(f"n{g}"), lambda c, g=g: F.count(c).alias(f"d{g}"))))
    return rounded(B.statistics(sides, {f"{a}-{b}": [(f"n{a}", f"d{a}", 1), (f"n{b}", f"d{b}", -1)] for a, b in _CONTRASTS}, 200, ["jd_id"]))


@query(_boot_cte("SELECT jd_id, sqrt(avg((score - gt) * (score - gt))) AS rmse, avg(abs(score - gt)) AS mae, 1 AS den FROM c GROUP BY jd_id", "jd_id", 100, "rmse, mae, den", "sum(rmse) / sum(den) AS v1, sum(mae) / sum(den) AS v2") + f" SELECT 'rmse' AS metric, {_boot_row('v1')} UNION ALL SELECT 'mae', {_boot_row('v2')}")
def metric_bootstrap_ci(spark, sf_dir):
    values = R.errors_per_query(scored(spark, sf_dir)).select("jd_id", "rmse", "mae", F.lit(1).alias("den"))
    return rounded(B.statistics(values, {m: [(m, "den", 1)] for m in ("rmse", "mae")}, 100, ["jd_id"]))


@query(_boot_sql("SELECT jd_id, (score - gt) * (score - gt) AS num, 1 AS den FROM c", "jd_id, num", 20))
def row_bootstrap_ci(spark, sf_dir):
    rows = scored(spark, sf_dir).select("jd_id", F.pow(F.col("score") - F.col("gt"), 2).alias("num"), F.lit(1).alias("den"))
    return rounded(B.intervals(rows, 20, ["jd_id", "num"]))
