"""Tie-aware ranking metrics as windows and aggregates over one shuffle by query.

Rows with a null query, score or target are left out. All functions take and return DataFrames; none runs a job.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Threshold:
    """Which candidates of a query are selected.

    mode "absolute": score >= value; "top_k": the value best; "top_fraction": that share of them, rounded half to even.
    ties "expected": a block of equal scores that the cut splits shares what is left; "include" or "exclude": all or none of it.
    """

    mode: str
    value: float
    ties: str = "expected"

    def describe(self) -> str:
        return f"{self.mode}={self.value:g}" + ("" if self.mode == "absolute" else f", ties={self.ties}")

    def weight(self, score: str, *query: str) -> Column:
        """The share of a row that is selected, 0 to 1."""
        if self.mode == "absolute":
            return F.coalesce((F.col(score) >= self.value).cast("double"), F.lit(0.0))
        part = Window.partitionBy(*query)
        n = F.count(F.lit(1)).over(part)
        k = F.least(F.lit(int(self.value)) if self.mode == "top_k" else F.bround(F.lit(self.value) * n).cast("long"), n)
        above = F.rank().over(part.orderBy(F.desc(score))) - 1
        block = F.count(F.lit(1)).over(Window.partitionBy(*query, score))
        if self.ties == "include":
            return (above < k).cast("double")
        if self.ties == "exclude":
            # strictly above the k-th value; all equal to it are out
            return ((above < k) & (above + block < k)).cast("double")
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k - above) / block))


def complete(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns))


def average_rank(col: str, *query: str) -> Column:
    """Ascending rank within the query, ties sharing the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*query).orderBy(col)) + (F.count(F.lit(1)).over(Window.partitionBy(*query, col)) - 1) / 2.0


def with_gain(df: DataFrame, query: str = "jd_id", target: str = "gt", gain: str = "gain") -> DataFrame:
    return df.withColumn(gain, average_rank(target, query))


def _discounts(df: DataFrame, query: list[str], order: str, k: int | None, out: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*query).orderBy(F.desc(order)))
    one = F.lit(1.0) / F.log2(at + F.lit(1.0))
    return df.withColumn(out, one if k is None else F.when(at <= k, one).otherwise(0.0))


def ndcg_per_query(df: DataFrame, k: int | None = None, query: str | list[str] = "jd_id", score: str = "score", gain: str = "gain") -> DataFrame:
    """query columns, ndcg. A block of equal scores shares the discounts of the ranks it covers; a query without gain is left out."""
    by = [query] if isinstance(query, str) else query
    rows = _discounts(_discounts(complete(df, *by, score, gain), by, score, k, "_d"), by, gain, k, "_i")
    blocks = rows.groupBy(*by, score).agg((F.avg(gain) * F.sum("_d")).alias("_dcg"), F.sum(F.col(gain) * F.col("_i")).alias("_idcg"))
    sums = blocks.groupBy(*by).agg(F.sum("_dcg").alias("_dcg"), F.sum("_idcg").alias("_idcg"))
    return sums.filter("_idcg > 0").select(*by, (F.col("_dcg") / F.col("_idcg")).alias("ndcg"))


def errors_per_query(df: DataFrame, query: str | list[str] = "jd_id", score: str = "score", target: str = "gt") -> DataFrame:
    """query columns, n, mae, rmse."""
    by = [query] if isinstance(query, str) else query
    gap = F.col(score) - F.col(target)
    return complete(df, *by, score, target).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))


def precision_micro(df: DataFrame, predicted: Threshold, relevant: Threshold, query: str = "jd_id", score: str = "score", target: str = "gt", groups: list[str] | None = None) -> DataFrame:
    """Sum of selected and relevant shares over the sum of selected ones, over all queries; null if nothing is selected."""
    groups = groups or []
    rows = complete(df, query, score, target, *groups)
    rows = rows.withColumn("_p", predicted.weight(score, query, *groups)).withColumn("_q", relevant.weight(target, query, *groups))
    hit, all_ = F.sum(F.col("_p") * F.col("_q")), F.sum("_p")
    return rows.groupBy(*groups).agg((hit / F.nullif(all_, F.lit(0.0))).alias("precision"))


def precision_per_query(df: DataFrame, k: int, query: str | list[str] = "jd_id", score: str = "score", target: str = "gt") -> DataFrame:
    """query columns, precision: expected share of the k best by score that are among the k best by target."""
    by = [query] if isinstance(query, str) else query
    top = Threshold("top_k", k)
    rows = complete(df, *by, score, target)
    rows = rows.withColumn("_p", top.weight(score, *by)).withColumn("_q", top.weight(target, *by))
    return rows.groupBy(*by).agg((F.sum(F.col("_p") * F.col("_q")) / F.nullif(F.least(F.lit(k), F.count("*")), F.lit(0))).alias("precision"))


def unpaired_deltas(values: DataFrame, groups: list[str], metric: str, group: str = "grp") -> DataFrame:
    """contrast, delta: differences of the groups' means, each over the queries where that group has a value."""
    means = values.agg(*(F.avg(F.when(F.col(group) == g, F.col(metric))).alias(g) for g in groups))
    pairs = [F.struct(F.lit(f"{a}-{b}").alias("contrast"), (F.col(a) - F.col(b)).alias("delta")) for a, b in combinations(groups, 2)]
    return means.select(F.explode(F.array(*pairs)).alias("p")).select("p.contrast", "p.delta")


def paired_deltas(values: DataFrame, groups: list[str], metric: str, query: str = "jd_id", group: str = "grp") -> DataFrame:
    """contrast, delta, n: means over queries of the differences within a query; queries that lack a side are left out of that contrast."""
    wide = values.groupBy(query).agg(*(F.max(F.when(F.col(group) == g, F.col(metric))).alias(g) for g in groups))
    out = []
    for a, b in combinations(groups, 2):
        out.append(F.struct(F.lit(f"{a}-{b}").alias("contrast"), (F.col(a) - F.col(b)).alias("delta")))
    rows = wide.select(query, F.explode(F.array(*out)).alias("p")).select(query, "p.contrast", "p.delta")
    return rows.groupBy("contrast").agg(F.avg("delta").alias("delta"), F.count("delta").alias("n"))


def normal_interval(df: DataFrame, value: str, z: float = 1.959963984540054) -> DataFrame:
    """n, mean, low, high: mean +- z standard errors, with n - 1 degrees of freedom; both ends are the mean for n < 2."""
    half = F.coalesce(z * F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0))
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


def delta_identity(deltas: DataFrame, a: str, b: str, c: str, tolerance: float = 1e-6) -> DataFrame:
    """gap, holds: whether delta(a, b) = delta(a, c) - delta(b, c)."""
    of = lambda x, y: F.max(F.when(F.col("contrast") == f"{x}-{y}", F.col("delta")))
    return deltas.agg((of(a, b) - (of(a, c) - of(b, c))).alias("gap")).select("gap", (F.abs("gap") <= tolerance).alias("holds"))


#: Metrics by name: a function of scored rows that gives one row a query with a column of that name.
PER_QUERY = {
    "ndcg": lambda df, by: ndcg_per_query(df, query=by),
    "rmse": lambda df, by: errors_per_query(df, query=by).drop("n", "mae"),
    "mae": lambda df, by: errors_per_query(df, query=by).drop("n", "rmse"),
    "precision": lambda df, by: precision_per_query(df, 9, query=by),
}
