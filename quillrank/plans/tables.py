"""The domain's tables out of the driver's: scored candidates, profiles, graphs and completions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task of a partitioned table holds.
TASK_ROWS = 200_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out evenly if they come in no more parts than there are cores, as those of a small or unsplit file do; work on each row is then shared.

    Larger inputs come in more parts than that and stay where they are, so no more than a part a core is moved."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() <= cores else rows


def dealt(rows: DataFrame, n: int, *by: str | Column) -> DataFrame:
    """rows partitioned by some columns into tasks of about TASK_ROWS of n rows. Their number grows with the input, where Spark would take as many as there
    are cores and let the memory of a task grow; what goes by these columns, or more, needs no further shuffle."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / TASK_ROWS)), *by)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jd_id, grp, score, gt: candidates of a query, in three groups."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_partkey").alias("jd_id"),
        F.col("l_returnflag").alias("grp"),
        F.round(1 + 9 * (F.col("l_quantity") - 1) / 49).alias("score"),
        (1 + 90 * F.col("l_discount")).alias("gt"),
    )


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored() partitioned by jd_id, for windows within a query; the rows are counted out of the files' footers."""
    return dealt(scored(spark, sf_dir), table(spark, sf_dir, "lineitem").count(), "jd_id")


SCORED = "c AS (SELECT l_partkey AS jd_id, l_returnflag AS grp, round(1 + 9 * (l_quantity - 1) / 49) AS score, 1 + 90 * l_discount AS gt FROM lineitem)"
GAINED = SCORED + ", g AS (SELECT *, rank() OVER (PARTITION BY jd_id ORDER BY gt) + (count(*) OVER (PARTITION BY jd_id, gt) - 1) / 2.0 AS gain FROM c)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums of doubles depend on the order of rows in the last places."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
