"""Connected components by alternating large-star and small-star, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, tuple]:
    """One star step over edges (hi > lo), and a mark by which equal edges are known. The minima are written before they are joined, so that Spark can split the rows of a
    node with very many neighbours."""
    pairs = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    if large:
        pairs = pairs.union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    low = written(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "cc-min")
    joined = pairs.join(low, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        out = joined.filter("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(low.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    seen = Observation()
    out = out.filter("hi > lo")  # repeats are harmless, and go once a round
    out = out if large else out.distinct()
    out = written(out.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("mark")), "cc-edges")
    return out, tuple(seen.get.values())


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node that has an edge. edges: any two integer columns; loops, repeated
    edges and nulls are left out."""
    a, b = (F.col(c).cast("long") for c in edges.columns[:2])
    now = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter(a.isNotNull() & b.isNotNull() & (a != b))
    now = written(now.distinct(), "cc-edges")
    mark = None
    while True:
        now, new = _star(_star(now, True)[0], False)
        if new == mark:
            break
        mark = new
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
