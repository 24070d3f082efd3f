"""Bootstrap intervals from per-unit partials: a draw is a weighted sum over units, so no metric is computed again for it.

In a draw each unit gets a Poisson(1) weight, which is how often it would be drawn with replacement from a large population; the number of
units drawn varies with it, and ratios of sums don't depend on that number. The weight comes from a hash of the unit's number and the draw's, not from a
random stream, so every engine and partitioning gives the same interval. A task goes over its units once, in batches, and keeps one sum for
each draw and column: nothing of the size of draws x units is made or shuffled, and the plan is the same for any number of units.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

#: Multipliers of the hash; weights of 0, 1, 2, ... have these bounds of a number of 32 bits.
MIX, STEP = 73244475, 2654435769
BOUNDS = [math.floor((1 << 32) * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]
#: Weights that a task holds at once.
CELLS = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the numbers of 32 bits: two rounds of folding and multiplying."""
    for _ in range(2):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(MIX)
    return x ^ (x >> np.uint32(16))


def poisson_weights(units: np.ndarray, draws: int) -> np.ndarray:
    """A weight for each unit's number (row) and draw (column). Units have different seeds, whatever their number."""
    low, high = mixed((units & 0xFFFFFFFF).astype(np.uint32)), mixed((units >> 32).astype(np.uint32))
    steps = (np.arange(1, draws + 1, dtype=np.uint64) * STEP).astype(np.uint32)
    x = mixed(mixed(low[:, None] + steps) ^ high[:, None])
    out = np.zeros(x.shape, np.uint8)
    for bound in BOUNDS:
        out += x >= bound
    return out


def numbered(units: DataFrame, *order: str) -> DataFrame:
    """units with i = 0 ... n - 1 in order, as a written table: ranges number their own rows, and offsets are sums over one row a range.

    Rows that are equal in order are dealt out over ranges too; which of them comes first is open."""
    spark = units.sparkSession
    by = [*order, "_salt"]
    path = scratch(spark, "numbered")
    ranged = units.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_salt")
    ranged.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumns({"_p": F.shiftright("_at", 33), "_i": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_s"))  # one row a range
    return rows.join(starts, "_p").withColumn("i", F.col("_i") + F.col("_s")).drop("_p", "_i", "_s", "_at")


def _draw_sums(draws: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((draws, len(columns)))
        size = max(1, CELLS // draws)
        for batch in batches:
            units = batch.column(0).to_numpy()
            values = np.stack([np.nan_to_num(batch.column(1 + c).to_numpy(zero_copy_only=False).astype(np.float64)) for c in range(len(columns))], 1)
            for at in range(0, len(units), size):
                sums += poisson_weights(units[at : at + size], draws).T.astype(np.float64) @ values[at : at + size]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws, dtype=np.int64)), *(pa.array(sums[:, c]) for c in range(len(columns)))], ["b", *columns])

    return run


Term = tuple[str, str, int]


def _ratio_sum(terms: list[Term], total) -> F.Column:
    """The sum of sign * total(num) / total(den); null if any total(den) is 0."""
    out = F.lit(0.0)
    for num, den, sign in terms:
        out = out + sign * (total(num) / F.nullif(total(den).cast("double"), F.lit(0.0)))
    return out


def statistics(partials: DataFrame, wanted: dict[str, list[Term]], draws: int, order: list[str], level: float = 0.95, least_valid: int = 10) -> DataFrame:
    """metric, value, ci_lower, ci_upper, n_valid: for each wanted sum of (numerator, denominator, sign) columns' ratios, when the units
    (rows of partials) are resampled with replacement. Units are numbered by order, then by those columns; a null counts as 0.

    Without max(least_valid, 10 % of draws) valid draws the ends are null; so are all but n_valid, which is 0, without units.
    """
    columns = sorted({c for terms in wanted.values() for t in terms for c in t[:2]})
    every = list(dict.fromkeys([*order, *columns]))
    units = numbered(partials.select(*every), *every)
    pack = lambda df, *keys: df.select(*keys, *(_ratio_sum(terms, F.col).alias(name) for name, terms in wanted.items()))
    long = lambda df, *keys: df.unpivot(list(keys), list(wanted), "metric", "v")
    whole = long(pack(units.agg(*(F.sum(c).alias(c) for c in columns)))).withColumnRenamed("v", "value")
    schema = "b long, " + ", ".join(f"`{c}` double" for c in columns)
    drawn = units.select("i", *(F.col(c).cast("double").alias(c) for c in columns)).mapInArrow(_draw_sums(draws, columns), schema)
    drawn = drawn.groupBy("b").agg(*(F.sum(c).alias(c) for c in columns))
    a = (1 - level) / 2
    ends = long(pack(drawn, "b"), "b").groupBy("metric").agg(F.percentile("v", F.array(F.lit(a), F.lit(1 - a))).alias("e"), F.count("v").alias("n_valid"))
    enough = F.col("n_valid") >= max(least_valid, draws // 10)
    joined = whole.join(ends, "metric", "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
    return joined.select("metric", "value", F.when(enough, F.col("e")[0]).alias("ci_lower"), F.when(enough, F.col("e")[1]).alias("ci_upper"), "n_valid")


def intervals(partials: DataFrame, draws: int, order: list[str], num: str = "num", den: str = "den", level: float = 0.95, least_valid: int = 10) -> DataFrame:
    """value, ci_lower, ci_upper, n_valid of sum(num) / sum(den) under resampling."""
    return statistics(partials, {"value": [(num, den, 1)]}, draws, order, level, least_valid).drop("metric")


def weighted_sample(df: DataFrame, n: int | F.Column, by: list[str], weight: str, key: str, seed: str = "0") -> DataFrame:
    """n rows of each group without replacement, by exponential keys -ln(u) / weight with u from the MD5 of (seed, key); ties by key.

    Rows without a positive weight are last, so they are taken only if a group has too few others; if no row has one, all weigh the same.
    """
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967297.0)
    totals = df.groupBy(*by).agg((F.sum(weight) > 0).alias("_any"))
    w = F.when(F.col("_any"), F.col(weight)).otherwise(F.lit(1.0))
    drawn = df.join(totals, by).withColumn("_k", F.when(w > 0, -F.log(u) / w)).drop("_any")
    at = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_k").asc_nulls_last(), key))
    return drawn.withColumn("_at", at).filter(F.col("_at") <= n).drop("_k", "_at")
