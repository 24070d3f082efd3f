"""Pairing, resuming, merging, choosing and reshaping. Each is one plan; nothing runs a job but the checks that say so."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .bootstrap import numbered
from .digests import low_pairs

#: Rows of a side of a cell of pairs, pairs of a task, and copies of rows that a task makes for cells; rows of a side where a cell's pairs become no rows.
CELL_SIDE, TASK_PAIRS, TASK_COPIES, DIGEST_SIDE = 1024, 1 << 24, 1 << 20, 4096


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, *key: str) -> DataFrame:
    """df, after a job that checks that key is unique in it."""
    twice = df.groupBy(*key).count().filter("count > 1").head(1)
    if twice:
        raise ValueError(f"{key} is not unique: {twice[0]}")
    return df


def many_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    return left.join(require_unique(right, *on), on, how)


def pair_sizes(left: DataFrame, right: DataFrame, on: str) -> tuple[DataFrame, int]:
    """(on, _l, _r: rows of both sides), all pairs: after a job that counts rows, not pairs."""
    sizes = left.groupBy(on).agg(F.count("*").alias("_l")).join(right.groupBy(on).agg(F.count("*").alias("_r")), on)
    sizes = written(sizes, "sizes")
    return sizes, sizes.agg(F.sum(F.col("_l") * F.col("_r"))).first()[0] or 0


def cells_within(left: DataFrame, right: DataFrame, on: str, sizes: tuple[DataFrame, int], side: int) -> tuple[DataFrame, DataFrame]:
    """left and right with the cell (on, _i, _j) of each row, partitioned by it. A group's pairs are a grid of cells of some side rows a side, each row in one
    row or column of it, and cells are dealt out over as many tasks as there are pairs for: neither a large group nor a small table is one task. A row is
    copied once for each cell of its row or column; as copies grow with the pairs, not with the table, rows are first dealt out for TASK_COPIES a task."""
    groups, total = sizes
    cores = left.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, math.ceil(total / TASK_PAIRS))
    blocks = lambda n: F.ceil(F.col(n) / side)
    copies = groups.agg(F.sum(F.col("_l") * blocks("_r")).alias("_l"), F.sum(F.col("_r") * blocks("_l")).alias("_r")).first()

    def dealt(df: DataFrame, own: str, other: str, n: str, m: str) -> DataFrame:
        rows = df.join(groups, on)
        if (copies[n] or 0) > TASK_COPIES:
            rows = rows.repartition(max(cores, math.ceil(copies[n] / TASK_COPIES)))
        rows = rows.withColumn(own, F.pmod(F.xxhash64(*df.columns), blocks(n)))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), blocks(m) - 1))).drop("_l", "_r").repartition(tasks, on, "_i", "_j")

    return dealt(left, "_i", "_j", "_l", "_r"), dealt(right, "_j", "_i", "_r", "_l")


def pairs_within(left: DataFrame, right: DataFrame, on: str, sizes: tuple[DataFrame, int] | None = None) -> DataFrame:
    """All pairs of left and right with equal on, joined cell by cell. sizes: pair_sizes()."""
    rows, others = cells_within(left, right, on, sizes or pair_sizes(left, right, on), CELL_SIDE)
    return rows.join(others, [on, "_i", "_j"]).drop("_i", "_j")


def low_pairs_within(left: DataFrame, right: DataFrame, on: str, left_key: str, right_key: str, share: float, sizes: tuple[DataFrame, int]) -> DataFrame:
    """Those of pairs_within() whose MD5 of both keys is below share of all digests, and a few above it, as 32 bits are compared. Each pair's digest is made,
    but only these pairs become rows: a cell of DIGEST_SIDE rows a side is the work of one call."""
    schema = left.join(right, on).schema
    bound = min(math.floor(share * 2**32), 2**32 - 1)
    rows, others = cells_within(left, right, on, sizes, DIGEST_SIDE)

    def low(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j = low_pairs(a["_text"].to_pylist(), b["_text"].to_pylist(), "__", bound)
        return pa.table({c: a[c].take(i) if c in a.column_names else b[c].take(j) for c in schema.names})

    rows, others = rows.withColumn("_text", F.col(left_key).cast("string")), others.withColumn("_text", F.col(right_key).cast("string"))
    return rows.groupBy(on, "_i", "_j").cogroup(others.groupBy(on, "_i", "_j")).applyInArrow(low, schema)


def pairs_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair: a stated query set (left) against all of right. Spark sends the smaller side to all only if it knows it to be small."""
    return left.crossJoin(right)


def pairs_zipped(left: DataFrame, right: DataFrame, on: str, left_key: str, right_key: str) -> DataFrame:
    """The i-th of left with the i-th of right for each value of on, both by key; the shorter side ends it. Places are those of one sort over ranges, less
    the first of the group, so a large group is no single task; rows without a group pair with none."""

    def placed(df: DataFrame, key: str) -> DataFrame:
        rows = numbered(df.filter(F.col(on).isNotNull()), on, key)
        first = rows.groupBy(on).agg(F.min("i").alias("_first"))
        return rows.join(first, on).withColumn("_rn", F.col("i") - F.col("_first")).drop("i", "_first")

    return placed(left, left_key).join(placed(right, right_key), [on, "_rn"]).drop("_rn")


def subsample(df: DataFrame, n: int, *key: str, total: int | None = None, low: Callable[[float], DataFrame] | None = None) -> DataFrame:
    """n rows by the MD5 of their key: the same on every engine, and a top-n that needs no full sort.

    With total (df's number of rows), only rows below a bound that about twice n of them keep are put in order; it is raised until n rows are below it, so
    that the n least are among them whatever the bound. low(share): rows of df with all below that share of the digests, where there is a shorter way to them."""
    hashed = lambda rows: rows.withColumn("_h", F.md5(F.concat_ws("__", *key)))
    rows = hashed(df)
    share = (n + 10 * math.sqrt(n)) / total if total else 1.0
    while share < 1:
        found = written((hashed(low(share)) if low else rows).filter(F.col("_h") < f"{math.floor(share * 16**12):012x}"), "low")
        if found.count() >= n:
            rows = found
            break
        share *= 16
    return rows.orderBy("_h", *key).limit(n).drop("_h")


def not_done(work: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    return work.join(done.select(*key).distinct(), list(key), "left_anti")


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """new's rows, and those of old whose key new does not have."""
    return new.unionByName(old.join(new.select(*key).distinct(), list(key), "left_anti"), allowMissingColumns=True)


def retry_merge(old: DataFrame, retry: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, replaced: the retry's value where it has one, else the old one; keys of either side."""
    both = old.select(key, F.col(value).alias("_o")).join(retry.select(key, F.col(value).alias("_n")), key, "full_outer")
    return both.select(key, F.coalesce("_n", "_o").alias(value), (F.col("_n").isNotNull() & F.col("_o").isNotNull()).alias("replaced"))


def latest(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """One row for each key, the last in order. max_by meets partial results before the shuffle, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(last.alias("_r")).select(*key, "_r.*")


def first_of(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def top_within(sums: DataFrame, outer: str, inner: str, value: str, n_outer: int, n_inner: int) -> DataFrame:
    """The n_inner best inner keys of each of the n_outer best outer keys, by summed value; ties by key."""
    per_inner = sums.groupBy(outer, inner).agg(F.sum(value).alias("inner_total"))
    best = per_inner.groupBy(outer).agg(F.sum("inner_total").alias("outer_total")).orderBy(F.desc("outer_total"), outer).limit(n_outer)
    rank = F.row_number().over(Window.partitionBy(outer).orderBy(F.desc("inner_total"), inner))
    return per_inner.join(best, outer).withColumn("rank", rank).filter(F.col("rank") <= n_inner)


def pivot_first(df: DataFrame, key: list[str], name: str, values: dict[str, str], value: str) -> DataFrame:
    """One column for each named value; the least non-null value of a cell, so the result does not depend on the order of rows."""
    return df.groupBy(*key).agg(*(F.min(F.when(F.col(name) == v, F.col(value))).alias(c) for v, c in values.items()))


def shown(suppress: Column, not_relevant: Column) -> Column:
    """Neither suppressed nor marked as irrelevant; an unknown suppression drops the row."""
    return (suppress != "Y") & (not_relevant.isNull() | (not_relevant != "Y"))


def detailed_code(code: Column) -> Column:
    return code.rlike(r"^\d{2}-\d{4}$") & (F.substring(code, -1, 1) != "0")


def level_matched(wanted: DataFrame, held: DataFrame, by: list[str], prefix: str, level: str) -> DataFrame:
    """wanted with matched: whether held has the same prefix at that level or a higher one. The range join is a join with a maximum."""
    best = held.groupBy(*by, prefix).agg(F.max(level).alias("_best"))
    return wanted.join(best, [*by, prefix], "left").withColumn("matched", F.coalesce(F.col("_best") >= F.col(level), F.lit(False))).drop("_best")


def union_labelled(frames: dict[str, DataFrame], label: str = "experiment") -> DataFrame:
    """All frames' rows with their name; columns that a frame lacks are null."""
    out = None
    for name, df in frames.items():
        df = df.withColumn(label, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def delete_where(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def run_source(runs: DataFrame, name: str, source: str, copied_from: str) -> DataFrame:
    """name, source: a run's own source, or that of the run it was copied from."""
    other = runs.groupBy(name).agg(F.max(source).alias("_s")).select(F.col(name).alias(copied_from), "_s")
    return runs.join(other, copied_from, "left").select(name, F.coalesce(source, "_s").alias(source))


def counterfactuals(records: DataFrame, variants: DataFrame, is_base: Column, key: str, text: str) -> DataFrame:
    """Each base record once for each variant (key, info), with the variant's signal before its text; others pass as "original"."""
    signal = F.when(F.coalesce(F.col("info"), F.lit("")) == "", F.col(text)).otherwise(F.concat("info", F.lit("\n\n"), F.col(text)))
    base = records.filter(is_base).crossJoin(F.broadcast(variants))  # a few fixed variants
    expanded = base.withColumn(text, signal).withColumn(key, F.concat(F.col(key), F.lit("::cf_"), F.col("variant")))
    rest = records.filter(~is_base).withColumns({"variant": F.lit("original"), "info": F.lit(None).cast("string")})
    return expanded.unionByName(rest.select(*expanded.columns))


def without_suffix(df: DataFrame, column: str, suffix: str) -> DataFrame:
    """Rows whose column does not end in suffix."""
    return df.filter(~F.col(column).endswith(suffix))


def without_groups(df: DataFrame, excluded: DataFrame, on: str) -> DataFrame:
    """Rows of no excluded group; rows without a group stay."""
    return df.join(excluded.select(on).distinct(), on, "left_anti")


def titled(df: DataFrame, reference: DataFrame, code: str, title: str, required: bool = False) -> DataFrame:
    """df with its own title, else the reference's (one a code), else one made of the code; with required, rows that only the last would serve go."""
    own = F.when(F.trim(title) != "", F.trim(title))
    rows = df.join(reference.select(code, F.col(title).alias("_ref")), code, "left").withColumn(title, F.coalesce(own, F.col("_ref")))
    rows = rows.filter(F.col(title).isNotNull()) if required else rows.withColumn(title, F.coalesce(title, F.concat(F.lit("Occupation "), F.col(code).cast("string"))))
    return rows.select(*df.columns)


def with_profiles(completions: DataFrame, profiles: DataFrame, sides: tuple[str, ...] = ("cv", "jd"), no_input: str = "no_input") -> DataFrame:
    """completions (cv_id, jd_id, parse_status ...) with both profiles' texts; a named id without a profile gives an empty text and no_input."""
    lacks = F.lit(False)
    for side in sides:
        found = profiles.select(F.col("profile_id").alias(f"{side}_id"), F.col("profile_text").alias(f"{side}_profile_text"))
        completions = completions.join(found, f"{side}_id", "left")
        lacks = lacks | ((F.coalesce(F.col(f"{side}_id").cast("string"), F.lit("")) != "") & F.col(f"{side}_profile_text").isNull())
    rows = completions.withColumn("parse_status", F.when(lacks, no_input).otherwise(F.col("parse_status")))
    return rows.fillna("", [f"{side}_profile_text" for side in sides])


def only(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Rows of the wanted values: over a table partitioned by column, only their files are read."""
    return df.filter(F.col(column).isin(*wanted))
