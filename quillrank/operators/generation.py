"""Requests for a model and what comes back: batches, results, next steps and the final records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import completions as C
from ..functions import text as X
from ..session import written


def requests(occupations: DataFrame, styles: DataFrame, n: int, batch: str, occ: str = "occ") -> DataFrame:
    """custom_id, side, occ, style, idx: n profiles a side for each occupation and style. Of 2 n numbers the first half are queries."""
    rows = occupations.select(occ).crossJoin(F.broadcast(styles)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(2 * n - 1))))
    side = F.when(F.col("_i") < n, "jd").otherwise("cv")
    rows = rows.select(side.alias("side"), occ, "style", (F.col("_i") % n).alias("idx"))
    return rows.select(F.concat_ws("::", "side", F.lit(batch), F.col(occ).cast("string"), "style", F.col("idx").cast("string")).alias("custom_id"), "side", occ, "style", "idx")


def compact(key: Column) -> Column:
    """The key as a batch API takes it."""
    return X.encoded_id(key)


def compiled(results: DataFrame, dictionary: DataFrame) -> DataFrame:
    """results' texts with the dictionary's columns, joined by the compact form of its keys; results without a key are left out."""
    keys = dictionary.withColumn("id", compact(F.col("custom_id")))
    return results.join(keys, "id").drop("id")


def outcomes(inputs: DataFrame, results: DataFrame) -> DataFrame:
    """custom_id, category: success, or what went wrong by an error's own message or else by "HTTP <code>"; missing for inputs without a result."""
    failed = ~F.col("status_code").eqNullSafe(F.lit(200))
    code = F.concat(F.lit("HTTP "), F.coalesce(F.col("status_code").cast("string"), F.lit("None")))
    error = F.coalesce(F.nullif(F.col("error"), F.lit("")), F.when(failed, code))
    found = results.select("custom_id", error.alias("_e"), F.lit(True).alias("_found"))
    rows = inputs.select("custom_id").join(found, "custom_id", "left")
    return rows.select("custom_id", X.failure_category(F.col("_e"), F.col("_found").isNotNull()).alias("category"))


def next_requests(results: DataFrame, template: str, text: str = "text") -> DataFrame:
    """custom_id, prompt for the results that hold a JSON object, in place of the template's {input}."""
    body = C.first_object(C.without_fence(F.col(text)))
    before, _, after = template.partition("{input}")
    return results.filter(body != "").select("custom_id", F.concat(F.lit(before), body, F.lit(after)).alias("prompt"))


def sampled_profiles(items: DataFrame, n_profiles: int, n_items: int, by: list[str], weight: str, key: str, seed: str = "0") -> DataFrame:
    """by, profile, key: n_items of each group for each of n_profiles, drawn by weight squared without replacement."""
    from .bootstrap import weighted_sample

    rows = items.withColumn("profile", F.explode(F.sequence(F.lit(0), F.lit(n_profiles - 1)))).withColumn("_w", F.col(weight) * F.col(weight))
    rows = rows.withColumn("_key", F.concat_ws("/", F.col("profile").cast("string"), F.col(key).cast("string")))
    return weighted_sample(rows, n_items, [*by, "profile"], "_w", "_key", seed).select(*by, "profile", key)


def built_profiles(items: DataFrame, wanted: dict[str, int], n_profiles: int, by: list[str], kind: str, code: str, weight: str, seed: str = "0", valid: Column | None = None, max_fails: int = 3) -> tuple[DataFrame, DataFrame]:
    """(by, profile, kind, code and attempt of the profiles' items, by and profile of those that could not be filled).

    Each of n_profiles of a group holds wanted[kind] items of each kind, or all if there are fewer, drawn by weight squared without replacement; kinds that
    aren't wanted are left out. A draw fails if it has to take an item without a weight while others of its kind have one, or if valid, an
    aggregate over its items, is not true. Failed profiles alone are drawn again, max_fails times at most, and the rest is reported."""
    from .bootstrap import weighted_sample

    n = F.coalesce(*(F.when(F.col(kind) == k, F.lit(v)) for k, v in wanted.items()))
    rows = items.filter(F.col(kind).isin(*wanted)).select(*by, kind, code, weight, F.max(F.coalesce(F.col(weight) > 0, F.lit(False))).over(Window.partitionBy(*by, kind)).alias("_weighed"), n.alias("_n"), *(c for c in items.columns if c not in (*by, kind, code, weight)))
    todo = rows.select(*by).distinct().withColumn("profile", F.explode(F.sequence(F.lit(0), F.lit(n_profiles - 1))))
    built = None
    for attempt in range(max_fails + 1):
        drawn = todo.join(rows, by).withColumn("_w", F.col(weight) * F.col(weight))
        drawn = drawn.withColumn("_key", F.concat_ws("/", F.lit(str(attempt)), *(F.col(c).cast("string") for c in ("profile", kind, code))))
        drawn = written(weighted_sample(drawn, F.col("_n"), [*by, "profile", kind], "_w", "_key", seed), "drawn")
        filled = F.bool_and(F.coalesce(F.col(weight) > 0, F.lit(False)) | ~F.col("_weighed"))
        good = drawn.groupBy(*by, "profile").agg((filled if valid is None else filled & valid).alias("_ok")).filter("_ok").drop("_ok")
        kept = drawn.join(good, [*by, "profile"], "left_semi").select(*by, "profile", kind, code, F.lit(attempt).alias("attempt"))
        built = kept if built is None else built.unionByName(kept)
        todo = written(todo.join(good, [*by, "profile"], "left_anti"), "unfilled")
        if not todo.head(1):
            break
    return built, todo


def minted_names(names: DataFrame, taken: DataFrame) -> DataFrame:
    """name, run_name: name itself, or with (i) after it where that many of that name are taken."""
    used = taken.groupBy("name").agg(F.count("*").alias("_n"))
    at = F.row_number().over(Window.partitionBy("name").orderBy("name")) - 1
    rows = names.withColumn("_i", at).join(used, "name", "left").withColumn("_i", F.col("_i") + F.coalesce("_n", F.lit(0)))
    return rows.select("name", F.when(F.col("_i") == 0, F.col("name")).otherwise(F.concat("name", F.lit("("), F.col("_i").cast("string"), F.lit(")"))).alias("run_name"))
