"""Metrics by name, their settings, and the shapes in which they are kept: flat rows, nested objects, comparisons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bootstrap import statistics


def configured(partials: DataFrame, metrics: dict[str, list], settings: dict[str, dict], draws: int, order: list[str]) -> DataFrame:
    """metric, value, ci_lower, ci_upper, n_valid of the metrics that settings enable; ends are null where a metric's ci is off.

    metrics: name to terms, as statistics() takes them; settings: name to {"enabled", "ci"}, both on unless said otherwise."""
    on = {n: t for n, t in metrics.items() if settings.get(n, {}).get("enabled", True)}
    rows = statistics(partials, on, draws, order)
    keep = F.col("metric").isin(*(n for n in on if settings.get(n, {}).get("ci", True)))
    return rows.select("metric", "value", *(F.when(keep, F.col(c)).alias(c) for c in ("ci_lower", "ci_upper")), "n_valid")


def attempted(metrics: dict[str, Callable[[DataFrame], DataFrame]], df: DataFrame) -> dict[str, DataFrame | None]:
    """Each metric's plan; None for one whose columns df lacks."""
    from pyspark.errors import AnalysisException

    out: dict[str, DataFrame | None] = {}
    for name, f in metrics.items():
        try:
            out[name] = f(df)
        except AnalysisException:
            out[name] = None
    return out


def flattened(metrics: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """One row for each by: <name>, <name>_ci_lo, <name>_ci_hi for each of names."""
    of = lambda name, c: F.max(F.when(F.col("metric") == name, F.col(c)))
    cells = [of(n, c).alias(f"{n}{end}") for n in names for c, end in (("value", ""), ("ci_lower", "_ci_lo"), ("ci_upper", "_ci_hi"))]
    return metrics.groupBy(*by).agg(*cells) if by else metrics.agg(*cells)


def nested(metrics: DataFrame, by: list[str]) -> DataFrame:
    """One row for each by: metrics, a map from name to struct<value, ci_lower, ci_upper>; NaN is null."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    entry = F.struct("metric", F.struct(*(clean(c) for c in ("value", "ci_lower", "ci_upper"))).alias("entry"))
    return metrics.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("metrics"))


def compared(metrics: DataFrame, by: list[str], condition: str, first: str, second: str, digits: int = 6) -> DataFrame:
    """by, metric, first, second, difference: metrics that both conditions have."""
    rows = metrics.groupBy(*by, "metric").pivot(condition, [first, second]).agg(F.max("value")).na.drop(subset=[first, second])
    return rows.select(*by, "metric", F.round(first, digits).alias(first), F.round(second, digits).alias(second), F.round(F.col(first) - F.col(second), digits).alias("difference"))


def first_errors(rows: DataFrame, error: str, order: list[str], n: int = 10) -> DataFrame:
    """The first n rows with an error: a report's list."""
    return rows.filter(F.col(error).isNotNull() & (F.col(error) != "")).orderBy(*order).limit(n)


def newest_first(runs: DataFrame, *stamps: str) -> DataFrame:
    """runs by the first of stamps that each has, the latest first."""
    return runs.orderBy(F.coalesce(*stamps).desc_nulls_last(), *runs.columns[:1])


def in_first_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """key, first: its distinct values, and where each first stands."""
    return df.groupBy(key).agg(F.min(order).alias("first"))
