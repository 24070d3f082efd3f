"""Least squares with cluster-robust errors, correlations, standardising and feature selection.

A pass over the data gives moments (X'X, X'y, y'y), whose size depends on the number of features alone; the rest is small linear algebra.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import erfc, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null as 0, then less the mean over the deviation (n - 1); columns that do not vary are dropped. One job for the moments."""
    filled = df.fillna(0, columns)
    row = filled.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    keep = [(c, row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns) if row[f"s{i}"]]
    return filled.select(*(c for c in df.columns if c not in columns), *(((F.col(c) - m) / s).alias(c) for c, m, s in keep))


def one_hot(df: DataFrame, column: str, levels: list[str], reference: str) -> DataFrame:
    """column as 0/1 columns column_level for all levels but the reference."""
    return df.select(*(c for c in df.columns if c != column), *((F.col(column) == v).cast("double").alias(f"{column}_{v}") for v in levels if v != reference))


def source_columns(names: list[str], columns: list[str]) -> list[str]:
    """The columns that dummy names come from, each once, in order."""
    return list(dict.fromkeys(next((c for c in columns if n == c or n.startswith(c + "_")), n) for n in names))


@dataclass
class Moments:
    names: list[str]
    xx: np.ndarray
    xy: np.ndarray
    yy: float
    n: int

    def keep(self, names: list[str]) -> "Moments":
        at = [self.names.index(c) for c in names]
        return Moments(names, self.xx[np.ix_(at, at)], self.xy[at], self.yy, self.n)


INTERCEPT = "intercept"


def moments(df: DataFrame, y: str, xs: list[str]) -> Moments:
    cols: list[Column] = [F.lit(1.0), *(F.col(c).cast("double") for c in xs)]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.na.drop(subset=[y, *xs]).agg(*(F.sum(cols[i] * cols[j]).alias(f"x{i}_{j}") for i, j in pairs), *(F.sum(c * F.col(y)).alias(f"y{i}") for i, c in enumerate(cols)), F.sum(F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n")).first()
    xx = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        xx[i, j] = xx[j, i] = row[f"x{i}_{j}"] or 0.0
    return Moments([INTERCEPT, *xs], xx, np.array([row[f"y{i}"] or 0.0 for i in range(len(cols))]), row["yy"] or 0.0, row["n"])


def coefficients(m: Moments) -> np.ndarray:
    return np.linalg.lstsq(m.xx, m.xy, rcond=None)[0]


def r_squared(m: Moments) -> tuple[float, float]:
    """(R2, adjusted R2) of a model with an intercept."""
    b = coefficients(m)
    rest, total = m.yy - b @ m.xy, m.yy - m.xy[m.names.index(INTERCEPT)] ** 2 / m.n
    r2 = 1 - rest / total if total > 0 else 0.0
    k = len(b) - 1
    return r2, 1 - (1 - r2) * (m.n - 1) / (m.n - k - 1) if m.n - k - 1 > 0 else r2


def ols(df: DataFrame, y: str, xs: list[str], cluster: str | None = None) -> list[dict]:
    """feature, coef, se, t, p for the intercept and each feature. With cluster: the sandwich over its groups, with the factor
    G / (G - 1) * (n - 1) / (n - k) and normal p-values. The groups' scores are summed before they leave the executors."""
    m = moments(df, y, xs)
    b, inverse = coefficients(m), np.linalg.pinv(m.xx)
    n, k = m.n, len(b)
    if cluster is None:
        cov = inverse * max(m.yy - b @ m.xy, 0.0) / max(n - k, 1)
    else:
        cols = [F.lit(1.0), *(F.col(c).cast("double") for c in xs)]
        rest = F.col(y) - sum((float(c) * x for c, x in zip(b, cols)), F.lit(0.0))
        sums = df.na.drop(subset=[y, *xs, cluster]).withColumn("_e", rest).groupBy(cluster).agg(*(F.sum(c * F.col("_e")).alias(f"u{i}") for i, c in enumerate(cols)))
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = sums.agg(*(F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"p{i}_{j}") for i, j in pairs), F.count("*").alias("g")).first()
        meat = np.zeros((k, k))
        for i, j in pairs:
            meat[i, j] = meat[j, i] = row[f"p{i}_{j}"] or 0.0
        g = row["g"]
        cov = inverse @ meat @ inverse * (g / max(g - 1, 1)) * ((n - 1) / max(n - k, 1))
    out = []
    for name, c, v in zip(m.names, b, np.diag(cov)):
        se = sqrt(max(v, 0.0))
        t = c / se if se else float("nan")
        out.append({"feature": name, "coef": float(c), "se": se, "t": t, "p": erfc(abs(t) / sqrt(2)) if se else None})
    return out


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r: Pearson correlation of each pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("p")).select("p.*")


def select_features(df: DataFrame, y: str, xs: list[str], most_alike: float = 0.9, least_r: float = 0.0, max_drop: float = 0.01) -> list[str]:
    """xs less those that hardly correlate with y, then less the second of each too similar pair in name order, then less the
    smallest standardised coefficients as long as R2 falls by no more than max_drop in all. Data is read once, for the moments."""
    z = standardised(df.select(y, *xs), xs)
    xs = [c for c in xs if c in z.columns]
    m = moments(z, y, xs)
    scale = np.sqrt(np.diag(m.xx))
    total = sqrt(max(m.yy - m.xy[0] ** 2 / m.n, 1e-300))
    r_y = {c: abs(m.xy[i] / (scale[i] * total)) for i, c in enumerate(m.names)}
    kept: list[str] = []
    for c in sorted(c for c in xs if r_y[c] >= least_r):
        i = m.names.index(c)
        if all(abs(m.xx[i, m.names.index(o)] / (scale[i] * scale[m.names.index(o)])) < most_alike for o in kept):
            kept.append(c)
    best = r_squared(m.keep([INTERCEPT, *kept]))[0] if kept else 0.0
    while len(kept) > 1:
        b = coefficients(m.keep([INTERCEPT, *kept]))[1:]
        rest = [c for i, c in enumerate(kept) if i != int(np.argmin(np.abs(b)))]
        if best - r_squared(m.keep([INTERCEPT, *rest]))[0] > max_drop:
            break
        kept = rest
    return kept
