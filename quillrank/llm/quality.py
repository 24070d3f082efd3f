"""Quality classifier by positive-unlabelled learning.

Trusted positives are texts that the labels call good; unlabelled ones are any web texts. The classifier minimises the non-negative
risk  prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))  with the logistic loss over counts and shares of
characters, words and lines of the whole text, by STEPS steps of L-BFGS (to stop early keeps the weights small). The class prior is
estimated from positives and unlabelled texts alone: a classifier that tells them apart is fitted on half of each, and over its thresholds
on the other half, the least ratio of the unlabelled share above to the positives' share above, with a margin for small counts, bounds the prior
(best-bin estimation). Labels other than 1 are never read.

Features are measured once, for all rows with an id that are not held out (crc32 of the id as text, modulo 5, is 0), and kept as a table. Their means
and deviations, the class prior and the unlabelled part of the risk rest on all these rows: each step of the fit is a job whose tasks sum the loss and
its gradient over their rows, and the driver gets some 50 numbers a task. At most about MAX_ROWS labelled positives, chosen by a hash of the id, are
fitted on; that is the only bound. Ids, languages, sources and labels are no inputs of a score.

Null texts are empty and get the score of an empty text. Rows without an id are not held out and never fitted on. Repeated labels of an id
count once each. Without a usable label all texts are taken as good (score 1). Repeated rows get a row each, and equal texts equal scores.
A text of any length is scored whole, in one pass. An empty table gives no rows. Other columns are not read by score_quality(), and kept by
keep_good(), whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, tune, written

MAX_ROWS = 12_000
THRESHOLD = 0.3
STEPS, HALVINGS, TOLERANCE, DECAY = 10, 12, 1e-6, 1e-3
#: Width of the bend by which the risk is kept from below zero.
BEND = 2e-3
#: Features are summed as whole multiples of 1 / UNIT, exactly, so that the order of rows doesn't show in the sums.
UNIT = 1 << 30
_SIGNS = [bytes([c]) for c in b"#&*%$!|?.,:;/<>=()[]{}@_-\"'+~^\\"]


def features(text: str) -> list[float]:
    """Shares and logarithms of counts over the whole text; all are finite for any text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    words = raw.lower().split()
    count = max(1, len(words))
    lines = raw.split(b"\n")
    kinds = set(words)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    plain = np.frombuffer(raw, np.uint8) if raw else np.zeros(1, np.uint8)
    upper = float(np.count_nonzero((plain >= 65) & (plain <= 90)))
    lower = float(np.count_nonzero((plain >= 97) & (plain <= 122)))
    digits = float(np.count_nonzero((plain >= 48) & (plain <= 57)))
    signs = [raw.count(s) / count for s in _SIGNS]
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1
    return [
        np.log1p(len(words)),
        np.log1p(len(words)) ** 2,
        upper / n,
        lower / n,
        digits / n,
        float(np.count_nonzero(plain >= 128)) / n,
        np.log(len(kinds) + 1) / np.log(len(words) + 2),
        len(kinds) / count,
        pairs / max(1, len(words) - 1),
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        len(set(lines)) / len(lines),
        np.log1p(len(lines)),
        (raw.count(b" ") + raw.count(b"\t")) / n,
        sum(signs),
        min(sum(signs), 1.0),
        *signs,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _minimised(value, w: np.ndarray) -> np.ndarray:
    """L-BFGS with halved steps. value: a function of the weights that gives the risk and its gradient, at the cost of a pass over all rows."""
    risk, g = value(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        d, kept = -g, []
        for s, y in reversed(pairs):
            kept.append((s @ d) / (s @ y))
            d = d - kept[-1] * y
        if pairs:
            d = d * (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for (s, y), a in zip(pairs, reversed(kept)):
            d = d + (a - (y @ d) / (s @ y)) * s
        slope, t = d @ g, 1.0 if pairs else min(1.0, 1 / max(1e-12, np.abs(g).sum()))
        if slope > -1e-9:
            break
        for _ in range(HALVINGS):
            new, h = value(w + t * d)
            if new <= risk + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        if t * d @ (h - g) > 1e-12:
            pairs = [*pairs[-9:], (t * d, h - g)]
        gain, w, risk, g = risk - new, w + t * d, new, h
        if gain < TOLERANCE:
            break
    return w


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _inputs(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]


class InMemory:
    """Unlabelled rows as an array of inputs."""

    def __init__(self, u: np.ndarray):
        self.u = u

    def rows(self, half: int | None = None) -> int:
        return len(self.u if half is None else self.u[half::2])

    def loss(self, w: np.ndarray, half: int | None = None) -> tuple[float, np.ndarray]:
        """Means of log(1 + exp(f)) and of its gradient, over all rows or every second one."""
        u = self.u if half is None else self.u[half::2]
        loss, gradient = _totals(u, w)
        return loss / (_FINE * len(u)), gradient / (_FINE * len(u))

    def above(self, w: np.ndarray, at: np.ndarray, half: int) -> np.ndarray:
        """The share of a half's rows at or above each of the values at, in rising order."""
        return _at_or_above(self.u[half::2], w, at) / max(1, self.rows(half))


#: Terms of the risk and of its gradient are summed as whole multiples of 1 / _FINE, so that the order of rows and tasks doesn't show.
_FINE = 1 << 24


def _outputs(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip((u * w).sum(axis=1), -30, 30)


def _totals(u: np.ndarray, w: np.ndarray) -> tuple[int, np.ndarray]:
    f = _outputs(u, w)
    return int(np.rint(np.logaddexp(0, f) * _FINE).astype(np.int64).sum()), np.rint(u * _sigmoid(f)[:, None] * _FINE).astype(np.int64).sum(axis=0)


def _at_or_above(u: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
    bins = np.bincount(np.searchsorted(at, _outputs(u, w), "right"), minlength=len(at) + 1)
    return np.cumsum(bins[::-1])[::-1][1:]


def class_prior(p: np.ndarray, u: np.ndarray | InMemory) -> float:
    """The share of positives among the unlabelled rows u, given positives p (both standardised): a bound from the best threshold."""
    u = InMemory(u) if isinstance(u, np.ndarray) else u
    if len(p) < 4 or u.rows() < 4 or not u.rows(0) or not u.rows(1):
        return 0.5
    p, own = p[::2], p[1::2]

    def value(w):
        f, (loss, gradient) = p @ w, u.loss(w, 0)
        return np.logaddexp(0, -f).mean() + loss + DECAY / 2 * (w[:-1] @ w[:-1]), p.T @ (_sigmoid(f) - 1) / len(p) + gradient + DECAY * np.r_[w[:-1], 0]

    w = _minimised(value, np.zeros(p.shape[1]))
    at = np.sort(_outputs(own, w))
    above_p = 1 - np.searchsorted(at, at, "left") / len(at)
    above_u = u.above(w, at, 1)
    margin = np.sqrt(np.log(4 / 0.1) / 2) * (len(own) ** -0.5 + u.rows(1) ** -0.5)
    best = int(np.argmin((above_u + margin) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """The logistic model of least non-negative risk over arrays of features; see fit_to()."""
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    return fit_to(positive, InMemory(_inputs(unlabelled, mean, scale)), mean, scale, prior)


def fit_to(positive: np.ndarray, u: InMemory, mean: np.ndarray, scale: np.ndarray, prior: float | None = None) -> Model:
    """The logistic model of least non-negative risk; prior: else estimated. u: unlabelled rows, in memory or as a table, of which only sums
    are asked for."""
    p = _inputs(positive, mean, scale)
    prior = class_prior(p, u) if prior is None else prior

    def value(w):
        f, (loss, gradient) = np.clip(p @ w, -30, 30), u.loss(w)
        good, bad = prior * np.logaddexp(0, -f).mean(), loss - prior * np.logaddexp(0, f).mean()
        kept = BEND * np.logaddexp(0, bad / BEND)  # max(0, bad), but smooth at 0
        g = prior * p.T @ (_sigmoid(f) - 1) / len(p) + _sigmoid(bad / BEND) * (gradient - prior * p.T @ _sigmoid(f) / len(p))
        return good + kept + DECAY / 2 * (w[:-1] @ w[:-1]), g + DECAY * np.r_[w[:-1], 0]

    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    return Model(mean, scale, _minimised(value, w), prior)


def _measure(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([features(t) for t in b.column(2).to_pylist()], pa.list_(pa.float64()))], ["positive", "half", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _sums(batches):
    """One row: the number of rows, and the sums of their features and of the features' squares."""
    n, first, second = 0, 0, 0
    for b in batches:
        if b.num_rows:
            x = np.rint(_matrix(b.column(0)) * UNIT).astype(np.int64).astype(object)
            n, first, second = n + len(x), first + x.sum(axis=0), second + (x * x).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.array([[str(v) for v in s]], pa.list_(pa.string())) for s in (first, second))], ["n", "first", "second"])


def moments(measured: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and deviation of each feature (x) over all rows; None without rows. A few numbers a task go to the driver."""
    got = measured.select("x").mapInArrow(_sums, "n long, first array<string>, second array<string>").collect()
    if not got:
        return None
    n = sum(r["n"] for r in got)
    first, second = ([sum(map(int, c)) for c in zip(*(r[k] for r in got))] for k in ("first", "second"))
    return np.array([a / (n * UNIT) for a in first]), np.array([(max(0, n * b - a * a) / (n * UNIT) ** 2) ** 0.5 for a, b in zip(first, second)])


class Table:
    """Unlabelled rows as a written table of features (half, x): each question is a job whose tasks sum over their rows. What goes to the driver is a few
    numbers a task, or one for each threshold."""

    def __init__(self, measured: DataFrame, mean: np.ndarray, scale: np.ndarray):
        self.rows_of, self.mean, self.scale = measured, mean, scale
        counts = {r["half"]: r["count"] for r in measured.groupBy("half").count().collect()}
        self.counts = {0: counts.get(0, 0), 1: counts.get(1, 0), None: sum(counts.values())}

    def rows(self, half: int | None = None) -> int:
        return self.counts[half]

    def _batches(self, half: int | None):
        mean, scale = self.mean, self.scale
        return (self.rows_of if half is None else self.rows_of.filter(F.col("half") == half)).select("x"), lambda b: _inputs(_matrix(b.column(0)), mean, scale)

    def loss(self, w: np.ndarray, half: int | None = None) -> tuple[float, np.ndarray]:
        rows, inputs = self._batches(half)

        def run(batches):
            loss, gradient = 0, np.zeros(len(w), np.int64)
            for b in batches:
                if b.num_rows:
                    more, g = _totals(inputs(b), w)
                    loss, gradient = loss + more, gradient + g
            yield pa.RecordBatch.from_arrays([pa.array([loss], pa.int64()), pa.array([gradient.tolist()], pa.list_(pa.int64()))], ["loss", "gradient"])

        got = rows.mapInArrow(run, "loss long, gradient array<long>").collect()
        n = _FINE * max(1, self.rows(half))
        return sum(r["loss"] for r in got) / n, np.array([sum(c) / n for c in zip(*(r["gradient"] for r in got))])

    def above(self, w: np.ndarray, at: np.ndarray, half: int) -> np.ndarray:
        rows, inputs = self._batches(half)

        def run(batches):
            found = np.zeros(len(at), np.int64)
            for b in batches:
                if b.num_rows:
                    found += _at_or_above(inputs(b), w, at)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at))), pa.array(found)], ["i", "n"])

        got = rows.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).orderBy("i").collect()  # one row a threshold
        return np.array([r["n"] for r in got]) / max(1, self.rows(half))


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _some(df: DataFrame, n: int) -> DataFrame:
    """At most about n rows, by a hash of doc_id that has nothing to do with the folds."""
    total = df.count()
    return df if total <= n else df.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int(n / total * (1 << 30)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    """The model, or None if no label is usable. docs: doc_id, text; labels: doc_id, quality. max_rows bounds the labelled positives; the
    unlabelled rows are all those not held out."""
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).filter(~held_out() & F.col("doc_id").isNotNull()).distinct()
    rows = docs.select("doc_id", "text").filter(~held_out() & F.col("doc_id").isNotNull())
    chosen = written(_some(good, max_rows).withColumn("positive", F.lit(True)), "quality-positives")  # bounded by max_rows, so it can be sent to all
    if not chosen.head(1):
        return None
    half = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(2)).cast("int")
    flagged = rows.join(F.broadcast(chosen), "doc_id", "left").select(F.coalesce("positive", F.lit(False)).alias("positive"), half.alias("half"), "text")
    measured = written(flagged.mapInArrow(_measure, "positive boolean, half int, x array<double>"), "quality-features")
    found = moments(measured)
    positive = measured.filter("positive").select("x").toArrow()
    if found is None or not positive.num_rows:
        return None
    x = _matrix(positive.column("x").combine_chunks())
    mean, scale = found[0], np.where(found[1] > 1e-9, found[1], 1.0)
    return fit_to(x[np.lexsort(x.T)], Table(measured, mean, scale), mean, scale)  # the order of rows must not show


def _scorer(model: Model | None, at: int):
    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            if model is None:
                s = np.ones(len(texts))
            else:
                s = model.scores(np.array([features(t) for t in texts]).reshape(len(texts), -1)) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "score"])

    return run


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    tune(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs."""
    rows = _prepared(docs, id_col, text_col)
    scored = rows.mapInArrow(_scorer(train(rows, labels), 1), "doc_id long, text string, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches threshold."""
    model = train(_prepared(docs, id_col, text_col), labels)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", score double"
    kept = rows.mapInArrow(_scorer(model, docs.columns.index(text_col)), schema).filter(F.col("score") >= threshold)
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
