"""Line dedup: winnowing over line hashes.

A line is hashed with its white space collapsed. From each line on, the shortest run of lines with NOISE_WORDS words is a shingle; from each
line on, the shingles inside the shortest run with RUN_WORDS words are a window, and the least shingle hash of each window is a
fingerprint. Two equal runs of RUN_WORDS words share a window and so a fingerprint. Around the fingerprints that occur more than once, the
shortest runs with RUN_WORDS words from each line on, and those up to each line, are keyed by a hash of all their lines, and each that has
an equal one at an earlier place (by document id, then line) is deleted. Every line of a longer repeated run is in such a run inside it, so
exactly the lines are deleted that lie in a run of RUN_WORDS words with an equal one at any earlier place. The first copy stays.

Null texts stay null and empty ones empty; a text whose every line is a repeat becomes empty, and its row stays. Rows that share an id
and a text are one document and get the same text. Rows without an id come first in the order. All columns are kept; only the
text changes. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune, written

NOISE_WORDS, RUN_WORDS = 25, 50


def line_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of words of each line."""
    words = [x.split() for x in text.split("\n")]
    hashes = [int.from_bytes(hashlib.blake2b(" ".join(w).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for w in words]
    return np.array(hashes, np.int64), np.array([len(w) for w in words], np.int64)


def fingerprints(hashes: np.ndarray, words: np.ndarray, noise: int = NOISE_WORDS, run: int = RUN_WORDS) -> list[tuple[int, int]]:
    """(first line, hash) of the shingles that are the least of a window, the last of equal ones."""
    total = np.r_[0, np.cumsum(words)]
    ends = np.searchsorted(total, total[:-1] + noise, "left")  # of the shingle from each line on
    shingles = [int.from_bytes(hashlib.blake2b(hashes[i:e].tobytes(), digest_size=8).digest(), "little", signed=True) if e < len(total) else None for i, e in enumerate(ends)]
    stops = np.searchsorted(total, total[:-1] + run, "left")
    out = set()
    for i, stop in enumerate(stops):
        if stop >= len(total):
            break
        out.add(min(((shingles[j], -j) for j in range(i, stop) if ends[j] <= stop)))
    return sorted((-j, h) for h, j in out)


def least_runs(words: np.ndarray, run: int = RUN_WORDS) -> list[tuple[int, int]]:
    """The runs [first, end) of lines that are the shortest with run words from their first line on, or up to their last."""
    total = np.r_[0, np.cumsum(words)]
    ends = np.searchsorted(total, total[:-1] + run, "left")
    firsts = np.searchsorted(total, total[1:] - run, "right") - 1
    return sorted({(i, e) for i, e in enumerate(ends.tolist()) if e < len(total)} | {(i, e) for e, i in enumerate(firsts.tolist(), 1) if i >= 0})


def _scan(batches):
    """Documents' line arrays and fingerprints."""
    kind = pa.list_(pa.struct([("pos", pa.int64()), ("fp", pa.int64())]))
    for b in batches:
        rows = []
        for text in b.column(2).to_pylist():
            h, w = line_hashes(text)
            rows.append((h.astype("<i8").tobytes(), w.astype("<i8").tobytes(), [{"pos": p, "fp": f} for p, f in fingerprints(h, w)]))
        cols = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], kind)], ["id", "h", "lines", "words", "fps"])


def _runs(batches):
    """The least runs that hold the first line of one of their document's places, each keyed by its lines."""
    for b in batches:
        out = []
        for i, h, places, lines, words in zip(*(c.to_pylist() for c in b.columns)):
            hashes, places = np.frombuffer(lines, "<i8"), np.sort(places)
            for a, e in least_runs(np.frombuffer(words, "<i8")):
                if np.searchsorted(places, a) < np.searchsorted(places, e):
                    out.append((i, h, a, e, hashlib.blake2b(hashes[a:e].tobytes(), digest_size=16).digest()))
        for k in range(0, len(out), 10_000):
            cols = list(zip(*out[k : k + 10_000]))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], ["id", "h", "first", "end", "key"])


def _rewrite(batches):
    for b in batches:
        out = []
        for text, gone in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
            if gone:
                drop = {i for r in gone for i in range(r["first"], r["end"])}
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
            out.append(text)
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out, pa.string())], b.schema.names[:-1])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, h (hash of the text), gone: the runs (first, end) of lines of each document that repeat earlier ones."""
    tune(docs.sparkSession)
    rows = docs.select(*_key(id_col, text_col), F.col(text_col).alias("text")).filter("text is not null and text <> ''")
    scanned = written(rows.mapInArrow(_scan, "id long, h long, lines binary, words binary, fps array<struct<pos:bigint,fp:bigint>>"), "lines")
    marks = scanned.select("id", "h", F.explode("fps").alias("f")).select("id", "h", F.col("f.pos").alias("pos"), F.col("f.fp").alias("fp"))
    shared = written(marks.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"), "line-shared")
    places = written(marks.join(shared.hint("merge"), "fp").groupBy("id", "h").agg(F.collect_set("pos").alias("places")), "line-places")
    arrays = scanned.groupBy("id", "h").agg(F.max("lines").alias("lines"), F.max("words").alias("words"))
    both = arrays.join(places.hint("merge"), ["id", "h"]).select("id", "h", "places", "lines", "words")
    runs = written(both.mapInArrow(_runs, "id long, h long, first long, end long, key binary"), "line-runs")
    place = F.struct("id", "h", "first")
    sources = written(runs.groupBy("key").agg(F.min(place).alias("s"), F.count("*").alias("n")).filter("n > 1").select("key", "s"), "line-sources")
    later = runs.join(sources.hint("merge"), "key").filter(place > F.col("s"))
    return later.groupBy("id", "h").agg(F.collect_list(F.struct("first", "end")).alias("gone"))


def _key(id_col: str, text_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text_col).alias("h")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the later copies of repeated runs of lines deleted from its text."""
    gone = written(repeated_lines(docs, id_col, text_col), "lines-gone")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    i, h = _key(id_col, text_col)
    keyed = docs.select(i.alias("_id"), h.alias("_h"), *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)))
    # a merge at every size: one plan, whose needs follow the input
    rows = keyed.join(gone.hint("merge"), (keyed._id == gone.id) & (keyed._h == gone.h), "left")
    rest = [n for n in names if n != names[at]]
    rows = rows.select(*rest, names[at], "gone")
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(_rewrite, schema).select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
