"""MinHash near-dedup: universal hash minima, banding, signature and full-set verification, connected components.

Letters A-Z are lower-cased and words are runs of bytes other than blank and \\t\\n\\v\\f\\r. A document's set holds its distinct shingles
of k words (all its words as one, if it has fewer), as 64-bit hashes. Documents with equal sets form a class, and the smallest
id stands for it. BANDS x ROWS minima of (a x + b) mod 2^64 are cut into bands; classes that share a band's minima are candidates,
verified by their signatures and then on their full sets.

No bucket is expanded into all its pairs at first. In a small bucket, a spanning forest of the candidate pairs is verified, most alike
first; in a large one, its smallest member with each other. Then every candidate pair that still lies in two components is verified
in blocks of bounded size, which give out only links, so each candidate pair is either verified or inside one component.

Null or empty texts and such of white space only have an empty set and link with nothing. Rows without an id are returned with a null
component and link with nothing. Rows that share an id are taken each by its own text;
classes that the same id stands for are one node. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, tune, written
from .components import connected_components

BANDS, ROWS = 24, 5
#: Pairs whose share of equal minima is below this are not candidates: a pair at 0.8 is so with probability 1.6e-10, far less than the 7.3e-5 that
#: no band finds it.
LEAST_ALIKE = 0.55
#: Members of a bucket, or of each half of a block of a larger bucket, that meet in one step.
BLOCK = 256
#: Members of each half of a block when full sets are at hand.
OPEN_BLOCK = 1024
#: Bytes of full sets in each half of a block, about.
BLOCK_BYTES = 8 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 ... n of the base and of its inverse mod 2^64."""
    if len(_POWERS[0]) <= n:
        inverse = pow(_BASE, -1, 1 << 64)
        for i, base in enumerate((_BASE, inverse)):
            p = np.full(2 * n + 1, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _constants(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, words: int) -> np.ndarray:
    """The sorted distinct hashes of text's shingles."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    word = _mix((sums[ends] - sums[starts]) * inverse[starts])
    n = len(word)
    factors = _constants(1, max(words, 1))
    if n < words:
        return _mix((word * factors[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = np.zeros(n - words + 1, np.uint64)
    for i in range(words):
        total += word[i : i + len(total)] * factors[i]
    return np.unique(_mix(total + np.uint64(words)))


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of ((a x + b) mod 2^64) >> 32 over the upper halves x of the hashes: a strongly universal family."""
    x = hashes >> np.uint64(32)
    low = np.full(len(a), ~np.uint64(0))
    for i in range(0, len(x), 1024):
        v = np.multiply.outer(a, x[i : i + 1024])
        v += b[:, None]
        np.minimum(low, v.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def _features(words: int):
    def run(batches):
        a, b = _constants(2, BANDS * ROWS), _constants(3, BANDS * ROWS)
        for batch in batches:
            n, digests, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words)
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    return run


def _bands(batches):
    for batch in batches:
        sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, BANDS, ROWS).astype(np.uint64)
        keys = np.zeros(sigs.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for i in range(ROWS):
            keys = _mix(keys * np.uint64(_BASE) + sigs[:, :, i])
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(ids)], ["bucket", "rep"])


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(y)), np.float32)
    for i in range(len(x)):
        out[i] = (x[i] == y).mean(axis=1)
    return out


def forest(ids: np.ndarray, sigs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the candidate pairs, most alike first."""
    like = np.triu(_alike(sigs, sigs), 1)
    i, j = np.nonzero(like >= LEAST_ALIKE)
    order = np.argsort(-like[i, j], kind="stable")
    root, out = list(range(len(ids))), []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i[order].tolist(), j[order].tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            out.append((int(ids[x]), int(ids[y])))
    return out


def _by_group(batches, n_keys: int):
    """The rows of each group of equal leading columns, from batches sorted by them."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


def _pair_batches(pairs):
    out = []
    for p in pairs:
        out.append(p if p[0] < p[1] else p[::-1])
        if len(out) == 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])


def _sigs(rows, at: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[at] for r in rows), "<u4").reshape(len(rows), -1)


def _forests(batches):
    yield from _pair_batches(p for _, rows in _by_group(batches, 1) for p in forest(np.array([r[0] for r in rows]), _sigs(rows, 1)))


def linked(rows: list[tuple], i: int, j: int, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of a block's rows, of pairs with one row in each half (cut i and cut j).

    Rows: (id, cut, component, signature, hashes). Candidate pairs are taken most alike first, and left out once inside one component."""
    x = [r for r in rows if r[1] == i]
    y = [r for r in rows if r[1] == j]
    if not x or not y:
        return []
    sx, sy = _sigs(x, 3), _sigs(y, 3)
    like = _alike(sx, sy)
    part = lambda half: np.array([r[2] for r in half])
    open_ = (like >= LEAST_ALIKE) & (part(x)[:, None] != part(y)[None, :])
    p, q = np.nonzero(np.triu(open_, 1) if i == j else open_)
    order = np.argsort(-like[p, q], kind="stable")
    sets: dict = {}
    root: dict = {}
    out = []

    def hashes(r):
        if r[0] not in sets:
            sets[r[0]] = set(np.frombuffer(r[4], np.uint64).tolist())
        return sets[r[0]]

    def find(v):
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in zip(p[order].tolist(), q[order].tolist()):
        u, v = find(x[a][2]), find(y[b][2])
        if u != v:
            s, t = hashes(x[a]), hashes(y[b])
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                root[u] = v
                out.append((x[a][0], y[b][0]))
    return out


def _blocks(percent: int):
    def run(batches):
        yield from _pair_batches(p for (_, i, j), rows in _by_group(batches, 3) for p in linked(rows, i, j, percent))

    return run


def _sets(words: int):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, words).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["rep", "hashes"])

    return run


def _verify(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], ["a", "b"])

    return run


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets reach the similarity."""
    ids = written(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "lsh-ids")
    sets = docs.join(ids, docs.doc_id == ids.rep).select("rep", "text").mapInArrow(_sets(words), "rep long, hashes binary")
    sets = written(sets, "lsh-sets")
    first = pairs.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("x")), "a")
    both = first.join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
    return written(both.mapInArrow(_verify(percent), "a long, b long").distinct(), "lsh-links")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept: a row for each row of docs."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    feats = written(rows.mapInArrow(_features(shingle_words), "doc_id long, n_shingles long, digest binary, sig binary"), "lsh-features")
    full = feats.filter("doc_id is not null and digest is not null")
    classes = written(full.groupBy("digest").agg(F.min("doc_id").alias("rep")), "lsh-classes")
    reps = full.select("digest", F.col("doc_id").alias("rep"), "sig").join(classes, ["digest", "rep"]).select("rep", "sig")
    reps = written(reps.distinct(), "lsh-signatures")
    bands = reps.mapInArrow(_bands, "bucket long, rep long")
    heavy = written(bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("least")).filter("n > 1"), "lsh-buckets")
    found = written(bands.join(heavy, "bucket"), "lsh-found")
    small = found.filter(F.col("n") <= BLOCK).groupBy("bucket").agg(F.array_sort(F.collect_set("rep")).alias("members"))
    groups = written(small.select("members").distinct().select(F.xxhash64("members").alias("gid"), F.explode("members").alias("rep")), "lsh-groups")
    with_sig = groups.join(reps, "rep").select("gid", "rep", "sig")
    forests = with_sig.repartition("gid").sortWithinPartitions("gid").mapInArrow(_forests, "a long, b long")
    stars = found.filter((F.col("n") > BLOCK) & (F.col("rep") > F.col("least"))).select(F.col("least").alias("a"), F.col("rep").alias("b"))
    pairs = written(forests.union(stars).filter("a < b").distinct(), "lsh-pairs")
    links = _confirmed(pairs, rows, shingle_words, percent)
    parts = written(connected_components(links), "lsh-parts")
    again = _unresolved(groups, found, reps, parts, rows, shingle_words, percent)
    if again is not None and again.head(1):
        parts = written(connected_components(links.union(again)), "lsh-parts")
    named = classes.join(parts, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    # ids whose text has an empty set, or which stand in no class's name, keep their own
    out = feats.join(written(named, "lsh-named"), "digest", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _unresolved(groups, found, reps, parts, docs, words: int, percent: int) -> DataFrame | None:
    """Links between components, of candidate pairs that were not verified yet; None if there are no such pairs.

    Buckets that hold several components are dealt out as pairs of parts of bounded size, which carry the full sets; only links leave
    them, never pairs.
    """
    big = found.filter(F.col("n") > BLOCK).select(F.col("bucket").alias("gid"), "rep")
    every = groups.union(big)
    every = written(every.join(parts, every.rep == parts.node, "left").select("gid", "rep", F.coalesce("component", "rep").alias("part")), "lsh-labelled")
    # the only pair of a group of two was a candidate and verified, or none
    mixed = every.groupBy("gid").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("n"))
    mixed = written(mixed.filter("p <> q and n > 2").select("gid"), "lsh-mixed")
    if not mixed.head(1):
        return None
    rows = every.join(mixed, "gid")
    sets = docs.join(rows.select("rep").distinct(), docs.doc_id == F.col("rep")).select("rep", "text").mapInArrow(_sets(words), "rep long, hashes binary").distinct()
    sets = written(sets, "lsh-open-sets")
    sizes = rows.join(sets.select("rep", F.octet_length("hashes").cast("long").alias("size")), "rep").groupBy("gid")
    sizes = sizes.agg(F.ceil(F.greatest(F.count("*") / OPEN_BLOCK, F.sum("size") / BLOCK_BYTES)).alias("cuts"))
    rows = rows.join(written(sizes, "lsh-sizes"), "gid").join(reps, "rep").join(sets, "rep").withColumn("cut", F.pmod(F.xxhash64("rep"), F.col("cuts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    keys = ["gid", "i", "j"]
    blocks = rows.select("gid", F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"), "rep", "cut", "part", "sig", "hashes")
    blocks = blocks.repartition(*keys).sortWithinPartitions(*keys)
    return written(blocks.mapInArrow(_blocks(percent), "a long, b long").filter("a < b").distinct(), "lsh-links")


def keep_one(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are not near-duplicates of one with a smaller id. Rows that are equal in id
    and text are all kept or all dropped."""
    found = near_duplicates(docs, shingle_words, percent, id_col, text_col)
    drop = written(found.filter(~F.col("kept")).select(F.col("doc_id").alias("_drop")).distinct(), "lsh-dropped")
    return docs.join(drop.hint("merge"), F.col(id_col).cast("long") == F.col("_drop"), "left_anti")
