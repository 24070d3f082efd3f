"""Embedding near-dedup by lattice hashing.

Vectors of one label are normalised and projected by BLOCKS random orthonormal maps to eight dimensions each, in each of TABLES tables; a
block's projection is decoded to its nearest point of the lattice E8, and the blocks' points together are the vector's cell. Besides its
own cell, a vector probes the PROBES cells next to it that are nearest: those that differ in one block, by a shortest vector of E8.
Vectors meet where the cell of one is the cell or a probe of the other, and their cosine is then computed in double precision.

Equal vectors of a label are one class, found before, with a count. Each pair of classes is counted in the first table and cell where
it meets, so sums over cells are whole and no pair of a cell is written out: a cell gives each class its number of links, and edges
that span its linked classes. A cell with more than BLOCK classes is dealt out as pairs of blocks.

Vectors that are null, of another length than most are not compared with those (only equal lengths are), empty, zero, or hold null or
non-finite components link with nothing, nor do those with a null label. Rows without an id link but name no component: the component is
then the smallest id that is not null. Repeated rows count as vectors of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune, written
from .components import connected_components

TABLES, BLOCKS, SCALE, PROBES, SEED = 5, 2, 0.24, 4, 5
BLOCK = 1024


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, by its rule: (+-1, +-1, 0 ...) and halves with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(v) for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    if len(odd):
        gap = x[odd] - near[odd]
        at = np.abs(gap).argmax(axis=1)
        near[odd, at] += np.where(gap[np.arange(len(odd)), at] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: D8 and D8 moved by halves."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def projections(dim: int) -> np.ndarray:
    """TABLES x BLOCKS maps to eight dimensions, with orthonormal rows where dim allows it."""
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(TABLES * BLOCKS):
        g = rng.standard_normal((max(dim, 8), 8))
        out.append(np.linalg.qr(g)[0].T[:, :dim] * np.sqrt(dim / 64))
    return np.array(out).reshape(TABLES, BLOCKS, 8, dim)


def _key(points: np.ndarray, table: int) -> np.ndarray:
    """Points (n, BLOCKS, 8) as 64-bit keys."""
    ints = np.rint(points * 2).astype(np.int64).reshape(len(points), -1)
    h = np.full(len(points), table + 1, np.uint64)
    for c in ints.T:
        h = (h ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(unit: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """(n, TABLES, 1 + PROBES): each vector's cell and then its probes, by table."""
    out = np.empty((len(unit), TABLES, 1 + PROBES), np.int64)
    v = roots()
    for t in range(TABLES):
        x = np.stack([unit @ maps[t, b].T for b in range(BLOCKS)], axis=1) / SCALE
        home = np.stack([decode(x[:, b]) for b in range(BLOCKS)], axis=1)
        out[:, t, 0] = _key(home, t)
        gain = np.concatenate([(x[:, b] - home[:, b]) @ v.T for b in range(BLOCKS)], axis=1)  # larger: the next cell is nearer
        best = np.argpartition(-gain, PROBES, axis=1)[:, :PROBES]
        for p in range(PROBES):
            moved = home.copy()
            moved[np.arange(len(unit)), best[:, p] // len(v)] += v[best[:, p] % len(v)]
            out[:, t, 1 + p] = _key(moved, t)
    return out


def meets(a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
    """Whether vectors with cells a and b meet in a table. a, b: (n, TABLES, 1 + PROBES)."""
    return (a[:, table, :1] == b[:, table]).any(axis=1) | (b[:, table, :1] == a[:, table]).any(axis=1)


def first_here(a: np.ndarray, b: np.ndarray, table: int, cell: int) -> np.ndarray:
    """Whether this table's cell is the first place where they meet: no earlier table, and in this one the smaller cell if two do."""
    out = np.ones(len(a), bool)
    for t in range(table):
        out &= ~meets(a, b, t)
    other = np.where(a[:, table, 0] == cell, b[:, table, 0], a[:, table, 0])
    in_other = ((a[:, table] == other[:, None]).any(axis=1)) & ((b[:, table] == other[:, None]).any(axis=1))
    return out & ~(in_other & (other < cell))


def count_links(x: list[tuple], y: list[tuple] | None, table: int, cell: int, least: float) -> tuple[dict, list]:
    """(links by class, edges that span the linked classes) of the pairs of x and y, or of x with itself.

    Rows: (class, number of its vectors, vector as float32 bytes, cells as int64 bytes)."""
    same = y is None
    y = x if same else y
    vx, vy = (np.array([np.frombuffer(r[2], "<f4") for r in rows], np.float64) for rows in (x, y))
    vx, vy = (v / np.linalg.norm(v, axis=1)[:, None] for v in (vx, vy))
    cx, cy = (np.array([np.frombuffer(r[3], "<i8") for r in rows]).reshape(len(rows), TABLES, -1) for rows in (x, y))
    nx, ny = (np.array([r[1] for r in rows], np.int64) for rows in (x, y))
    hx, hy = cx[:, table, 0] == cell, cy[:, table, 0] == cell
    tx, ty = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    root: dict = {}
    edges = []

    def find(v):
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for i in range(len(x)):
        close = (vy @ vx[i] >= least) & (hy | hx[i])
        if same:
            close[: i + 1] = False
        j = np.flatnonzero(close)
        if len(j):
            j = j[first_here(np.broadcast_to(cx[i], cy[j].shape), cy[j], table, cell)]
        if len(j):
            tx[i] += ny[j].sum()
            ty[j] += nx[i]
            for k in j.tolist():
                p, q = find(x[i][0]), find(y[k][0])
                if p != q:
                    root[p] = q
                    edges.append((x[i][0], y[k][0]))
    links: dict = {}
    for rows, t in ((x, tx), (y, ty)):
        for r, n in zip(rows, t.tolist()):
            if n:
                links[r[0]] = links.get(r[0], 0) + n
    return links, edges


def _hashed(dims: int):
    def run(batches):
        maps = {dims: projections(dims)}
        for b in batches:
            ids, vectors = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            if not vectors:
                continue
            for i in range(0, len(vectors), 256):
                part = [np.frombuffer(v, "<f4").astype(np.float64) for v in vectors[i : i + 256]]
                found = np.zeros((len(part), TABLES, 1 + PROBES), np.int64)
                for size in {len(v) for v in part}:
                    at = [k for k, v in enumerate(part) if len(v) == size]
                    x = np.array([part[k] for k in at])
                    maps.setdefault(size, projections(size))
                    found[at] = cells(x / np.linalg.norm(x, axis=1)[:, None], maps[size])
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 256]), pa.array([c.astype("<i8").tobytes() for c in found], pa.binary())], ["class", "cells"])

    return run


def _packed(batches):
    """Vectors as bytes, or null where they can link with nothing."""
    for b in batches:
        out = []
        for v, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            good = v is not None and len(v) and label is not None and None not in v
            x = np.array(v, "<f4") if good else None
            good = good and np.isfinite(x).all() and (x != 0).any()
            out.append((x + np.float32(0)).tobytes() if good else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], ["vec_id", "label", "v"])


def _places(batches):
    """A row for each table, cell and class: in its own cell and in those it probes."""
    for b in batches:
        ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), TABLES * (1 + PROBES))
        keys = np.array([np.frombuffer(c, "<i8") for c in b.column(2).to_pylist()]).reshape(-1)
        n = b.num_rows
        tables = np.tile(np.repeat(np.arange(TABLES), 1 + PROBES), n)
        home = np.tile(np.r_[True, np.zeros(PROBES, bool)], TABLES * n)
        labels = np.repeat(np.array(b.column(1).to_pylist(), object), TABLES * (1 + PROBES))
        yield pa.RecordBatch.from_arrays([pa.array(labels, b.schema.field(1).type), pa.array(tables, pa.int64()), pa.array(keys), pa.array(ids), pa.array(home)], ["label", "tab", "cell", "class", "home"])


def _cells_counted(least: float):
    def run(batches):
        def flush(key, rows, links, edges):
            _, table, cell, i, j = key
            x = [r[:4] for r in rows if r[4] == i]
            y = None if i == j else [r[:4] for r in rows if r[4] == j]
            if len(x) + len(y or ()) < 2 or y == []:
                return
            for dim in {len(r[2]) for r in x}:
                mine = [r for r in x if len(r[2]) == dim]
                theirs = None if y is None else [r for r in y if len(r[2]) == dim]
                if theirs == []:
                    continue
                found, spans = count_links(mine, theirs, table, cell, least)
                links += [(c, n, None) for c, n in found.items()]
                edges += [(a, None, b) for a, b in spans]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["class", "links", "other"])

        key, rows, ready = None, [], []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:5] != key:
                    if rows:
                        flush(key, rows, ready, ready)
                    key, rows = row[:5], []
                    if len(ready) > 5000:
                        yield out(ready)
                        ready = []
                rows.append(row[5:])
        if rows:
            flush(key, rows, ready, ready)
        if ready:
            yield out(ready)

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors."""
    tune(vectors.sparkSession)
    label_type = dict(vectors.dtypes)[label_col]
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("embedding"), F.col(label_col).alias("label"))
    packed = written(rows.mapInArrow(_packed, f"vec_id long, label {label_type}, v binary"), "vec-packed")
    good = packed.filter("v is not null").withColumn("h", F.xxhash64("label", "v"))
    # the class is known by its smallest id; an id of several vectors names several classes, so classes have numbers of their own
    classes = good.groupBy("h", "label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = written(classes.select(F.xxhash64("h", "v", F.lit(3)).alias("class"), "h", "label", "v", "n", "least"), "vec-classes")
    hashed = written(classes.select("class", "v").mapInArrow(_hashed(64), "class long, cells binary"), "vec-cells")
    places = classes.select("class", "label").join(hashed, "class").mapInArrow(_places, f"label {label_type}, tab long, cell long, class long, home boolean")
    places = written(places, "vec-places")
    full = places.groupBy("label", "tab", "cell").agg(F.count("*").alias("size"), F.max("home").alias("home")).filter("size > 1 and home").drop("home")
    full = written(full, "vec-full")
    met = places.drop("home").join(full, ["label", "tab", "cell"])
    cuts = F.ceil(F.col("size") / BLOCK)
    met = met.withColumn("cut", F.pmod(F.xxhash64("class", F.lit(9)), cuts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), cuts - 1)))
    met = met.select("label", "tab", "cell", F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"), "class", "cut")
    full_rows = met.join(classes.select("class", "n", "v"), "class").join(hashed, "class")
    keys = ["label", "tab", "cell", "i", "j"]
    dealt = full_rows.select(*keys, "class", "n", "v", "cells", "cut").repartition(*keys).sortWithinPartitions(*keys)
    counted = written(dealt.mapInArrow(_cells_counted(least), "class long, links long, other long"), "vec-links")
    sums = counted.filter("links is not null").groupBy("class").agg(F.sum("links").alias("links"))
    edges = counted.filter("other is not null").select("class", "other").distinct()
    parts = connected_components(edges)
    # a component is named by the smallest id of its classes
    member = classes.select("class", "h", "v", "n", "least").join(parts, F.col("class") == F.col("node"), "left").withColumn("part", F.coalesce("component", "class"))
    member = written(member.join(sums, "class", "left").select("h", "v", "part", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "vec-members")
    names = written(member.groupBy("part").agg(F.min("least").alias("component_id")), "vec-names")
    named = written(member.join(names, "part").select("h", F.col("v").alias("_v"), "links", "component_id"), "vec-named")
    all_rows = packed.withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")))
    out = all_rows.join(named, (all_rows.h == named.h) & (all_rows.v == F.col("_v")), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
