"""The Merkle manifest against a plain recursion over lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillrank.llm import merkle

COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, g int, n int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, size):
    """The root, and for each node its siblings' digests as (left, right), level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // size * size : i // size * size + size]
            paths[k].append(("".join(run[: i % size]), "".join(run[i % size + 1 :])))
        nodes, at = [H(*nodes[i : i + size]) for i in range(0, len(nodes), size)], [i // size for i in at]
    return nodes[0], paths


def brute(rows, size, later=lambda r: r[3]):
    low = lambda v: (v is not None, v if isinstance(v, int) else (v or "").encode())
    leaf = lambda r, n: H(*map(field, (r[0], r[1], r[2], n, r[4])))
    langs = sorted({r[2] for r in rows}, key=low)
    groups = [sorted((r for r in rows if r[2] == g), key=lambda r: ((r[0] is not None, r[0] or 0), leaf(r, r[3]))) for g in langs]
    inner = [climb([leaf(r, r[3]) for r in g], size) for g in groups]
    root, upper = climb([r for r, _ in inner], size) if rows else (None, [])
    out = []
    for g, (sub, paths), up in zip(groups, inner, upper):
        for r, path in zip(g, paths):
            path, now = path + up, leaf(r, later(r))
            for left, right in path:
                now = H(left, now, right)
            out.append((r[0], leaf(r, r[3]), sub, root, H(*(left + right for left, right in path)), now, now == root))
    return sorted(out, key=repr)


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], COLUMNS)


def made(n):
    rows = [(i * 3 % 1009, f"s{i % 3}", ["en", "é", None, "de", "z"][min(i % 9, 4) if i % 2 else 0], i if i % 5 else None, "ab ü " * (i % 7) if i % 11 else None) for i in range(n)]
    return rows + rows[:3] + [(None, None, "en", 5, ""), (None, "s", "fr", None, None)] if n else rows


@pytest.mark.parametrize("n, size, block", [(0, 2, 1024), (1, 2, 1024), (40, 2, 4), (300, 2, 1024), (300, 2, 16), (90, 3, 9), (70, 5, 5)])
def test_proofs(spark, monkeypatch, n, size, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = made(n)
    tampered = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
    later = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle.verified(documents(spark, rows), {"n_chars": later}, size)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, size, lambda r: r[3] + 1 if tampered(r) else r[3])


def test_manifest_is_stored(spark, tmp_path):
    rows = made(50)
    m = merkle.manifest(documents(spark, rows))
    m.save(f"file://{tmp_path}/m")
    nodes = spark.read.parquet(f"file://{tmp_path}/m/nodes")
    root = nodes.filter("tree = 'groups-root'").collect()
    assert [r["h"].hex() for r in root] == [brute(rows, 2)[0][3]] == [r["h"].hex() for r in m.root().collect()]
    assert nodes.groupBy("tree", "g", "level", "p").count().filter("count > 1").count() == 0
    assert spark.read.parquet(f"file://{tmp_path}/m/leaves").count() == len(rows)
    with pytest.raises(ValueError):
        merkle.manifest(documents(spark, rows), size=1)
