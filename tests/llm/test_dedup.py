"""MinHash, lattice hashing, components and line dedup against brute force."""

import random
import re

import numpy as np
import pytest

from quillrank.llm import lattice_dedup, line_dedup, minhash
from quillrank.llm.components import connected_components


def components(n, links):
    root = {i: i for i in n}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in n}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(None, 1), (5, 5)] + [(2000 + i, 2001 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    good = [(a, b) for a, b in edges if a is not None and a != b]
    nodes = {x for e in good for x in e}
    assert got == components(nodes, good)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def sets_of(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randrange(20, 120))) for _ in range(12)]
    out = []
    for b in base:
        out += [b, b]
        for edits in (1, 2, 3, 5, 8):
            w = b.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append("\n ".join(w))
    hot = " ".join(rng.choices(words, k=90)).split()
    for _ in range(70):  # a large group of copies, each changed in its own places
        w = list(hot)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w).upper())
    return out + ["", None, " \n", "one two", "ONE  two", "three", "É é a b c", "é É a b c"]


@pytest.mark.parametrize("words", [4, 5])
def test_minhash(spark, monkeypatch, words):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "OPEN_BLOCK", 8)
    rows = list(enumerate(corpus())) + [(None, "lost"), (3, corpus()[3])]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id bigint, text string, component_id int, digest string")
    got = minhash.near_duplicates(df, words).collect()
    assert len(got) == len(rows)
    s = {i: sets_of(t, words) for i, t in rows if i is not None}
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    want = components(s, links)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(s[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    kept = minhash.keep_one(df, words)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i in want if want[i] == i} | {None}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_blocks_find_what_forests_missed():
    rng = np.random.default_rng(0)
    a, b = minhash._constants(2, 120), minhash._constants(3, 120)
    x = rng.integers(0, 1 << 63, 100, np.uint64)
    sets = [np.unique(np.r_[x[: 100 - i], rng.integers(0, 1 << 63, i, np.uint64)]) for i in (0, 4, 8, 30)]
    rows = [(i, 0, i, minhash.signature(s, a, b).tobytes(), s.tobytes()) for i, s in enumerate(sets)]
    links = minhash.linked(rows, 0, 0, 80)
    assert components(range(4), links) == {0: 0, 1: 0, 2: 0, 3: 3}


def test_pairs_whose_signatures_look_less_alike():
    a, b = minhash._constants(2, 120), minhash._constants(3, 120)
    x = np.random.default_rng(29763).integers(0, 1 << 63, 10, np.uint64)  # found by trying: a pair at 0.8 with 75 of 120 equal minima
    sets = [np.sort(x[:9]), np.sort(np.r_[x[:8], x[9:]])]
    sigs = np.array([minhash.signature(s, a, b) for s in sets])
    assert (sigs[0] == sigs[1]).sum() == 75
    assert minhash.linked([(i, 0, i, sigs[i].tobytes(), s.tobytes()) for i, s in enumerate(sets)], 0, 0, 80) == [(0, 1)]
    assert len(minhash.forest(np.arange(2), sigs)) == 1


def test_e8():
    v = lattice_dedup.roots()
    assert len({tuple(x) for x in v}) == 240 and np.allclose((v**2).sum(axis=1), 2)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 8)) * 2
    near = lattice_dedup.decode(x)
    own = ((x - near) ** 2).sum(axis=1)
    assert (own <= 1 + 1e-9).all()  # the covering radius
    for root in v:
        assert (own <= ((x - near - root) ** 2).sum(axis=1) + 1e-9).all()


def test_lattice_dedup(spark, monkeypatch):
    monkeypatch.setattr(lattice_dedup, "BLOCK", 8)
    rng = np.random.default_rng(2)
    rows, base = [], rng.standard_normal((30, 64))
    for i in range(220):
        v = base[i % 30] + rng.standard_normal(64) * (0.11 if i < 150 else 0.02)
        rows.append((i, v.astype("f4").tolist(), int(i % 2)))
    rows += [(300 + i, rows[0][1], 0) for i in range(15)] + [(3, rows[3][1], 1)]
    rows += [(400, None, 0), (401, [0.0] * 64, 0), (402, [float("nan")] + [1.0] * 63, 0), (403, [None] + [1.0] * 63, 0), (404, rows[0][1], None), (405, [], 0), (406, [1.0, 2.0], 0), (407, [2.0, 4.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, n_links string")
    got = lattice_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)

    def good(v, label):
        return v and label is not None and None not in v and np.isfinite(v).all() and any(v)

    unit = [np.array(v, "f4").astype(float) / np.linalg.norm(np.array(v, "f4").astype(float)) if good(v, l) else None for _, v, l in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    degree = np.zeros(len(rows), int)
    for a, b in links:
        degree[[a, b]] += 1
    part = components(range(len(rows)), links)
    name = {p: min((rows[i][0] for i in part if part[i] == p and rows[i][0] is not None), default=None) for p in part.values()}
    want = sorted(repr((rows[i][0], int(degree[i]), name[part[i]], rows[i][0] == name[part[i]])) for i in range(len(rows)))
    assert sorted(repr(tuple(r)) for r in got) == want
    assert lattice_dedup.near_duplicates(df.limit(0)).count() == 0


def brute_lines(rows):
    """The rule by plain loops: fingerprints' first places, matches extended both ways, later copies deleted."""
    docs = sorted({(i if i is not None else -(1 << 63), t) for i, t in rows if t}, key=lambda r: r[0])
    data = {d: line_dedup.line_hashes(d[1]) for d in docs}
    first, gone = {}, {d: set() for d in docs}
    places = [(d, p, f) for d in docs for p, f in line_dedup.fingerprints(*data[d])]
    for d, p, f in places:
        first.setdefault(f, (d, p))
    for d, p, f in places:
        s, q = first[f]
        if (s, q) == (d, p):
            continue
        own, words, other = data[d][0], data[d][1], data[s][0]
        a = b = 0
        while p - a > 0 and q - a > 0 and own[p - a - 1] == other[q - a - 1]:
            a += 1
        while p + b < len(own) and q + b < len(other) and own[p + b] == other[q + b]:
            b += 1
        if words[p - a : p + b].sum() >= line_dedup.RUN_WORDS:
            gone[d] |= set(range(p - a, p + b))
    return {d: "\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in gone[d]) for d in docs}


def test_line_dedup(spark):
    rng = random.Random(4)
    line = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(n))
    passage, boiler, long = [line(20) for _ in range(4)], line(8), line(60)
    rows = []
    for i in range(30):
        body = [line(rng.randrange(1, 40)) for _ in range(rng.randrange(1, 8))]
        if i % 3 == 0:
            body[1:1] = passage
        if i % 4 == 0:
            body.append(boiler)
        if i % 5 == 0:
            body.insert(0, long)
        rows.append((i, "\n".join(body)))
    rows += [(40, rows[0][1]), (41, None), (42, ""), (43, "\n\n"), (None, line(70)), (44, "\n".join([line(55)] * 1 + [long] * 3)), (45, boiler), (46, "\n".join(["  " + long + " ", "x"]))]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id bigint, text string, gone string, _h int")
    got = line_dedup.dedup_lines(df)
    assert got.columns == df.columns
    out = {(r["doc_id"], k): r["text"] for k, r in enumerate(sorted(got.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)))}
    want = brute_lines(rows)
    for (i, _), text in out.items():
        t = dict(rows)[i]
        assert text == (t if not t else want[(i if i is not None else -(1 << 63), t)])
    texts = [t for t in out.values() if t]
    assert sum(long in t for t in texts) == 1 and sum(passage[0] in t for t in texts) == 1 and sum(boiler in t.split("\n") for t in texts) > 5
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def brute_runs(docs):
    """The lines left of each document, without those in a run of RUN_WORDS words that equals a run at any earlier place."""
    data = [line_dedup.line_hashes(t) for t in docs]
    out = []
    for d, (own, words) in enumerate(data):
        gone = set()
        for s in range(d + 1):
            other = data[s][0]
            for shift in range(1 if s == d else 1 - len(other), len(own)):  # own[i] meets other[i - shift]
                run = []
                for i in range(len(own) + 1):
                    if i < len(own) and 0 <= i - shift < len(other) and own[i] == other[i - shift]:
                        run.append(i)
                    else:
                        gone |= set(run) if words[run].sum() >= line_dedup.RUN_WORDS else set()
                        run = []
        out.append("\n".join(x for i, x in enumerate(docs[d].split("\n")) if i not in gone))
    return out


def test_line_dedup_finds_any_earlier_run(spark):
    rng = random.Random(12)
    x, y = (" ".join(f"{c}{i}" for i in range(30)) for c in "xy")
    groups = [["a\n" + x + "\nb", f"{x}\n{y}", f"c\n{x}\n{y}\nd"]]
    for g in range(150):  # lines of each group are its own
        pool = [" ".join(f"{g}-{k}-{i}" for i in range(rng.choice([0, 1, 5, 12, 20, 28, 35, 55]))) for k in range(6)]
        groups.append(["\n".join(rng.choices(pool, k=rng.randrange(1, 9))) for _ in range(6)])
    rows = [(10 * g + i, t) for g, docs in enumerate(groups) for i, t in enumerate(docs)]
    want = {10 * g + i: t for g, docs in enumerate(groups) for i, t in enumerate(brute_runs(docs))}
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert want[2] == "c\nd" and got == want


def test_equal_runs_share_a_fingerprint():
    rng = random.Random(9)
    for _ in range(200):
        run = [" ".join(str(rng.randrange(99)) for _ in range(rng.randrange(1, 30))) for _ in range(6)]
        if sum(len(x.split()) for x in run) < line_dedup.RUN_WORDS:
            continue
        a, b = ("\n".join([f"{k} {rng.random()}" for k in range(rng.randrange(5))] + run + [str(rng.random())]) for _ in range(2))
        fa, fb = ({h for _, h in line_dedup.fingerprints(*line_dedup.line_hashes(t))} for t in (a, b))
        assert fa & fb
