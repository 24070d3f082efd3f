"""Decontamination, WARC, licence scans and the quality classifier against brute force, round trips and held-out rows."""

import base64
import gzip
import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillrank.llm import decontaminate, license_scan, quality, warc
from quillrank.llm.common import fresh_path

SF = "/root/testdata/sf0.001"


def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=80, deadline=None)
@given(st.text("ab c", min_size=1, max_size=90), st.text("ab c", max_size=60))
def test_myers(pattern, text):
    assert decontaminate.myers(pattern, text)[0] == least_distance(pattern, text)


def test_contamination(spark, monkeypatch):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(6)] + [(6, None), (7, "  "), (None, "a very short item"), (8, "tiny")]
    texts = []
    for n in range(60):
        body = " ".join(word() for _ in range(40))
        if n % 2:
            item = list(items[n % 6][1])
            for _ in range(rng.integers(0, 12)):
                item[rng.integers(len(item))] = rng.choice(list("abcdefgh"))
            body = f"{body}\n {''.join(item).upper()}\t{body}"
        texts.append((n, body))
    texts += [(60, None), (61, ""), (None, items[0][1]), (62, "x A Very  short ITEM y"), (62, "clean")]
    docs = spark.createDataFrame([(i, t, 1, "h") for i, t in texts], "doc_id bigint, text string, item_id int, hits string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = []
    for i, t in texts:
        for item_id, item in items:
            p = decontaminate.normal(item or "")
            if p and (d := least_distance(p, decontaminate.normal(t or ""))) <= int(decontaminate.EDIT_SHARE * len(p)):
                want.append(repr((i, item_id, d)))
    for size in (4_000_000, 200):  # one block of items, and many
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", size)
        got = decontaminate.contamination(docs, bench).collect()
        assert sorted(repr((r["doc_id"], r["item_id"], r["distance"])) for r in got) == sorted(want)
        kept = decontaminate.clean_documents(docs, bench)
        dirty = {w.split(",")[0][1:] for w in want}
        assert kept.columns == docs.columns and kept.count() == sum(str(i) not in dirty for i, _ in texts) + (1 if "62" in dirty else 0)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0 == decontaminate.contamination(docs, bench.limit(0)).count()


def test_warc(spark):
    big = os.urandom(6000).hex()
    rows = [(3, "http://a/ü?q=1\r\nX: y", "same"), (9, None, "same"), (4, "http://b", None), (1, "http://c", ""), (5, "u", big), (9, "again", "same"), (None, "n", "same"), (None, "m", "alone"), (6, "x", "é\r\n\r\nWARC/1.1"), (7, "http://a/%41?q=%26x", "esc"), (None, "n", "same"), (None, "n", "same")] + [(100 + i, f"http://h/{i}", f"page {i} " * 50) for i in range(40)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, refers_to int, file string")
    path = fresh_path(spark, "warc")
    names = warc.write_warc(df, path, roll_bytes=2000, range_bytes=8000)
    assert len(names) > 3
    got = warc.read_warc(spark, path, with_payload=True).collect()
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    want = []
    for i, _, h in rows:
        data, to = (h or "").encode(), last.get(h or "")
        to = None if to is None or to == i else to
        want.append(repr((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to)))
    assert sorted(repr(tuple(r)[:5]) for r in got) == sorted(want)
    assert sorted(repr(r["url"]) for r in got) == sorted(repr(u) for _, u, _ in rows)
    heads = [h for n in names for h, _ in warc.records(open(n.removeprefix("file:"), "rb").read())]
    responses = {h["warc-record-id"]: h for h in heads if h["warc-type"] == "response"}
    assert len({h["warc-record-id"] for h in heads}) == len(rows)
    for h in heads:
        if h["warc-type"] == "revisit":
            assert responses[h["warc-refers-to"]]["warc-payload-digest"] == h["warc-payload-digest"]
            assert responses[h["warc-refers-to"]]["x-page-id"] == h["x-refers-to-page-id"]
            assert responses[h["warc-refers-to"]]["warc-target-uri"] == h["warc-refers-to-target-uri"]
    assert sum(n.rsplit("/", 1)[1].split(".")[0].endswith("-00001") for n in names) > 0  # the size made a range roll
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in got if r["payload"] is not None and r["page_id"] is not None}[5] == big
    local = [n.removeprefix("file:") for n in names]
    ids = [[int(m) for m in re.findall(rb"X-Page-ID: (\d+)", gzip.decompress(open(n, "rb").read()))] for n in local]  # any gzip reader takes them
    flat = [x for f in ids for x in f]
    assert flat == sorted(flat)
    again = fresh_path(spark, "warc")
    warc.write_warc(df, again, roll_bytes=2000, range_bytes=8000)
    other = [n.removeprefix("file:") for n in warc.write_warc(df, again + "-b", roll_bytes=2000, range_bytes=8000)]
    assert [open(n, "rb").read() for n in local] == [open(n, "rb").read() for n in other]
    with open(local[0], "ab") as f:
        f.write(b"x")
    with pytest.raises(OSError):
        warc.read_warc(spark, path)
    assert warc.round_trip(df.limit(0)).count() == 0
    assert all(r["record_type"] == "response" for r in _read_all(spark, df, 10**6))


def _read_all(spark, df, least):
    path = fresh_path(spark, "warc")
    warc.write_warc(df, path, min_revisit_bytes=least)
    return warc.read_warc(spark, path).collect()


def brute_licenses(text):
    w = [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())]
    at = lambda p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    base = [(i, label) for p, label in license_scan.BASE.items() for i in at(p)]
    found, cover = set(), 0.0
    for label, t, mandatory in license_scan.TEMPLATES:
        t = t.split()
        own = [p for p, x in enumerate(t) if x in license_scan.indexed_words()]
        for d in range(-len(t), len(w)):
            same = lambda p, d=d, t=t: 0 <= d + p < len(w) and w[d + p] == t[p]
            first = [next(k for k in range(len(t)) if t[k : k + len(m.split())] == m.split()) for m in mandatory]
            if sum(map(same, own)) >= license_scan.NEED and all(d + s in at(m) for s, m in zip(first, mandatory)):
                found.add(label)
                cover = max(cover, sum(map(same, range(len(t)))) / len(t))
    starts = [i for i, _ in base]
    labels = {n for _, n in base}
    return len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | found)), max(cover, 0.5 if base else 0.0)


def test_license_scan(spark):
    notices = [t for _, t, _ in license_scan.TEMPLATES]
    gpl, bsd = (next(t for t in notices if k in t) for k in ("can redistribute", "source and binary forms"))
    texts = [None, "", "...", "MIT License", "mit  license. The MIT-License!", "mit\xa0license", "permit license", "general public\nlicense and Apache License", "İmit license K", "license mit", "ab é中 9 x", "the license " * 300 + "mit license", "Licensed under CC BY-NC 4.0.", "cc by nc", "occ by nc"]
    texts += [f"Foo {n.title()}; bar" for n in notices] + [f"{notices[1]} but {gpl}", gpl.replace("redistribute", "x").replace("program", "y"), bsd.replace("binary", "x"), " ".join(notices), "word " * 200 + gpl]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "mit license"), (3, "MIT License")]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id bigint, text string, labels string, n int")
    got = license_scan.scan_licenses(df)
    want = sorted(repr((i, *brute_licenses(t)[:6], round(brute_licenses(t)[6], 9))) for i, t in rows)
    assert sorted(repr((*tuple(r)[:7], round(r["score"], 9))) for r in got.collect()) == want
    assert "Python" not in got._jdf.queryExecution().toString() and license_scan.scan_licenses(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_quality_on_held_out_rows(spark):
    big = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id)


def test_quality_edges(spark):
    rows = [(i, f"good words number {i} of a plain text, as it should be.") for i in range(40)] + [(100 + i, f"BAD!! {'X!! ' * i}") for i in range(40)] + [(None, "no id"), (200, None), (201, ""), (0, "twice"), (202, "word " * 60_000)]
    docs = spark.createDataFrame([(i, t, 1.0, "s") for i, t in rows], "doc_id bigint, text string, score double, quality string")
    labels = spark.createDataFrame([(i, 1 if i < 100 else 0) for i, _ in rows[:80]] + [(None, 1), (0, None), (1, 1)], "doc_id bigint, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert repr(sorted(map(repr, got))) == repr(sorted(map(repr, quality.score_quality(docs, labels).collect())))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert all(r["score"] == 1 for r in quality.score_quality(docs, labels.limit(0)).collect())
    assert quality.score_quality(docs.limit(0), labels).count() == 0 == quality.keep_good(docs.limit(0), labels).count()


def test_risk_is_kept_from_below_zero():
    rng = np.random.default_rng(0)
    good, bad = rng.standard_normal((400, 3)) + 2, rng.standard_normal((400, 3)) - 2
    mixed = np.r_[rng.standard_normal((300, 3)) + 2, rng.standard_normal((100, 3)) - 2]
    model = quality.fit(good, mixed, 0.75)
    assert (model.scores(good) > 0.5).mean() > 0.95 and (model.scores(bad) < 0.5).mean() > 0.95


def test_quality_standardises_over_all_rows(spark):
    rows = [(i, " ".join(f"w{i * k % 37}" for k in range(3 + i % 50)) + "!" * (i % 7)) for i in range(600)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, quality int")
    x = np.array([quality.features(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5])
    models = [quality.train(docs.repartition(n), labels, max_rows=60) for n in (7, 1)]
    for model in models:
        assert np.allclose(model.mean, x.mean(axis=0), atol=1e-8)
        assert np.allclose(model.scale, np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1), atol=1e-8)
    assert np.array_equal(models[0].mean, models[1].mean) and np.array_equal(models[0].weights, models[1].weights)


def test_class_prior():
    rng = np.random.default_rng(5)
    draw = lambda n, at: np.c_[rng.standard_normal((n, 3)) + at, np.ones(n)]
    for prior in (0.2, 0.5, 0.85):
        found = quality.class_prior(draw(3000, 1.5), np.r_[draw(int(6000 * prior), 1.5), draw(int(6000 * (1 - prior)), -1.5)][rng.permutation(int(6000 * prior) + int(6000 * (1 - prior)))])
        assert abs(found - prior) < 0.06
    assert quality.class_prior(draw(2, 0), draw(2, 0)) == 0.5


def risk(w, p, u, prior):
    """The non-negative risk by plain sums, with the penalty of the weights."""
    loss = lambda z: np.log1p(np.exp(-z)).mean()
    return prior * loss(p @ w) + max(0.0, loss(-(u @ w)) - prior * loss(-(p @ w))) + quality.DECAY / 2 * (w[:-1] ** 2).sum()


def test_fit_has_the_least_risk_near_it():
    rng = np.random.default_rng(6)
    good, mixed = rng.standard_normal((500, 2)) + 0.7, np.r_[rng.standard_normal((300, 2)) + 0.7, rng.standard_normal((300, 2)) - 0.7]
    model = quality.fit(good, mixed, 0.5)
    p, u = quality._inputs(good, model.mean, model.scale), quality._inputs(mixed, model.mean, model.scale)
    least = risk(model.weights, p, u, 0.5)
    assert all(risk(model.weights + rng.standard_normal(3) * s, p, u, 0.5) > least - 1e-6 for s in (0.01, 0.1, 1) for _ in range(50))


def test_negative_labels_are_not_read(spark):
    rows = [(i, f"good words number {i} of a text.") for i in range(40)] + [(100 + i, f"BAD!! {'X!! ' * i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    good = [(i, 1) for i in range(40)]
    a, b = (quality.train(docs, spark.createDataFrame(good + more, "doc_id bigint, quality int")) for more in ([], [(100 + i, 0) for i in range(40)]))
    assert a.prior == b.prior and np.array_equal(a.weights, b.weights)
