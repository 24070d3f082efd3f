"""Profiles, text, completions, graphs, statistics, sources and sinks on small fixtures."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.functions import completions as C
from quillrank.functions import text as X
from quillrank.operators import graph as G
from quillrank.operators import profiles as P
from quillrank.operators import relational as L
from quillrank.operators import stats as S
from quillrank.sources import readers, schemas, writers


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first()["x"]


def test_ground_truth(spark):
    rows = [("skill", 4.5, True), ("tech skill", None, False), ("required education", 2.0, True), ("related experience", None, False)]
    df = spark.createDataFrame(rows, "kind string, importance double, matched boolean")
    for whole, want in ((False, 6.516129), (True, 6.4)):
        got = P.ground_truth(df.withColumn("w", P.weight(F.col("importance"), F.col("kind"), whole)), [])
        assert got.first()["gt_score"] == pytest.approx(want, abs=1e-6)
    assert P.ground_truth(df.limit(0).withColumn("w", F.lit(1.0)), []).first()["gt_score"] == 5.5


def test_levels(spark):
    cases = [("2.D.1.6", "2.D.1.6", True), ("2.D.1.6", "2.D.1.8", True), ("2.D.1.6", "2.D.1.5", False), ("2.D.1.6", "3.A.1.9", False), ("2.D.1.6", "2.D.1.10", True), ("abc", "abc", True)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert df.filter(P.level_matches(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_graph_score(spark):
    rows = [(5.0, True, None), (4.0, False, 0), (3.0, False, 1), (2.0, False, 2), (3.0, False, None)]
    df = spark.createDataFrame(rows, "w double, matched boolean, dist int").withColumn("node_score", G.node_score(F.col("matched"), F.col("dist")))
    assert G.graph_score(df, []).first()["score"] == pytest.approx(6.823529, abs=1e-3)
    near = df.withColumn("node_score", (F.col("matched") | (F.coalesce("dist", F.lit(9)) == 0)).cast("double"))
    assert G.graph_score(near, []).first()["score"] == pytest.approx(5.764706, abs=1e-3)
    assert G.graph_score(df.limit(0), []).first()["score"] == 5.5


def test_anchors_are_not_passed(spark):
    nodes = spark.createDataFrame([("d", "a")], "doc_id string, node string")
    edges = spark.createDataFrame([("d", "a", "x", 1), ("d", "x", "b", 1)], "doc_id string, source string, target string, cost int")
    assert {r["node"]: r["dist"] for r in G.hops(nodes, edges).collect()} == {"a": 0, "x": 1, "b": 2}
    anchors = spark.createDataFrame([("d", "x")], "doc_id string, node string")
    assert {r["node"] for r in G.hops(nodes, edges, anchors=anchors).collect()} == {"a"}


def test_loops_reach_the_ends_of_long_chains(spark):
    n = 13
    nodes = spark.createDataFrame([("d", 0), ("e", 5)], "doc_id string, node int")
    chain = [(d, i, i + 1, 0 if i % 3 == 0 else 1) for d in "de" for i in range(n)] + [("d", 0, 12, 1)]
    edges = spark.createDataFrame(chain, "doc_id string, source int, target int, cost int")
    cost = lambda i, j: sum(k % 3 != 0 for k in range(min(i, j), max(i, j)))
    want = {("e", i): cost(5, i) for i in range(n + 1)} | {("d", i): min(cost(0, i), 1 + cost(12, i)) for i in range(n + 1)}
    assert {(r["doc_id"], r["node"]): r["dist"] for r in G.hops(nodes, edges).collect()} == want
    line = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(n, 0)], "child int, parent int")
    assert {(r["node"], r["ancestor"]): r["depth"] for r in G.closure(line).collect()} == {(i, j): (j - i) % (n + 1) for i in range(n + 1) for j in range(n + 1)}


def test_closure_ends_in_cycles(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "child string, parent string")
    assert {(r["node"], r["ancestor"]): r["depth"] for r in G.closure(parents, 5).collect()}[("c", "b")] == 2


COMPLETIONS = [('{"score": 7, "justification": "ok"}', 7.0, "ok", "ok"), ('```json\n{"score": 7, "justification": "ok"}\n```', 7.0, "ok", "ok"), ('{"score": 7.5, "justification": "cut off', 7.5, "recovered", "cut off…[TRUNCATED]"), ("I cannot say", None, "no_score", "[PARSE_FAILED]"), ("  ", None, "empty", None), (None, None, "empty", None), ("[1, 2]", None, "no_score", "[PARSE_FAILED]")]


def test_completions(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(COMPLETIONS)], "i int, v string")
    got = df.select("i", C.parsed(F.col("v")).alias("p")).select("i", "p.*").orderBy("i").collect()
    assert [(r["score"], r["parse_status"], r["justification"]) for r in got] == [c[1:] for c in COMPLETIONS]


def test_json_repair(spark):
    for raw, want in (('x {"a": [1, 2,], "b": "c', '{"a":[1,2],"b":"c"}'), ('{"a": "q\\"', '{"a":"q\\""}'), ("none", None), ('{"a": 1,', '{"a":1}'), ('{"a": 1} tail', '{"a":1}')):
        assert one(spark, raw, C.repaired_json) == want


def test_annotation_and_sentences(spark):
    df = spark.createDataFrame([("Uses Java and JavaScript.", [("Java", "S"), ("JavaScript", "T")])], "t string, n array<struct<label:string,type:string>>")
    assert df.select(C.annotated("t", "n")).first()[0] == "Uses [Java](S) and [JavaScript](T)."
    assert one(spark, "One. Two here! Three", lambda v: C.sentence_with(v, F.lit("HERE"))) == "Two here!"
    assert one(spark, "the 12", C.entity_id) == 12 and one(spark, "1 or 2", C.entity_id) is None
    body = '{"output": [{"type": "x"}, {"type": "message", "content": [{"type": "output_text", "text": "hi"}]}]}'
    assert one(spark, body, C.output_text) == "hi"
    assert one(spark, '```\n{"a": 1}\n{"a": 2\n```', lambda v: F.size(C.json_lines(v, "a int"))) == 1


def test_text(spark):
    assert one(spark, "a b a c", lambda v: X.hapaxes(F.split(v, " "))) == 2
    assert one(spark, "ab?>c~", lambda v: X.decoded_id(X.encoded_id(v))) == "ab?>c~"
    assert one(spark, "5", lambda v: X.importance_label(v.cast("double"))) == "extremely important"
    assert one(spark, "run_1.json", lambda v: X.belongs_to_run(v, F.lit("run"))) and not one(spark, "runs.json", lambda v: X.belongs_to_run(v, F.lit("run")))


def test_relational(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    once = L.upsert(old, new, "k")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "B"), (3, "C")] == sorted(map(tuple, L.upsert(once, new, "k").collect()))
    with pytest.raises(ValueError):
        L.require_unique(new.union(new), "k")
    with pytest.raises(ValueError):
        L.require_columns(old, "x")


def test_regression(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + rng.standard_normal(400)
    g = np.arange(400) % 20
    df = spark.createDataFrame([(float(a), float(b), float(c), int(k)) for (a, b), c, k in zip(x, y, g)], "a double, b double, y double, g int")
    got = S.ols(df, "y", ["a", "b"], "g")
    z = np.c_[np.ones(400), x]
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    inverse, e = np.linalg.inv(z.T @ z), y - z @ b
    u = np.array([z[g == k].T @ e[g == k] for k in range(20)])
    se = np.sqrt(np.diag(inverse @ (u.T @ u) @ inverse) * 20 / 19 * 399 / 397)
    assert [r["coef"] for r in got] == pytest.approx(b) and [r["se"] for r in got] == pytest.approx(se)
    assert S.select_features(df.withColumn("a2", F.col("a") * 3), "y", ["a", "a2", "b"]) == ["a", "b"]
    assert S.source_columns(["x_1", "x_2", "y"], ["x", "y"]) == ["x", "y"]


def test_sources_and_sinks(spark, tmp_path):
    path = str(tmp_path / "rows.jsonl")
    open(path, "w").write('{"code": "1", "title": "A"}\n\nbroken\n{"code": "1", "title": "B"}\n')
    assert readers.jsonl(spark, path, schemas.OCCUPATIONS, "tolerant").count() == 2
    assert readers.damaged_lines(spark, path, schemas.OCCUPATIONS).collect()[0]["line"] == "broken"
    assert readers.occupation_reference(spark, path).collect()[0]["title"] == "B"
    assert readers.jsonl(spark, str(tmp_path / "none"), schemas.OCCUPATIONS, missing_ok=True).count() == 0
    with pytest.raises(Exception):
        readers.jsonl(spark, path, schemas.OCCUPATIONS).collect()
    with pytest.raises(FileNotFoundError):
        readers.job_files(spark, str(tmp_path / "x*"), schemas.OCCUPATIONS)
    df = readers.jsonl(spark, path, schemas.OCCUPATIONS, "tolerant")
    writers.jsonl(df, str(tmp_path / "out"))
    writers.jsonl(df, str(tmp_path / "out"), append=True)
    assert readers.jsonl(spark, str(tmp_path / "out"), schemas.OCCUPATIONS).count() == 4
    ttl = tmp_path / "o.ttl"
    ttl.write_text('@prefix ex: <http://x/> .\nex:A a ex:Class ; ex:label "an A"@en , "other" .\nex:B ex:sub ex:A .\n')
    assert sorted(map(tuple, readers.turtle(spark, str(ttl)).collect())) == [("ex:A", "ex:label", "an A"), ("ex:A", "ex:label", "other"), ("ex:A", "rdf:type", "ex:Class"), ("ex:B", "ex:sub", "ex:A")]
    nested = 'ex:C ex:on [ a ex:R ; ex:of [ ex:is ex:D ] , ex:E ] ; ex:label "c" . [ ex:p ex:F ] ex:q ex:G . [] a ex:H .'
    assert readers.triples_of(nested) == [("_:[0]", "rdf:type", "ex:R"), ("_:[1]", "ex:is", "ex:D"), ("_:[0]", "ex:of", "_:[1]"), ("_:[0]", "ex:of", "ex:E"), ("ex:C", "ex:on", "_:[0]"), ("ex:C", "ex:label", "c"), ("_:[2]", "ex:p", "ex:F"), ("_:[2]", "ex:q", "ex:G"), ("_:[3]", "rdf:type", "ex:H")]
    metrics = spark.createDataFrame([("rmse", 1.5, 1.0, 2.0)], "metric string, value double, ci_lower double, ci_upper double")
    assert "1.500000" in writers.report(metrics, "Metrics")
    writers.summary_csv(metrics, str(tmp_path / "csv"), "metric")
    key = one(spark, "cv::b::11-1::s::0::cf_male", readers.parsed_key)
    assert (key["type"], key["occ"], key["cf"]) == ("cv", "11-1", "male")


def test_loops_run_to_their_end(spark):
    edges = spark.createDataFrame([(1, i, i + 1, 1) for i in range(30)], "doc_id int, source int, target int, cost int")
    far = {r["node"]: r["dist"] for r in G.hops(edges.select("doc_id", F.lit(0).alias("node")).distinct(), edges).collect()}
    assert far == {i: i for i in range(31)}
    parents = spark.createDataFrame([(i, i + 1) for i in range(50)], "child int, parent int")
    assert G.closure(parents).agg(F.max("depth")).first()[0] == 50


def test_ablation_counts_what_isa_reaches(spark):
    # weights 5, 4, 3, 2, 3: matched, over isA alone, one hop, two hops, out of reach
    rows = [(1, 5.0, True, 0), (1, 4.0, False, 0), (1, 3.0, False, 1), (1, 2.0, False, 2), (1, 3.0, False, None)]
    df = spark.createDataFrame(rows, "doc int, w double, matched boolean, dist int")
    score = lambda c: round(G.graph_score(df.withColumn("node_score", c), ["doc"]).first()["score"], 3)
    assert score(G.node_score(F.col("matched"), F.col("dist"))) == 6.824
    assert score(G.ablated_score(F.col("matched"), F.col("dist"))) == 5.765


def test_new_sinks(spark, tmp_path):
    from quillrank.sources import writers as W

    m = spark.createDataFrame([("g", "rmse", 1.0, float("nan"), 2.0), ("h", "rmse", 3.0, 1.0, 4.0)], "grp string, metric string, value double, ci_lower double, ci_upper double")
    W.nested_metrics(m, f"{tmp_path}/n", ["grp"])
    kept = {r["grp"]: r["metrics"]["rmse"] for r in spark.read.json(f"{tmp_path}/n").collect()}
    assert kept["g"]["value"] == 1.0 and kept["g"]["ci_lower"] is None and kept["h"]["ci_upper"] == 4.0
    W.comparison_csv(m, f"{tmp_path}/c", [], "grp", "g", "h")
    assert spark.read.csv(f"{tmp_path}/c", header=True).first()["difference"] == "-2.0"
    W.batch_files(spark.createDataFrame([(1, None), (2, "HTTP 500")], "id int, error string"), f"{tmp_path}/b")
    assert spark.read.json(f"{tmp_path}/b/errors").count() == 1 == spark.read.json(f"{tmp_path}/b/results").count()
    W.copied(spark, f"{tmp_path}/b/errors", f"{tmp_path}/copy")
    assert spark.read.json(f"{tmp_path}/copy").first()["id"] == 2
    W.stage_table(spark.range(3).toDF("id"), f"{tmp_path}/stage")
    W.stage_table(spark.read.parquet(f"{tmp_path}/stage").filter("id > 0"), f"{tmp_path}/stage")
    assert spark.read.parquet(f"{tmp_path}/stage").count() == 2
    assert W.counts_text(spark.createDataFrame([("ok", 3)], "status string, n int"), "Status") == "Status\n  ok: 3"


def test_outcomes_of_a_batch(spark):
    from quillrank.operators import generation as N

    results = [("a", 200, None), ("b", 500, None), ("c", 429, "Rate limit"), ("d", 400, "INCOMPLETE: Token limit reached"), ("e", None, "Content_Filter"), ("f", 200, ""), ("g", None, None)]
    inputs = spark.createDataFrame([(k,) for k in "abcdefgh"], "custom_id string")
    got = N.outcomes(inputs, spark.createDataFrame(results, "custom_id string, status_code int, error string"))
    assert {r["custom_id"]: r["category"] for r in got.collect()} == dict(zip("abcdefgh", ["success", "http_error", "other_error", "token_limit", "content_filter", "success", "http_error", "missing"]))


def test_paths_of_least_cost(spark):
    from collections import defaultdict
    from heapq import heappop, heappush

    rng = np.random.default_rng(9)
    edges = {(d, *sorted(map(int, rng.choice(9, 2, replace=False)))): int(rng.integers(0, 2)) for d in range(12) for _ in range(11)}
    starts, anchors = {(d, int(rng.integers(9))) for d in range(12) for _ in range(2)}, {(d, 8) for d in range(0, 12, 3)}
    starts -= anchors
    near = defaultdict(list)
    for (d, a, b), c in edges.items():
        if (d, a) not in anchors and (d, b) not in anchors:
            near[d, a].append((b, c))
            near[d, b].append((a, c))
    want = {}
    for d in range(12):
        heap, seen = [(0, 0, (n,)) for e, n in starts if e == d], {}
        heap.sort()
        while heap:  # by cost, number of edges, and the path from its end
            cost, n, path = heappop(heap)
            if path[0] not in seen:
                seen[path[0]] = (cost, n, path[::-1])
                for other, c in near[d, path[0]]:
                    heappush(heap, (cost + c, n + 1, (other, *path)))
        want |= {(d, node): v for node, v in seen.items()}
    df = spark.createDataFrame([(d, a, b, c) for (d, a, b), c in edges.items()], "doc_id int, source int, target int, cost int")
    nodes = lambda rows: spark.createDataFrame(sorted(rows), "doc_id int, node int")
    got = G.with_paths(G.reach(nodes(starts), df, anchors=nodes(anchors))).collect()
    assert {(r["doc_id"], r["node"]): (r["dist"], r["edges"], tuple(r["path"])) for r in got} == want
    bounded = G.hops(nodes(starts), df, 1, anchors=nodes(anchors)).collect()
    assert {(r["doc_id"], r["node"]) for r in bounded} == {k for k, v in want.items() if v[1] <= 1} | {k for k in want if any((k[0], o) in starts for o, _ in near[k])}
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    assert G.with_paths(G.reach(nodes(starts).limit(0), df)).count() == 0


def test_paths_of_long_chains(spark):
    n = 40
    edges = spark.createDataFrame([(1, i, i + 1, i % 2) for i in range(n)], "doc_id int, source int, target int, cost int")
    found = G.with_paths(G.reach(spark.createDataFrame([(1, 3)], "doc_id int, node int"), edges))
    assert {r["node"]: r["path"] for r in found.collect()} == {i: list(range(3, i + 1)) if i >= 3 else list(range(3, i - 1, -1)) for i in range(n + 1)}


def test_detail_of_a_score(spark):
    nodes = spark.createDataFrame([("d", "a", "A", "important", 3.0, True), ("d", "b", None, None, 5.0, False), ("d", "c", "C", "x", 1.0, False)], "doc_id string, node string, label string, importance string, w double, matched boolean")
    edges = spark.createDataFrame([("d", "a", "b", 1)], "doc_id string, source string, target string, cost int")
    found = G.with_paths(G.reach(nodes.filter("matched"), edges))
    got = G.detail_maps(G.detail(nodes, found)).first()["detail"]
    assert {k: tuple(v) for k, v in got.items()} == {"a": ("A", "important", 3.0, 1, ["a"], 1.0), "b": ("b", "important", 5.0, 2, ["a", "b"], 0.5), "c": ("C", "x", 1.0, None, [], 0.0)}


def test_explanation(spark):
    wanted = spark.createDataFrame([("p", "n2", "S", "Java", None, 3.0), ("p", "n1", None, None, "very important", 4.0)], "pair string, node string, type string, label string, importance string, w double")
    matches = spark.createDataFrame([("p", "n2", "c2", "T", "JVM", 0.5), ("p", "n2", "c1", None, None, 1.0), ("p", "n2", "c0", "T", "J", 0.5)], "pair string, node string, other string, other_type string, other_label string, conf double")
    want = ["T", "=" * 60, "\n✗ [] [very important] n1  →  -4.00  (no match)", "\n✓ [S] [important] Java  →  +3.00", "    [] c1  (conf=1.00)", "    [T] J  (conf=0.50)", "    [T] JVM  (conf=0.50)", "\nSummary: 1 matched, 1 unmatched out of 2 JD nodes"]
    assert G.explained(wanted, matches, ["pair"], "T").first()["explanation"] == "\n".join(want)


def test_edges_that_fit(spark, monkeypatch):
    edges = spark.createDataFrame([("d", "a", "b", "needs"), ("d", "b", "a", "needs"), ("d", "a", "a", "needs"), ("d", "a", "x", "isA"), ("d", "b", "a", "free"), ("e", "a", "b", "needs")], "doc_id string, source string, target string, relation string")
    types = spark.createDataFrame([("d", "a", "F"), ("d", "b", "O"), ("d", "a", "F"), ("d", "a", "Z")], "doc_id string, node string, type string")
    relations = spark.createDataFrame([("needs", "Finished", "Open"), ("isA", "Open", "Open")], "label string, domain string, range string")
    closed = G.closure(spark.createDataFrame([("F", "Finished"), ("O", "Open")], "child string, parent string"))
    for limit in (200_000, 0):  # sent to all tasks, and joined
        monkeypatch.setattr(G, "SENT_ROWS", limit)
        got = G.fixed_edges(edges, types, relations, closed)
        assert sorted(map(tuple, got.collect())) == [("d", "a", "b", "needs"), ("d", "a", "x", "isA"), ("d", "b", "a", "free")]


def test_profiles_are_drawn_again(spark):
    from quillrank.operators import generation as N

    rows = [("full", k, f"{k}{i}", float(i + 1)) for k in "ab" for i in range(6)] + [("poor", "a", f"a{i}", 1.0 if i == 0 else None) for i in range(4)] + [("flat", "a", f"a{i}", 0.0) for i in range(3)] + [("few", "b", "b0", 2.0)]
    items = spark.createDataFrame(rows, "occ string, kind string, code string, w double")
    built, unfilled = N.built_profiles(items, {"a": 2, "b": 3}, 4, ["occ"], "kind", "code", "w")
    got = {}
    for r in built.collect():
        got.setdefault((r["occ"], r["profile"]), []).append((r["kind"], r["code"], r["attempt"]))
    assert {o: {len(v) for (occ, _), v in got.items() if occ == o} for o in ("full", "flat", "few")} == {"full": {5}, "flat": {2}, "few": {1}}
    assert {(r["occ"], r["profile"]) for r in unfilled.collect()} == {("poor", i) for i in range(4)} and all(a == 0 for v in got.values() for _, _, a in v)
    # a rule of its own: the profile holds the heaviest item
    built, unfilled = N.built_profiles(items.filter("occ = 'full'"), {"a": 1}, 40, ["occ"], "kind", "code", "w", valid=F.max("w") == 6)
    kept = {r["profile"]: r["attempt"] for r in built.collect()}
    left = {r["profile"] for r in unfilled.collect()}
    assert not left & kept.keys() and left | kept.keys() == set(range(40)) and max(kept.values()) > 0 and {r["code"] for r in built.collect()} == {"a5"}
    assert N.built_profiles(items.limit(0), {"a": 1}, 2, ["occ"], "kind", "code", "w")[0].count() == 0
