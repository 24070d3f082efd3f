"""Operators, readers and sinks that no query calls."""

import json

import pytest
from pyspark.sql import functions as F

from quillrank.functions import completions as C
from quillrank.functions import text as X
from quillrank.operators import extraction as E
from quillrank.operators import generation as N
from quillrank.operators import graph as G
from quillrank.operators import relational as L
from quillrank.operators import reports as P
from quillrank.sources import readers, writers


def test_nodes_from_the_model(spark):
    df = spark.createDataFrame([(1, "llm"), (2, "anchor"), (3, "inferred"), (4, None)], "id int, source string")
    assert [r["id"] for r in E.from_model(df).collect()] == [1]


def test_definitions_and_sections(spark):
    classes = spark.createDataFrame([("cv", "Skill", "an ability"), ("cv", "Task", None), ("jd", "SkillType", "old"), ("jd", "ToolType", "tool"), ("jd", "RootType", "r"), ("cv", "Input", "in"), ("cv", "Output", "out")], "side string, label string, comment string")
    assert sorted(map(tuple, E.definitions(classes, "cv", "Output").collect())) == [("Input", "in"), ("Skill", "an ability")]
    wording = spark.createDataFrame([("SkillType", "A needed Skill.", ["Skill"]), ("ToolType", "A tool.", ["Input", "Output"]), ("RootType", "Root.", ["none"])], "label string, lead string, of array<string>")
    got = {(r["side"], r["label"]): r["comment"] for r in E.enriched_comments(classes, wording).collect()}
    assert got["jd", "SkillType"] == "A needed Skill. an ability" and got["jd", "ToolType"] == "A tool. in / out" and got["jd", "RootType"] == "Root." and got["cv", "Skill"] == "an ability" and len(got) == 7
    relations = spark.createDataFrame([("needs", "A", "B", "intra_cv", "c"), ("needs", "C", "D", "intra_cv", None), ("has", "A", "A", "cross_side", "x")], "label string, domain string, range string, bucket string, comment string")
    assert sorted(map(tuple, E.relation_definitions(relations, ["intra_cv"]).collect())) == [("needs", "A", "B", "c")]
    closed = G.closure(spark.createDataFrame([("S", "T"), ("T", "U")], "child string, parent string"))
    types = spark.createDataFrame([(1, "S"), (1, "T"), (1, "S"), (2, "U")], "doc int, type string")
    assert [tuple(r) for r in E.superclass_section(types, closed, ["doc"]).collect()] == [(1, "S: T > U\nT: U")]


def test_partitions_that_are_read(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "experiment string, v int").write.partitionBy("experiment").parquet(f"{tmp_path}/t")
    df = L.only(spark.read.parquet(f"{tmp_path}/t"), "experiment", ["a", "c"])
    assert sorted(r["v"] for r in df.collect()) == [1, 3]
    assert "PartitionFilters: [experiment" in df._jdf.queryExecution().executedPlan().toString()


def test_newest_runs_first(spark):
    df = spark.createDataFrame([("a", "2024-01-02", None), ("b", None, "2024-03-01"), ("c", None, None), ("d", "2024-03-01", "2020")], "run string, timestamp string, submission_time string")
    assert [r["run"] for r in P.newest_first(df, "timestamp", "submission_time").collect()] == ["b", "d", "a", "c"]


def test_metrics_by_settings(spark):
    df = spark.createDataFrame([(i, float(i), 1, 2.0 * i) for i in range(30)], "q int, num double, den int, other double")
    metrics = {"mean": [("num", "den", 1)], "twice": [("other", "den", 1)], "off": [("num", "other", 1)]}
    got = {r["metric"]: r for r in P.configured(df, metrics, {"twice": {"ci": False}, "off": {"enabled": False}}, 40, ["q"]).collect()}
    assert got.keys() == {"mean", "twice"} and got["mean"]["value"] == 14.5 and got["mean"]["ci_lower"] < 14.5 < got["mean"]["ci_upper"]
    assert got["twice"]["value"] == 29.0 and got["twice"]["ci_lower"] is None
    plans = P.attempted({"good": lambda d: d.select("num"), "bad": lambda d: d.select("none")}, df)
    assert plans["bad"] is None and plans["good"].columns == ["num"]


def test_names(spark):
    df = spark.createDataFrame([("run_Llama8B_x",), ("x_gpt4omini",), ("z",)], "v string")
    assert [r[0] for r in df.select(X.model_of(F.col("v"), ["llama70b", "llama8b", "gpt4omini"])).collect()] == ["llama8b", "gpt4omini", "unknown"]
    names, taken = (spark.createDataFrame([(v,) for v in rows], "name string") for rows in (["a", "a", "b", "c"], ["a", "c", "c"]))
    assert sorted((r["name"], r["run_name"]) for r in N.minted_names(names, taken).collect()) == [("a", "a(1)"), ("a", "a(2)"), ("b", "b"), ("c", "c(2)")]
    numbers = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double")
    assert [r[0] for r in numbers.select(X.json_safe(F.col("v"))).collect()] == [1.5, None, None, None, None]


def test_sinks_of_a_run(spark, tmp_path):
    read = lambda path: [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/{path}").collect()]
    scores = spark.createDataFrame([("c", "j", 7.5, {"n": 1})], "cv_id string, jd_id string, score double, detail map<string,int>")
    writers.scores_and_detail(scores, f"{tmp_path}/run")
    assert read("run/scores") == [{"cv_id": "c", "jd_id": "j", "score": 7.5}] and read("run/detail") == [{"cv_id": "c", "jd_id": "j", "detail": {"n": 1}}]
    log = spark.createDataFrame([("r1", "2024-01-01T00:00:00"), ("r2", None)], "run_name string, timestamp string")
    for _ in range(2):
        writers.run_log(log, f"{tmp_path}/log")
    rows = read("log")
    assert len(rows) == 4 and {r["timestamp"] for r in rows if r["run_name"] == "r1"} == {"2024-01-01T00:00:00"} and all(len(r["timestamp"]) == 19 for r in rows)
    writers.pairs_jsonl(scores, f"{tmp_path}/pairs", ["jd_id", "score"])
    assert read("pairs") == [{"jd_id": "j", "score": 7.5}]
    steps = spark.createDataFrame([("extract", "p1", "c1"), ("score", "p2", "c2")], "step string, prompt string, completion string")
    for _ in range(2):
        writers.step_log(steps, f"{tmp_path}/steps")
    assert spark.read.json(f"{tmp_path}/steps").groupBy("step").count().collect() and spark.read.json(f"{tmp_path}/steps").filter("step = 'score'").count() == 2
    classes = spark.createDataFrame([("jd", "B", None), ("cv", "Z", "z"), ("cv", "A", "a")], "side string, label string, comment string")
    relations = spark.createDataFrame([("intra_jd", "r", "B", "B"), ("cross_side", "q", "A", "B")], "bucket string, label string, domain string, range string")
    writers.schema_dump(classes, relations, f"{tmp_path}/schema")
    assert [(c["side"], c["label"]) for c in read("schema/classes")] == [("cv", "A"), ("cv", "Z"), ("jd", "B")] and [r["label"] for r in read("schema/relations")] == ["q", "r"]


def test_batch_lines(spark):
    body = lambda **b: {"status_code": 200, "body": b}
    said = lambda *texts: [{"type": "reasoning"}, {"type": "message", "content": [{"type": "x", "text": "no"}, *({"type": "output_text", "text": t} for t in texts)]}]
    cases = [
        ({"text": "hi"}, "hi", None),
        ({"text": "hi", "error": "bad"}, None, "bad"),
        ({"text": None, "error": {"message": "worse"}}, None, "worse"),
        ({"error": {"message": "transport"}}, None, "transport"),
        ({"error": None}, None, "Missing response object"),
        ({"response": {"status_code": 500, "body": {}}}, None, "HTTP 500"),
        ({"response": {"status_code": 400, "body": {"error": {"message": "no such model"}}}}, None, "no such model"),
        ({"response": body(error={"message": "model"})}, None, "model"),
        ({"response": body(status="incomplete", incomplete_details={"reason": "max_output_tokens"}, output=said("cut"))}, None, "INCOMPLETE: Token limit reached (max_output_tokens exceeded)"),
        ({"response": body(status="incomplete", incomplete_details={"reason": "odd"})}, None, "INCOMPLETE: Status incomplete (reason: odd)"),
        ({"response": body(status="completed", output=[*said("", "no"), *said("later")])}, "later", None),
        ({"response": body(status="completed", output=said("", "no"))}, "", None),
        ({"response": body(output=said("one", "two"))}, "one", None),
        ({"response": body(output=[])}, None, "No output_text found"),
        ({"result": {"type": "succeeded", "message": {"stop_reason": "end_turn", "content": [{"type": "text", "text": " a "}, {"type": "tool"}, {"type": "text", "text": "b"}]}}}, "a \nb", None),
        ({"result": {"type": "succeeded", "message": {"stop_reason": "max_tokens", "content": [{"type": "text", "text": "half"}]}}}, "half", "INCOMPLETE: Token limit reached (max_tokens)"),
        ({"result": {"type": "succeeded", "message": {"content": []}}}, None, "No text content found"),
        ({"result": {"type": "errored", "error": {"type": "x", "message": "Max_Tokens too large"}}}, None, "INCOMPLETE: Token limit - Max_Tokens too large"),
        ({"result": {"type": "errored", "error": {"type": "x", "message": "busy"}}}, None, "busy"),
        ({"result": {"type": "expired"}}, None, '{"type":"expired"}'),
    ]
    df = spark.createDataFrame([(i, json.dumps({"custom_id": f"k{i}"} | line)) for i, (line, _, _) in enumerate(cases)], "i int, line string")
    got = {r["i"]: (r["x"]["custom_id"], r["x"]["text"], r["x"]["error"]) for r in df.select("i", C.batch_line(F.col("line")).alias("x")).collect()}
    for i, (line, text, error) in enumerate(cases):
        assert got[i] == (f"k{i}", text, error), line


def test_two_keys_of_many_to_one(spark):
    left = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "z")], "element int, category string, v string")
    right = spark.createDataFrame([(1, "a", "one"), (1, "b", "two")], "element int, category string, description string")
    assert sorted((r["v"], r["description"]) for r in L.many_to_one(left, right, ["element", "category"]).collect()) == [("x", "one"), ("y", "two"), ("z", None)]
    with pytest.raises(ValueError):
        L.many_to_one(left, right.union(right.limit(1)), ["element", "category"])


def test_tables_with_chosen_columns(spark, tmp_path):
    (tmp_path / "t.txt").write_text('O*NET-SOC Code\tTitle\tMore\n11-1\t"a, ""b"""\t1.5\n11-2\t\tx\n')
    rows = readers.table(spark, f"{tmp_path}/t.txt", "`O*NET-SOC Code` STRING, Title STRING, More DOUBLE", ["O*NET-SOC Code", "More"], {"O*NET-SOC Code": "occ"})
    assert rows.columns == ["occ", "More"] and sorted(map(tuple, rows.collect())) == [("11-1", 1.5), ("11-2", None)]


def test_lists_and_statements_over_lines(spark, tmp_path):
    text = 'ex:A ex:in ( ex:B "x y" ( ) [ ex:p ex:C ] ) ;\n  ex:label\n    "two\\nlines" .\n( ex:D ) ex:q ex:E .'
    want = [("_:[0]", "ex:p", "ex:C"), ("_:[1]", "rdf:first", "ex:B"), ("_:[1]", "rdf:rest", "_:[2]"), ("_:[2]", "rdf:first", "x y"), ("_:[2]", "rdf:rest", "_:[3]"), ("_:[3]", "rdf:first", "rdf:nil"), ("_:[3]", "rdf:rest", "_:[4]"), ("_:[4]", "rdf:first", "_:[0]"), ("_:[4]", "rdf:rest", "rdf:nil"), ("ex:A", "ex:in", "_:[1]"), ("_:[5]", "rdf:first", "ex:D"), ("_:[5]", "rdf:rest", "rdf:nil"), ("_:[5]", "ex:q", "ex:E")]
    found = readers.triples_of(text)
    assert [t for t in found if t[1] != "ex:label"] == want and ("ex:A", "ex:label", "two\\nlines") in found
    (tmp_path / "o.ttl").write_text(text)
    assert sorted(map(tuple, readers.turtle(spark, f"{tmp_path}/o.ttl").collect())) == sorted(found)


def test_zipped_pairs_of_a_large_group(spark):
    left = spark.createDataFrame([(i, "big") for i in range(200)] + [(500, "l"), (501, None)], "cv int, occ string").repartition(7)
    right = spark.createDataFrame([(1000 + i, "big") for i in range(150)] + [(1500, "r"), (1501, None)], "jd int, occ string")
    got = sorted((r["cv"], r["jd"]) for r in L.pairs_zipped(left, right, "occ", "cv", "jd").collect())
    assert got == [(i, 1000 + i) for i in range(150)]
