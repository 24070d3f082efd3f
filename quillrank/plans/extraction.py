"""Parsing of relations and instances, matches and counters of extraction, nested edits and look-ups, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import extraction as E
from ..operators import graph as G
from ..operators import ranking as R
from ..operators import relational as J
from ..operators import reports as P
from .graphs import _LINES, _NODES, _edges, _nodes
from .tables import SCORED, query, rounded, scored, table


@query("SELECT c_custkey FROM customer WHERE c_custkey::VARCHAR NOT LIKE '%0'")
def suffix_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("code"))
    return J.without_suffix(rows, "code", "0").select("c_custkey")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IS NULL OR c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def exclude_groups(spark, sf_dir):
    excluded = table(spark, sf_dir, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return J.without_groups(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), excluded, "c_nationkey").select("c_custkey", "c_nationkey")


_TITLES = "t AS (SELECT c_custkey, c_nationkey AS code, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN ' ' END AS title FROM customer), r AS (SELECT n_nationkey AS code, n_name AS ref FROM nation WHERE n_regionkey <> 1)"


def _titles(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("code"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.lit(" ")).alias("title"))
    return rows, table(spark, sf_dir, "nation").filter("n_regionkey <> 1").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("title"))


@query(f"WITH {_TITLES} SELECT c_custkey, t.code, coalesce(nullif(trim(title), ''), ref, 'Occupation ' || t.code) AS title FROM t LEFT JOIN r ON t.code = r.code")
def title_fallback(spark, sf_dir):
    return J.titled(*_titles(spark, sf_dir), "code", "title")


@query(f"WITH {_TITLES} SELECT c_custkey, t.code, coalesce(nullif(trim(title), ''), ref) AS title FROM t LEFT JOIN r ON t.code = r.code WHERE coalesce(nullif(trim(title), ''), ref) IS NOT NULL")
def title_required(spark, sf_dir):
    return J.titled(*_titles(spark, sf_dir), "code", "title", required=True)


@query("WITH p AS (SELECT c_custkey AS id, c_name AS text FROM customer WHERE c_custkey % 4 <> 0), c AS (SELECT o_orderkey, o_custkey AS cv_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey + 1 END AS jd_id FROM orders) SELECT o_orderkey, coalesce(a.text, '') AS cv_profile_text, coalesce(b.text, '') AS jd_profile_text, CASE WHEN a.id IS NULL OR (c.jd_id IS NOT NULL AND b.id IS NULL) THEN 'no_input' ELSE 'ok' END AS parse_status FROM c LEFT JOIN p a ON c.cv_id = a.id LEFT JOIN p b ON c.jd_id = b.id")
def completion_profiles(spark, sf_dir):
    profiles = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("profile_id"), F.col("c_name").alias("profile_text"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cv_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") + 1).alias("jd_id"), F.lit("ok").alias("parse_status"))
    return J.with_profiles(rows, profiles).select("o_orderkey", "cv_profile_text", "jd_profile_text", "parse_status")


def _graph(spark, sf_dir):
    """Nodes with their positions, numbered edges, and the types' superclasses."""
    nodes = _nodes(spark, sf_dir)
    at = lambda df: df.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("node")) - 1)
    closed = G.closure(spark.createDataFrame([("F", "Finished"), ("O", "Open")], "child string, parent string"), 2)
    named = nodes.select("doc_id", "node", F.col("node").cast("string").alias("node_id"), "type", F.lit("llm").alias("source"))
    return named, at, _edges(nodes), closed


def _raw(rows):
    line = F.concat(F.lit('{"dep": "ENT'), F.col("dep").cast("string"), F.lit('", "dest": "ENT'), F.col("dest").cast("string"), F.lit('", "relation": "'), F.col("relation"), F.lit('"}'))
    return rows.groupBy("doc_id").agg(F.concat(F.lit("```json\nnonsense\n{broken\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n```")).alias("raw"))


_TYPED = _NODES + ", t AS (SELECT e.doc_id, source, target, a.type AS s, b.type AS t, CASE WHEN source % 3 = 0 THEN 'under' WHEN source % 3 = 1 THEN 'needs' ELSE 'unknown' END AS relation FROM e JOIN v a ON e.doc_id = a.doc_id AND e.source = a.node JOIN v b ON e.doc_id = b.doc_id AND e.target = b.node)"


@query(f"WITH {_TYPED} SELECT DISTINCT doc_id, CASE WHEN (relation = 'needs' AND s = 'F') THEN source || '__Finished' WHEN relation = 'under' AND s = 'O' THEN source || '__Open' ELSE source::VARCHAR END AS source, CASE WHEN t = 'O' THEN target || '__Open' ELSE target::VARCHAR END AS target, relation FROM t WHERE relation <> 'unknown' UNION ALL SELECT DISTINCT doc_id, node::VARCHAR, node || '__' || super, 'isA' FROM (SELECT doc_id, source AS node, CASE WHEN relation = 'needs' AND s = 'F' THEN 'Finished' WHEN relation = 'under' AND s = 'O' THEN 'Open' END AS super FROM t WHERE relation <> 'unknown' UNION ALL SELECT doc_id, target, CASE WHEN t = 'O' THEN 'Open' END FROM t WHERE relation <> 'unknown') WHERE super IS NOT NULL")
def relation_parse(spark, sf_dir):
    named, at, edges, closed = _graph(spark, sf_dir)
    nodes, kind = at(named), F.col("source") % 3
    pos = nodes.select("doc_id", "node", "pos")
    rows = edges.withColumn("relation", F.when(kind == 0, "under").when(kind == 1, "needs").otherwise("unknown"))
    rows = rows.join(pos.withColumnsRenamed({"node": "source", "pos": "dep"}), ["doc_id", "source"]).join(pos.withColumnsRenamed({"node": "target", "pos": "dest"}), ["doc_id", "target"])
    relations = spark.createDataFrame([(0, "needs", "Open", "Open"), (1, "needs", "Finished", "Open"), (2, "under", "Open", "Open")], "ord int, label string, domain string, range string")
    found, isa = E.parsed_relations(_raw(rows), nodes, relations, closed)
    return found.union(isa.select("doc_id", "source", "target", "relation"))


@query(f"WITH {_TYPED} SELECT DISTINCT doc_id, source || '__Finished' AS cv_id, target || '__Open' AS jd_id FROM t WHERE source % 2 = 1 AND target % 2 = 0 AND s = 'F' AND t = 'O'")
def instance_parse(spark, sf_dir):
    named, at, edges, closed = _graph(spark, sf_dir)
    cv, jd = at(named.filter("node % 2 = 1")), at(named.filter("node % 2 = 0"))
    n_cv = cv.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = edges.join(cv.select("doc_id", F.col("node").alias("source"), F.col("pos").alias("dep")), ["doc_id", "source"]).join(jd.select("doc_id", F.col("node").alias("target"), "pos"), ["doc_id", "target"]).join(n_cv, "doc_id")
    rows = rows.select("doc_id", "dep", (F.col("pos") + F.col("n")).alias("dest"), F.lit("inst").alias("relation"))
    pairs = spark.createDataFrame([(0, "Open", "Finished")], "ord int, jd_type string, cv_type string")
    return E.parsed_instances(_raw(rows), cv, jd, closed, pairs)


_TYPED_LINES = _LINES.replace("l_returnflag AS flag", "l_returnflag AS flag, l_linestatus AS type")
_COMMON = "len(list_intersect(a.t, b.t))"
_ALIKE = f"(((({_COMMON} IN (len(a.t), len(b.t))) AND least(len(a.t), len(b.t))::DOUBLE / greatest(len(a.t), len(b.t)) >= 0.5) OR {_COMMON}::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) >= 0.8))"


def _typed_lines(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    lines = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    return lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), "name", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("type")).distinct()


def _side(lines, flag, tokens):
    return lines.filter(F.col("flag") == flag).select("doc_id", F.concat_ws("-", "pos", "name", "type").alias("node_id"), "type", "pos", X.token_set(F.col("name")).alias(tokens))


@query(f"WITH {_TYPED_LINES}, a AS (SELECT * FROM x WHERE flag = 'A'), b AS (SELECT * FROM x WHERE flag = 'R') SELECT DISTINCT a.doc AS doc_id, concat_ws('-', a.pos, a.name, a.type) AS cv_id, concat_ws('-', b.pos, b.name, b.type) AS jd_id FROM a JOIN b ON a.doc = b.doc AND a.type = 'F' AND b.type = 'F' WHERE {_ALIKE}")
def string_instances(spark, sf_dir):
    lines = _typed_lines(spark, sf_dir)
    allowed = spark.createDataFrame([("F", "F")], "cv_type string, jd_type string")
    return E.string_instances(_side(lines, "A", "a").drop("pos"), _side(lines, "R", "b").drop("pos"), allowed, ["doc_id"], X.labels_match(F.col("a"), F.col("b")))


@query(f"WITH {_TYPED_LINES}, i AS (SELECT DISTINCT doc, name, t, length(name) % 3 AS category, length(name) % 2 AS expected FROM x WHERE flag = 'A'), m AS (SELECT a.doc, a.name, min(struct_pack(p := b.pos, y := CASE WHEN b.type = 'F' THEN 0 ELSE 1 END, r := b.pos % 2)) AS best FROM i a JOIN (SELECT * FROM x WHERE flag = 'R') b ON a.doc = b.doc AND {_ALIKE} GROUP BY ALL) SELECT category, count(*) AS total, count(best) AS span_matched, count(*) FILTER (best.y = 0) AS type_matched, count(*) FILTER (best.r = expected) AS importance_matched FROM i LEFT JOIN m ON i.doc = m.doc AND i.name = m.name GROUP BY category")
def extraction_counters(spark, sf_dir):
    lines = _typed_lines(spark, sf_dir)
    items = lines.filter("flag = 'A'").select("doc_id", F.col("name").alias("item"), (F.length("name") % 3).cast("long").alias("category"), (F.length("name") % 2).cast("long").alias("expected"), X.token_set(F.col("name")).alias("a")).distinct()
    nodes = lines.filter("flag = 'R'").select("doc_id", X.token_set(F.col("name")).alias("b"), F.struct("pos", F.when(F.col("type") == "F", 0).otherwise(1).alias("y")).alias("pos"), "type", (F.col("pos") % 2).cast("long").alias("importance"))
    return E.extraction_counters(items, nodes, X.labels_match(F.col("a"), F.col("b")), F.col("type") == "F", ["category"])


@query(f"WITH {_TYPED_LINES}, g AS (SELECT DISTINCT doc, name AS code, t FROM x WHERE flag = 'N'), a AS (SELECT a.doc, a.code, b.pos || '-' || b.name || '-' || b.type AS id, b.type FROM g a JOIN x b ON a.doc = b.doc AND b.flag = 'A' AND {_ALIKE}), j AS (SELECT a.doc, a.code, b.pos || '-' || b.name || '-' || b.type AS id, b.type FROM g a JOIN x b ON a.doc = b.doc AND b.flag = 'R' AND {_ALIKE}), inst AS (SELECT DISTINCT p.doc, p.pos || '-' || p.name || '-' || p.type AS cv, q.pos || '-' || q.name || '-' || q.type AS jd FROM x p JOIN x q ON p.doc = q.doc AND p.flag = 'A' AND q.flag = 'R' AND (p.pos + q.pos) % 2 = 0), hit AS (SELECT DISTINCT i.doc, a.code, cv, jd FROM inst i JOIN a ON a.doc = i.doc AND a.id = cv JOIN j ON j.doc = i.doc AND j.id = jd AND j.code = a.code) SELECT (SELECT count(*) FROM g) AS gt_total, (SELECT count(*) FROM (SELECT doc, code FROM a INTERSECT SELECT doc, code FROM j)) AS span_both, (SELECT count(*) FROM (SELECT DISTINCT a.doc, a.code FROM a JOIN j ON a.doc = j.doc AND a.code = j.code AND a.type = 'F' AND j.type = 'F')) AS type_compat, (SELECT count(*) FROM (SELECT DISTINCT doc, code FROM hit)) AS inst_found, (SELECT count(*) FROM inst) AS inst_total, (SELECT count(*) FROM (SELECT DISTINCT doc, cv, jd FROM hit)) AS inst_correct")
def instance_recall(spark, sf_dir):
    lines = _typed_lines(spark, sf_dir)
    truth = lines.filter("flag = 'N'").select("doc_id", F.col("name").alias("code"), X.token_set(F.col("name")).alias("g")).distinct()
    cv, jd = _side(lines, "A", "a"), _side(lines, "R", "b")
    inst = cv.select("doc_id", F.col("node_id").alias("cv_id"), F.col("pos").alias("p")).join(jd.select("doc_id", F.col("node_id").alias("jd_id"), F.col("pos").alias("q")), "doc_id").filter("(p + q) % 2 = 0").select("doc_id", "cv_id", "jd_id").distinct()
    allowed = spark.createDataFrame([("F", "F")], "cv_type string, jd_type string")
    same = lambda t: X.labels_match(F.col("g"), F.col(t))
    return E.instance_recall(truth, cv.drop("pos"), jd.drop("pos"), inst, same("a"), same("b"), allowed, ["doc_id"])


@query("SELECT DISTINCT 'q:n' || n_nationkey AS node, n_name AS label, substr(trim('About ' || n_name), 1, 12) AS comment FROM nation WHERE n_regionkey <> 2")
def described_leaves(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    node, up = F.concat(F.lit("q:n"), F.col("n_nationkey")), F.concat(F.lit("q:r"), F.col("n_regionkey"))
    triple = lambda df, s, p, o: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    parts = [triple(n, node, "type", F.lit("Class")), triple(n, node, "below", up), triple(n, node, "label", F.col("n_name"))]
    parts += [triple(n.filter("n_regionkey <> 2"), node, "comment", F.concat(F.lit("About "), F.col("n_name"), F.lit(" \nmore"))), triple(r, F.concat(F.lit("q:r"), F.col("r_regionkey")), "type", F.lit("Class"))]
    parts += [triple(r, F.concat(F.lit("q:r"), F.col("r_regionkey")), "comment", F.col("r_name")), triple(n, F.concat(F.lit("x:n"), F.col("n_nationkey")), "type", F.lit("Class"))]
    triples = parts[0]
    for p in parts[1:]:
        triples = triples.union(p)
    return E.described_leaves(triples, "q:", "Class", "below", "comment").join(E.described(triples, "label", "comment", 12), "node")


_ARRAYS = "a AS (SELECT o_custkey, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS own, list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS other FROM orders GROUP BY 1)"


@query(f"WITH {_ARRAYS} SELECT o_custkey, array_to_string(list_concat(['3-MEDIUM'], list_filter(own, lambda x: x <> '3-MEDIUM')), '|') AS anchored, array_to_string(list_concat(own, list_filter(other, lambda x: NOT list_contains(own, x))), '|') AS merged FROM a")
def nested_edits(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*(F.array_sort(F.collect_set(c)).alias(n) for c, n in (("o_orderpriority", "own"), ("o_orderstatus", "other"))))
    as_nodes = F.transform("own", lambda x: F.struct(x.alias("id")))
    anchored = F.transform(E.anchor_first(as_nodes, F.struct(F.lit("3-MEDIUM").alias("id"))), lambda n: n["id"])
    return rows.select("o_custkey", F.array_join(anchored, "|").alias("anchored"), F.array_join(E.merged(F.col("own"), F.concat("other", "other"), lambda x: x), "|").alias("merged"))


@query("SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(lower(p_type), '[_-]+'), lambda x: x <> ''), lambda x: substr(x, 1, 1)), '') AS style, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS prefix, regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS model, CASE WHEN p_brand = 'Brand#1' THEN 'first' ELSE p_brand END AS id, coalesce(try_cast(regexp_replace(p_name, '[^0-9]', '', 'g') AS DOUBLE), 0.0) AS number FROM part")
def short_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", X.short_style(F.col("p_type")).alias("style"), X.id_prefix(F.col("p_brand")).alias("prefix"), X.short_model(F.concat(F.lit("org/"), F.col("p_name"))).alias("model"), X.model_id(F.col("p_brand"), {"Brand#1": "first"}).alias("id"), X.safe_double(F.regexp_replace("p_name", "[^0-9]", "")).alias("number"))


@query("SELECT r_regionkey, 'Rate ' || r_name || ':' || chr(10) || 'Nodes' || chr(10) || string_agg(n_name || '[ENT' || (i + 3) || ':nation]', chr(10) ORDER BY n_name) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) - 1 AS i FROM region JOIN nation ON r_regionkey = n_regionkey) GROUP BY r_regionkey, r_name")
def node_prompts(spark, sf_dir):
    rows = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("label"), F.lit("nation").alias("type")))).alias("nodes"))
    return rows.select("r_regionkey", X.rendered("Rate {{ name }}:\n{{ nodes }}", name=F.col("r_name"), nodes=X.node_lines(F.col("nodes"), 3, "Nodes")).alias("prompt"))


@query(
    """WITH t AS (SELECT DISTINCT l_orderkey AS doc_id, p_brand AS type, p_type AS definition FROM lineitem JOIN part ON l_partkey = p_partkey),
 one AS (SELECT type, min(definition) AS definition FROM t GROUP BY type),
 u AS (SELECT DISTINCT doc_id, type FROM t)
 SELECT u.doc_id, 'Types:' || chr(10) || string_agg(u.type || ': ' || definition, chr(10) ORDER BY u.type) || chr(10) || 'Classes:' || chr(10) || string_agg(u.type || ': Group' || right(u.type, 1) || ' > Brand', chr(10) ORDER BY u.type) AS prompt FROM u JOIN one USING (type) GROUP BY u.doc_id"""
)
def section_prompts(spark, sf_dir):
    """Prompts with the definitions of a document's types and the classes above them: a brand lies below the group of its last digit, the groups below Brand."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("type"), F.col("p_type").alias("comment"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_partkey").join(part, "l_partkey")
    one = rows.groupBy("type").agg(F.min("comment").alias("comment"))
    types = rows.select("doc_id", "type").distinct()
    brands = part.select("type").distinct()
    group = F.concat(F.lit("Group"), F.substring("type", -1, 1))
    parents = brands.select(F.col("type").alias("child"), group.alias("parent")).union(brands.select(group, F.lit("Brand"))).distinct()
    above = E.superclass_section(types, G.closure(parents, 2), ["doc_id"]).withColumnRenamed("section", "classes")
    own = E.definition_section(types.join(one, "type"), ["doc_id"], "type")
    return own.join(above, "doc_id").select("doc_id", X.rendered("Types:\n{{ types }}\nClasses:\n{{ classes }}", types=F.col("section"), classes=F.col("classes")).alias("prompt"))



_PER_GROUP = f"WITH {SCORED}, n AS (SELECT jd_id, grp, sqrt(avg((score - gt) * (score - gt))) AS rmse, avg(abs(score - gt)) AS mae FROM c GROUP BY jd_id, grp)"


def _by_group(spark, sf_dir):
    long = R.errors_per_query(scored(spark, sf_dir), ["jd_id", "grp"]).unpivot(["jd_id", "grp"], ["rmse", "mae"], "metric", "v")
    return long.groupBy("grp", "metric").agg(F.avg("v").alias("value"), F.min("v").alias("ci_lower"), F.max("v").alias("ci_upper"))


@query(_PER_GROUP + " SELECT grp, " + ", ".join(f"round(avg({m}), 6) AS {m}, round(min({m}), 6) AS {m}_ci_lo, round(max({m}), 6) AS {m}_ci_hi" for m in ("rmse", "mae")) + " FROM n GROUP BY grp")
def metrics_flat(spark, sf_dir):
    return rounded(P.flattened(_by_group(spark, sf_dir), ["rmse", "mae"], ["grp"]))


@query(_PER_GROUP + " SELECT metric, round(a, 6) AS \"A\", round(r, 6) AS \"R\", round(a - r, 6) AS difference FROM (SELECT 'rmse' AS metric, avg(rmse) FILTER (grp = 'A') AS a, avg(rmse) FILTER (grp = 'R') AS r FROM n UNION ALL SELECT 'mae', avg(mae) FILTER (grp = 'A'), avg(mae) FILTER (grp = 'R') FROM n)")
def metric_comparison(spark, sf_dir):
    return P.compared(_by_group(spark, sf_dir), [], "grp", "A", "R")


@query("SELECT event_id, event_type FROM events WHERE event_type IS NOT NULL AND event_type <> '' ORDER BY event_id LIMIT 10")
def first_errors(spark, sf_dir):
    return P.first_errors(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ["event_id"])


@query("SELECT event_type, min(event_id) AS first FROM events GROUP BY event_type")
def first_order(spark, sf_dir):
    return P.in_first_order(table(spark, sf_dir, "events"), "event_type", "event_id")
