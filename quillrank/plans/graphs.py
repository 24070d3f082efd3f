"""Ontology and graph queries: regions, nations and people as classes; an order's lines as a document's nodes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from .tables import dealt, query, rounded, table

_PARENTS = "p AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"
_CLOSED = _PARENTS + ", k(node, ancestor, depth) AS (SELECT DISTINCT x, x, 0 FROM (SELECT child AS x FROM p UNION SELECT parent FROM p) UNION ALL SELECT k.node, p.parent, k.depth + 1 FROM k JOIN p ON k.ancestor = p.child), closed AS (SELECT node, ancestor, min(depth) AS depth FROM k GROUP BY ALL)"


def _parents(spark, sf_dir):
    key = lambda sign, c: F.concat(F.lit(sign), F.col(c).cast("string"))
    n = table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent"))
    c = table(spark, sf_dir, "customer").select(key("c", "c_custkey"), key("n", "c_nationkey"))
    s = table(spark, sf_dir, "supplier").select(key("s", "s_suppkey"), key("n", "s_nationkey"))
    return n.union(c).union(s)


@query(f"WITH RECURSIVE {_CLOSED} SELECT node, ancestor, depth FROM closed")
def superclass_closure(spark, sf_dir):
    return G.closure(_parents(spark, sf_dir))


@query(f"WITH RECURSIVE {_CLOSED} SELECT node, string_agg(ancestor, '>' ORDER BY depth, ancestor) AS chain FROM closed GROUP BY node")
def superclass_chain(spark, sf_dir):
    return G.chains(G.closure(_parents(spark, sf_dir))).select("node", F.array_join("chain", ">").alias("chain"))


@query(f"WITH {_PARENTS} SELECT DISTINCT child AS node FROM p WHERE child NOT IN (SELECT parent FROM p)")
def leaf_classes(spark, sf_dir):
    return G.leaves(_parents(spark, sf_dir))


@query("WITH s AS (SELECT r_name, CASE WHEN r_name LIKE 'A%' OR regexp_matches(r_name, '(Type|Role)$') THEN 'jd' ELSE 'cv' END AS side FROM region) SELECT a.r_name AS domain, b.r_name AS range, CASE WHEN a.side <> b.side THEN 'cross_side' WHEN a.side = 'jd' THEN 'intra_jd' ELSE 'intra_cv' END AS bucket FROM s a CROSS JOIN s b")
def relation_buckets(spark, sf_dir):
    r = table(spark, sf_dir, "region").select("r_name", G.side(F.col("r_name"), F.col("r_name").startswith("A")).alias("side"))
    both = r.select(F.col("r_name").alias("domain"), F.col("side").alias("d")).crossJoin(r.select(F.col("r_name").alias("range"), F.col("side").alias("r")))
    return both.select("domain", "range", G.relation_bucket(F.col("d"), F.col("r")).alias("bucket"))


_NODES = "v AS (SELECT l_orderkey AS doc_id, l_linenumber AS node, bool_or(l_returnflag = 'R') AS matched, max(1 + l_quantity % 5)::DOUBLE AS w, min(l_linestatus) AS type FROM lineitem GROUP BY 1, 2), e AS (SELECT doc_id, node AS source, lead(node) OVER (PARTITION BY doc_id ORDER BY node) AS target, CASE WHEN node % 2 = 0 THEN 0 ELSE 1 END AS cost FROM v QUALIFY target IS NOT NULL)"
_HOPS = _NODES + ", u AS (SELECT doc_id, source, target, cost FROM e UNION SELECT doc_id, target, source, cost FROM e), h(doc_id, node, d, i) AS (SELECT doc_id, node, 0, 0 FROM v WHERE matched UNION SELECT h.doc_id, u.target, h.d + u.cost, h.i + 1 FROM h JOIN u ON h.doc_id = u.doc_id AND h.node = u.source WHERE h.i < (SELECT count(DISTINCT l_linenumber) FROM lineitem)), dist AS (SELECT doc_id, node, min(d)::INTEGER AS dist FROM h GROUP BY 1, 2)"


def _count(spark, sf_dir):
    """Rows of the lines, out of the files' footers."""
    return table(spark, sf_dir, "lineitem").count()


def _nodes(spark, sf_dir):
    """Partitioned by document once, so that what goes by document, or by document and node, is not shuffled again."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("node"), "l_returnflag", "l_quantity", "l_linestatus")
    rows = dealt(rows, _count(spark, sf_dir), "doc_id").groupBy("doc_id", "node")
    return rows.agg(F.max(F.col("l_returnflag") == "R").alias("matched"), F.max(1 + F.col("l_quantity") % 5).alias("w"), F.min("l_linestatus").alias("type"))


def _edges(nodes):
    to = F.lead("node").over(Window.partitionBy("doc_id").orderBy("node"))
    return nodes.select("doc_id", F.col("node").alias("source"), to.alias("target"), F.when(F.col("node") % 2 == 0, 0).otherwise(1).alias("cost")).filter("target is not null")


@query(f"WITH RECURSIVE {_HOPS} SELECT doc_id, node, dist FROM dist")
def bfs_hops(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return G.hops(nodes.filter("matched"), _edges(nodes))


_SIMPLE = (
    _NODES
    + """, u AS (SELECT doc_id, source, target, cost FROM e UNION SELECT doc_id, target, source, cost FROM e),
 h(doc_id, node, d, i, r) AS (SELECT doc_id, node, 0, 0, [node] FROM v WHERE matched UNION ALL SELECT h.doc_id, u.target, h.d + u.cost, h.i + 1, list_prepend(u.target, h.r) FROM h JOIN u ON h.doc_id = u.doc_id AND h.node = u.source WHERE NOT list_contains(h.r, u.target)),
 best AS (SELECT doc_id, node, d, list_reverse(r) AS path FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, node ORDER BY d, i, r) = 1)"""
)


@query(
    f"""WITH RECURSIVE {_SIMPLE} SELECT v.doc_id, v.node, (CASE WHEN matched THEN 1 ELSE d + 1 END)::INTEGER AS hop_distance, coalesce(array_to_string(path, '>'), '') AS path, w AS weight,
 round(CASE WHEN matched THEN 1.0 WHEN d IS NOT NULL THEN pow(0.5, d) ELSE 0 END, 4)::DOUBLE AS node_score FROM v LEFT JOIN best b ON v.doc_id = b.doc_id AND v.node = b.node"""
)
def hop_paths(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).withColumns({"label": F.lit(None).cast("string"), "importance": F.lit(None).cast("string")})
    n = _count(spark, sf_dir)
    found = dealt(G.with_paths(G.reach(nodes.filter("matched"), _edges(nodes))), n, "doc_id", "node")
    maps = G.detail_maps(dealt(G.detail(nodes, found), n, "doc_id"))
    rows = maps.select("doc_id", F.explode("detail").alias("node", "d")).select("doc_id", "node", "d.*")
    return rows.select("doc_id", "node", "hop_distance", F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("path"), "weight", "node_score")


_EXPLAINED = """j AS (SELECT l_orderkey AS doc_id, l_partkey AS node, min(l_linestatus) AS type, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'very important' END AS importance, any_value(p_name) AS label, (1 + l_partkey % 5)::DOUBLE AS w FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'N' GROUP BY l_orderkey, l_partkey),
 c AS (SELECT l_orderkey AS doc_id, l_partkey AS other, min(l_linestatus) AS other_type, any_value(p_name) AS other_label, (1 + l_partkey % 4)::DOUBLE / 4 AS conf FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N' GROUP BY l_orderkey, l_partkey),
 m AS (SELECT j.doc_id, node, count(*) AS n, max(conf) AS top, string_agg(printf(chr(10) || '    [%s] %s  (conf=%.2f)', other_type, other_label, conf), '' ORDER BY conf DESC, other) AS lines FROM j JOIN c ON j.doc_id = c.doc_id AND node % 2 = other % 2 GROUP BY ALL),
 l AS (SELECT j.doc_id, j.node, n, CASE WHEN n > 0 THEN printf(chr(10) || '✓ [%s] [%s] %s  →  +%.2f', type, coalesce(importance, 'important'), label, w * top) || lines ELSE printf(chr(10) || '✗ [%s] [%s] %s  →  -%.2f  (no match)', type, coalesce(importance, 'important'), label, w) END AS line FROM j LEFT JOIN m ON j.doc_id = m.doc_id AND j.node = m.node)"""


@query(
    f"WITH {_EXPLAINED} SELECT doc_id, 'MATCHES' || chr(10) || repeat('=', 60) || chr(10) || string_agg(line, chr(10) ORDER BY node) || chr(10) || printf('%sSummary: %d matched, %d unmatched out of %d JD nodes', chr(10), count(n), count(*) - count(n), count(*)) AS explanation FROM l GROUP BY doc_id"
)
def pair_explanations(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("label"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("node"), F.col("l_linestatus").alias("type"), (F.col("l_returnflag") == "N").alias("wanted"))
    lines = lines.groupBy("doc_id", "node", "wanted").agg(F.min("type").alias("type")).join(part, "node")
    wanted = lines.filter("wanted").select("doc_id", "node", "type", "label", F.when(F.col("node") % 3 != 0, "very important").alias("importance"), (1 + F.col("node") % 5).cast("double").alias("w"))
    held = lines.filter("not wanted").select("doc_id", F.col("node").alias("other"), F.col("type").alias("other_type"), F.col("label").alias("other_label"), ((1 + F.col("node") % 4).cast("double") / 4).alias("conf"))
    met = wanted.select("doc_id", "node", (F.col("node") % 2).alias("_k")).join(held.withColumn("_k", F.col("other") % 2), ["doc_id", "_k"]).drop("_k")
    return G.explained(wanted, met, ["doc_id"], "MATCHES")


_ON_SCALE = "round(greatest(1.0, least(10.0, 1 + 9 * (sum(w * (2 * s - 1)) + sum(w)) / (2 * sum(w)))), 6)"


@query(f"WITH RECURSIVE {_HOPS}, n AS (SELECT v.doc_id, w, CASE WHEN matched THEN 1.0 WHEN dist IS NOT NULL THEN pow(0.5, dist) ELSE 0 END AS s FROM v LEFT JOIN dist ON v.doc_id = dist.doc_id AND v.node = dist.node) SELECT doc_id, {_ON_SCALE} AS score FROM n GROUP BY doc_id")
def graph_score(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    far = G.hops(nodes.filter("matched"), _edges(nodes))
    rows = nodes.join(far, ["doc_id", "node"], "left").withColumn("node_score", G.node_score(F.col("matched"), F.col("dist")))
    return rounded(G.graph_score(rows, ["doc_id"]))


@query(f"WITH RECURSIVE {_HOPS}, n AS (SELECT v.doc_id, w, CASE WHEN coalesce(dist, 9) + 1 = 1 THEN 1.0 ELSE 0 END AS s FROM v LEFT JOIN dist ON v.doc_id = dist.doc_id AND v.node = dist.node) SELECT doc_id, {_ON_SCALE} AS score FROM n GROUP BY doc_id")
def norel_ablation(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    free = _edges(nodes).filter("cost = 0")  # what costs nothing is reached by isA edges alone
    far = G.hops(nodes.filter("matched"), free)
    rows = nodes.join(far, ["doc_id", "node"], "left").withColumn("node_score", G.ablated_score(F.col("matched"), F.col("dist")))
    return rounded(G.graph_score(rows, ["doc_id"]))


@query(f"WITH {_NODES} SELECT DISTINCT doc_id, node || '__' || type AS shadow, node::VARCHAR AS node FROM v")
def shadow_nodes(spark, sf_dir):
    _, edges = G.shadows(_nodes(spark, sf_dir))
    return edges.select("doc_id", F.col("target").alias("shadow"), F.col("source").alias("node"))


@query(f"WITH {_NODES} SELECT doc_id, node, 'n_' || type || '_' || row_number() OVER (PARTITION BY doc_id, type ORDER BY node) AS node_id FROM v")
def minted_ids(spark, sf_dir):
    return G.numbered_nodes(_nodes(spark, sf_dir), "doc_id", "type", "node").select("doc_id", "node", "node_id")


@query(
    f"""WITH {_NODES}, t AS (SELECT e.doc_id, source, target, a.type AS s, b.type AS t, CASE WHEN source % 3 = 0 THEN 'isA' WHEN source % 3 = 1 THEN 'needs' ELSE 'free' END AS relation FROM e JOIN v a ON e.doc_id = a.doc_id AND e.source = a.node JOIN v b ON e.doc_id = b.doc_id AND e.target = b.node)
 SELECT DISTINCT doc_id, CASE WHEN relation = 'needs' AND NOT (s = 'F' AND t = 'O') THEN target ELSE source END AS source, CASE WHEN relation = 'needs' AND NOT (s = 'F' AND t = 'O') THEN source ELSE target END AS target, relation FROM t WHERE relation <> 'needs' OR (s = 'F' AND t = 'O') OR (s = 'O' AND t = 'F')"""
)
def edge_fix(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    kind = F.col("source") % 3
    edges = _edges(nodes).select("doc_id", "source", "target", F.when(kind == 0, "isA").when(kind == 1, "needs").otherwise("free").alias("relation"))
    relations = spark.createDataFrame([("needs", "Finished", "Open"), ("isA", "Open", "Open")], "label string, domain string, range string")
    closed = G.closure(spark.createDataFrame([("F", "Finished"), ("O", "Open")], "child string, parent string"), 2)
    return G.fixed_edges(edges, nodes, relations, closed)


@query("SELECT n_name, min(ord) AS ord FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (VALUES (1, 'ASIA'), (2, 'AFRICA'), (0, 'EUROPE')) x(ord, name) ON r_name = name GROUP BY n_name")
def type_pair_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    closed = G.closure(n.select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")), 2)
    pairs = spark.createDataFrame([(1, "ASIA", "ASIA"), (2, "AFRICA", "AFRICA"), (0, "EUROPE", "EUROPE")], "ord int, jd_type string, cv_type string")
    names = n.select(F.col("n_name").alias("left_type"))
    found = G.matching_pair(names, names.select(F.col("left_type").alias("right_type")), closed, pairs)
    return found.filter("left_type = right_type").select(F.col("left_type").alias("n_name"), "ord")


_LINES = "l AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS pos, p_name AS name, l_returnflag AS flag FROM lineitem JOIN part ON l_partkey = p_partkey), x AS (SELECT *, list_distinct(string_split(lower(name), ' ')) AS t FROM l)"


@query(f"WITH {_LINES} SELECT a.doc, a.name, min(b.pos) AS first FROM (SELECT DISTINCT doc, name, t FROM x WHERE flag = 'A') a LEFT JOIN (SELECT * FROM x WHERE flag <> 'A') b ON a.doc = b.doc AND (((len(list_intersect(a.t, b.t)) IN (len(a.t), len(b.t))) AND least(len(a.t), len(b.t))::DOUBLE / greatest(len(a.t), len(b.t)) >= 0.5) OR len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) >= 0.8) GROUP BY a.doc, a.name")
def extraction_overlap(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    lines = table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), "name", F.col("l_returnflag").alias("flag")).distinct()
    wanted = lines.filter("flag = 'A'").select("doc", "name", X.token_set(F.col("name")).alias("a")).distinct()
    nodes = lines.filter("flag <> 'A'").select("doc", "pos", X.token_set(F.col("name")).alias("b"))
    return G.first_matches(wanted, nodes, ["doc"], X.labels_match(F.col("a"), F.col("b")), "pos", ["doc", "name"])


@query("SELECT l_returnflag AS side, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS hit, round(100.0 * count(*) FILTER (l_linestatus = 'F') / count(*), 6) AS percent FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())")
def inst_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").rollup(F.col("l_returnflag").alias("side"))
    hit = F.count_if(F.col("l_linestatus") == "F")
    return rounded(rows.agg(F.count("*").alias("n"), hit.alias("hit"), (100.0 * hit / F.count("*")).alias("percent")))


@query("WITH a AS (SELECT l_partkey, avg(l_quantity) AS x, avg(l_extendedprice) / 1000 AS y FROM lineitem GROUP BY 1) SELECT l_partkey, round(100 * (x - y) / abs(y), 6) AS gain FROM a")
def relative_gain(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("x"), (F.avg("l_extendedprice") / 1000).alias("y"))
    return rounded(rows.select("l_partkey", G.relative_gain(F.col("x"), F.col("y")).alias("gain")))


