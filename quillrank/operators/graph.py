"""Ontology closure and graphs of documents: edge repair, shadow nodes, hop distances and scores.

Loops run until nothing changes, or to a stated depth; each round is a join on (document, node), so no graph is gathered in one place.
Without a stated depth, what was found is written to the shared folder every ROUNDS rounds, which cuts the plan and shows whether it grew.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .profiles import DEGENERATE, on_scale

#: Rounds of a loop without a stated depth between two written tables.
ROUNDS = 4
#: Rows of an ontology's tables that are sent to all tasks at most; more of them are joined by shuffles.
SENT_ROWS = 200_000
#: Rounds of a search within documents between two written tables.
HOP_ROUNDS = 8
#: Rows of a search that a task holds.
SEARCH_ROWS = 250_000


def _until_same(now: DataFrame, step) -> DataFrame:
    """step again and again until no value is added or lowered; rows are only added and values only lowered.

    _changed marks what the last round added or lowered; only that need be moved on, as all else was moved on before.
    Every ROUNDS rounds the state is written to the shared folder and read back, so that the plan stays short."""
    now = now.withColumn("_changed", F.lit(True))
    while True:
        for _ in range(ROUNDS):
            now = step(now)
        now = written(now, "loop")
        if not now.filter("_changed").head(1):
            return now.drop("_changed")


def _sent_if_small(rows: DataFrame, name: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """rows as a written table, and what sends parts of it to all tasks if it has at most SENT_ROWS rows, or leaves them as they are."""
    rows = written(rows, name)
    return rows, F.broadcast if rows.count() <= SENT_ROWS else lambda part: part


def _settled(moved: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The least value of each key, and whether a move made or lowered it. moved has _stays beside keys and value."""
    low = F.min(value)
    stayed = F.min(F.when(F.col("_stays"), F.col(value)))
    return moved.groupBy(*keys).agg(low.alias(value), (stayed.isNull() | (low < stayed)).alias("_changed"))


def closure(parents: DataFrame, max_depth: int | None = None, child: str = "child", parent: str = "parent") -> DataFrame:
    """node, ancestor, depth (least): each class with itself (0) and all its superclasses, or those up to max_depth; cycles end by the least depth."""
    edges = parents.select(F.col(child).alias("_c"), F.col(parent).alias("_p")).distinct()
    nodes = edges.select(F.col("_c").alias("node")).union(edges.select("_p")).distinct()
    now = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    if max_depth is None:
        edges = written(edges, "edges")
        stay = F.struct("ancestor", "depth", F.lit(True).alias("_stays"))
        go = F.struct(F.col("_p").alias("ancestor"), (F.col("depth") + 1).alias("depth"), F.lit(False).alias("_stays"))

        def step(now):
            moved = now.join(edges, (now.ancestor == edges["_c"]) & F.col("_changed"), "left").select("node", F.explode(F.array(stay, go)).alias("_m")).select("node", "_m.*")
            return _settled(moved.filter("ancestor is not null"), ["node", "ancestor"], "depth")

        return _until_same(now, step)
    out = now
    for d in range(1, max_depth + 1):
        now = now.join(edges, now.ancestor == edges["_c"]).select("node", F.col("_p").alias("ancestor"), F.lit(d).alias("depth")).distinct()
        out = out.union(now)
    return out.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))


def chains(closed: DataFrame) -> DataFrame:
    """node, chain: ancestors by depth, then by name."""
    return closed.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))), lambda x: x["ancestor"]).alias("chain"))


def leaves(parents: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """node: classes that are no class's parent."""
    return parents.select(F.col(child).alias("node")).distinct().join(parents.select(F.col(parent).alias("node")).distinct(), "node", "left_anti")


def side(name: Column, categorizes: Column) -> Column:
    """jd for what categorizes, or is named as a type or role; else cv."""
    return F.when(categorizes | name.rlike("(Type|Role)$"), "jd").otherwise("cv")


def relation_bucket(domain_side: Column, range_side: Column) -> Column:
    return F.when(domain_side != range_side, "cross_side").when(domain_side == "jd", "intra_jd").otherwise("intra_cv")


def fixed_edges(edges: DataFrame, types: DataFrame, relations: DataFrame, closed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Edges whose ends fit their relation's (domain, range), turned round if only that fits; others go. isA and unknown relations stay.

    types: doc, node, type (of several types of a node the least counts); relations: label, domain, range (all rows of a label count); closed:
    closure() of the types. Nodes and edges meet by document, in one shuffle each.
    """
    listed = types.groupBy(doc).agg(F.array_sort(F.collect_set(F.struct("node", "type"))).alias("_all"))
    first = F.filter("_all", lambda x, i: (i == 0) | (x["node"] != F.get("_all", i - 1)["node"]))
    t = listed.select(doc, F.map_from_entries(first).alias("_types"))  # both ends are looked up in their document
    kind = lambda end: F.try_element_at("_types", F.col(end))
    rows = edges.join(t, doc, "left").select(*edges.columns, kind("source").alias("_s"), kind("target").alias("_t"))
    up = lambda name: closed.select(F.col("node").alias(name), F.col("ancestor"))
    allowed = relations.join(up("_s").withColumnRenamed("ancestor", "domain"), "domain").join(up("_t").withColumnRenamed("ancestor", "range"), "range").select(F.col("label").alias("relation"), "_s", "_t").distinct()
    yes, no = F.lit(True), F.lit(None).cast("boolean")
    fits = allowed.select("relation", "_s", "_t", yes.alias("_fits"), no.alias("_turned"))
    turned = allowed.select("relation", F.col("_t").alias("_s"), F.col("_s").alias("_t"), no.alias("_fits"), yes.alias("_turned"))
    named = relations.select(F.col("label").alias("relation"), *(F.lit(None).cast("string").alias(c) for c in ("_s", "_t")), no.alias("_fits"), no.alias("_turned"))
    ways = fits.unionByName(turned).unionByName(named).groupBy("relation", "_s", "_t").agg(F.max("_fits").alias("_fits"), F.max("_turned").alias("_turned"))
    ways, sent = _sent_if_small(ways, "ways")
    known = sent(ways.filter("_s is null and _fits is null and _turned is null").select("relation", yes.alias("_known")))
    rows = rows.join(known, "relation", "left").join(sent(ways.filter("_fits or _turned")), ["relation", "_s", "_t"], "left")
    free = F.col("_known").isNull() | (F.col("relation") == "isA")
    flip = ~free & F.col("_fits").isNull()
    rows = rows.filter(free | F.col("_fits").isNotNull() | F.col("_turned").isNotNull())
    return rows.select(doc, F.when(flip, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(flip, F.col("source")).otherwise(F.col("target")).alias("target"), "relation").distinct()


def matching_pair(left: DataFrame, right: DataFrame, closed: DataFrame, pairs: DataFrame) -> DataFrame:
    """left_type, right_type, ord, pair: the first allowed pair (ord, jd_type, cv_type) that superclasses of both make up."""
    up = closed.select("node", "ancestor")
    l = left.distinct().join(up.withColumnsRenamed({"node": "left_type", "ancestor": "jd_type"}), "left_type")  # noqa: E741
    r = right.distinct().join(up.withColumnsRenamed({"node": "right_type", "ancestor": "cv_type"}), "right_type")
    return pairs.join(l, "jd_type").join(r, "cv_type").groupBy("left_type", "right_type").agg(F.min("ord").alias("ord"), F.min_by(F.struct("jd_type", "cv_type"), "ord").alias("pair"))


def shadows(wanted: DataFrame, doc: str = "doc_id", node: str = "node", target: str = "type") -> tuple[DataFrame, DataFrame]:
    """(shadow nodes, isA edges) for (doc, node, superclass), each once."""
    rows = wanted.select(doc, node, target).distinct().withColumn("shadow", F.concat(F.col(node).cast("string"), F.lit("__"), F.col(target)))
    return rows.select(doc, F.col("shadow").alias(node), target), rows.select(doc, F.col(node).cast("string").alias("source"), F.col("shadow").alias("target"), F.lit("isA").alias("relation"))


def numbered_nodes(nodes: DataFrame, doc: str, kind: str, order: str, prefix: str = "n") -> DataFrame:
    """nodes with node_id = prefix, type and a number counted within document and type."""
    i = F.row_number().over(Window.partitionBy(doc, kind).orderBy(order))
    return nodes.withColumn("node_id", F.concat_ws("_", F.lit(prefix), F.col(kind).cast("string"), i.cast("string")))


def _tasks(written_rows: DataFrame) -> int:
    """Parts for a written table: their number grows with its rows, so that the memory of a task does not."""
    return max(written_rows.sparkSession.sparkContext.defaultParallelism, math.ceil(written_rows.count() / SEARCH_ROWS))


def undirected(edges: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Each edge in both directions, once; edges that are partitioned by document stay where they are."""
    end = lambda a, b: F.struct(F.col(a).alias("source"), F.col(b).alias("target"))
    return edges.select(doc, "cost", F.explode(F.array(end("source", "target"), end("target", "source"))).alias("_e")).select(doc, "_e.*", "cost").distinct()


@contextmanager
def _served_by(spark: SparkSession):
    """Joins on (document, node) are served by a partitioning by document; for plans that run inside."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def reach(starts: DataFrame, edges: DataFrame, max_rounds: int | None = None, doc: str = "doc_id", anchors: DataFrame | None = None) -> DataFrame:
    """doc, node, dist, edges, pred for each node that can be reached from a start (which has pred null): the least cost (isA edges cost 0, others
    1), by the fewest edges of those, and of the nodes before it the least. Over at most max_rounds edges, where stated; anchors are not passed.

    No path leaves a document: edges and state are partitioned by document once a pass of HOP_ROUNDS rounds, and joins and minima within it
    need no shuffle of their own. A pass ends in a written table, and the search when nothing was lowered."""
    spark = starts.sparkSession
    both = undirected(edges, doc)
    if anchors is not None:
        both = both.join(anchors.select(doc, F.col("node").alias("source")), [doc, "source"], "left_anti").join(anchors.select(doc, F.col("node").alias("target")), [doc, "target"], "left_anti")
    with _served_by(spark):
        both = written(both.select(F.col(doc).alias("_d"), F.col("source").alias("_n"), "target", "cost"), "edges")
        tasks = _tasks(both)
        none = F.lit(None).cast(dict(both.dtypes)["_n"])
        first = F.struct(F.lit(0).alias("dist"), F.lit(0).alias("edges"), none.alias("pred"))
        now = starts.select(doc, "node").distinct().select(doc, "node", first.alias("best"), F.lit(True).alias("_changed"))
        stay = F.struct("node", "best", F.lit(True).alias("_stays"))
        further = F.struct((F.col("best.dist") + F.col("cost")).alias("dist"), (F.col("best.edges") + 1).alias("edges"), F.col("node").alias("pred"))
        go = F.struct(F.col("target").alias("node"), further.alias("best"), F.lit(False).alias("_stays"))
        left = max_rounds
        while left is None or left > 0:
            rounds = HOP_ROUNDS if left is None else min(left, HOP_ROUNDS)
            now, dealt = now.repartition(tasks, F.col(doc)), both.repartition(tasks, F.col("_d"))
            for _ in range(rounds):
                # each round uses the last one once, so the plan grows by one join a round
                moved = now.join(dealt, (F.col(doc) == F.col("_d")) & (F.col("node") == F.col("_n")) & F.col("_changed"), "left").select(doc, F.explode(F.array(stay, go)).alias("_m")).select(doc, "_m.*")
                now = _settled(moved.filter("node is not null"), [doc, "node"], "best")
            now = written(now, "reached")
            left = None if left is None else left - rounds
            if not now.filter("_changed").head(1):
                break
    return now.select(doc, "node", "best.*")


def hops(starts: DataFrame, edges: DataFrame, max_rounds: int | None = None, doc: str = "doc_id", anchors: DataFrame | None = None) -> DataFrame:
    """doc, node, dist: least cost (isA edges cost 0, others 1) from any start, or over at most max_rounds edges; anchors are not passed."""
    return reach(starts, edges, max_rounds, doc, anchors).select(doc, "node", "dist")


def with_paths(reached: DataFrame, doc: str = "doc_id") -> DataFrame:
    """reach() with path: the nodes from the start on, the node itself last. A round puts the part that was known of the node where a path's part begins
    before it; a pass of rounds shuffles both once, by document, and makes the known parts that many times as long."""
    most = reached.agg(F.max("edges")).first()[0] or 0  # one number
    now = written(reached.withColumns({"_at": F.col("pred"), "path": F.array("node")}), "paths")
    known, tasks = 1, _tasks(now)
    grown = F.when(F.col("_n").isNull(), F.col("path")).otherwise(F.concat("_more", "path"))
    with _served_by(reached.sparkSession):
        while known <= most:
            rounds = min(HOP_ROUNDS, most // known)
            before = now.select(F.col(doc).alias("_d"), F.col("node").alias("_n"), F.col("_at").alias("_before"), F.col("path").alias("_more")).repartition(tasks, "_d")
            now = now.repartition(tasks, doc)
            for _ in range(rounds):
                joined = now.join(before, (F.col(doc) == F.col("_d")) & (F.col("_at") == F.col("_n")), "left")
                now = joined.select(*reached.columns, F.col("_before").alias("_at"), grown.alias("path"))
            now = written(now, "paths")
            known *= rounds + 1
    return now.drop("_at")


def detail(nodes: DataFrame, found: DataFrame, discount: float = 0.5, doc: str = "doc_id") -> DataFrame:
    """doc, node and detail (label, importance, weight, hop_distance, path, node_score) of each node. nodes: doc, node, label, importance, w, matched;
    found: with_paths(). A matched node has hop distance 1; one that is not reached has none, an empty path and the score 0."""
    rows = nodes.join(found.select(doc, "node", "dist", "path"), [doc, "node"], "left")
    far = F.when(F.col("matched"), F.lit(1)).otherwise(F.col("dist") + 1)
    path = F.when(F.col("matched"), F.array("node")).otherwise(F.coalesce("path", F.filter(F.array("node"), lambda _: F.lit(False))))
    parts = {"label": F.coalesce("label", F.col("node").cast("string")), "importance": F.coalesce("importance", F.lit("important")), "weight": F.col("w"), "hop_distance": far, "path": path, "node_score": F.round(node_score(F.col("matched"), F.col("dist"), discount), 4)}
    return rows.select(doc, "node", F.struct(*(c.alias(k) for k, c in parts.items())).alias("detail"))


def detail_maps(details: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, detail: a map from node to its detail."""
    return details.groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", "detail")))).alias("detail"))


def explained(wanted: DataFrame, matches: DataFrame, by: list[str], title: str) -> DataFrame:
    """by, explanation: a report of each pair of documents. wanted: by, node, type, label, importance, w of the query's nodes; matches: by, node, and other,
    other_type, other_label, conf of the candidate's nodes that meet them. Nodes stand by id, matches by falling confidence, then by id."""
    number = lambda c: F.format_string("%.2f", c)
    match = F.struct((-F.col("conf")).alias("back"), "other", F.coalesce("other_type", F.lit("")).alias("type"), F.coalesce("other_label", F.col("other").cast("string")).alias("label"), "conf")
    met = matches.groupBy(*by, "node").agg(F.array_sort(F.collect_list(match)).alias("met"))
    rows = wanted.join(met, [*by, "node"], "left")
    head = F.concat(F.lit("["), F.coalesce("type", F.lit("")), F.lit("] ["), F.coalesce("importance", F.lit("important")), F.lit("] "), F.coalesce("label", F.col("node").cast("string")), F.lit("  \u2192  "))
    below = F.array_join(F.transform("met", lambda m: F.concat(F.lit("\n    ["), m["type"], F.lit("] "), m["label"], F.lit("  (conf="), number(m["conf"]), F.lit(")"))), "")
    hit = F.concat(F.lit("\n\u2713 "), head, F.lit("+"), number(F.col("w") * F.col("met")[0]["conf"]), below)
    line = F.coalesce(hit, F.concat(F.lit("\n\u2717 "), head, F.lit("-"), number(F.col("w")), F.lit("  (no match)")))
    grouped = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("node", line.alias("line")))).alias("lines"), F.count("met").alias("n"), F.count("*").alias("all"))
    text = F.concat_ws("\n", F.lit(title), F.lit("=" * 60), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.format_string("\nSummary: %d matched, %d unmatched out of %d JD nodes", F.col("n"), F.col("all") - F.col("n"), F.col("all")))
    return grouped.select(*by, text.alias("explanation"))


def node_score(matched: Column, dist: Column, discount: float = 0.5) -> Column:
    return F.when(matched, F.lit(1.0)).when(dist.isNotNull(), F.pow(F.lit(discount), dist)).otherwise(F.lit(0.0))


def ablated_score(matched: Column, dist: Column) -> Column:
    """A node's score without relations: 1 where its hop distance is 1, so for matched nodes and those reached over isA edges alone."""
    return F.when(matched | (F.coalesce(dist, F.lit(-1)) == 0), F.lit(1.0)).otherwise(F.lit(0.0))


def graph_score(nodes: DataFrame, by: list[str], weight: str = "w", score: str = "node_score") -> DataFrame:
    """by, score: weights times (2 * node score - 1), moved to 1 ... 10; 5.5 without weight."""
    w = F.col(weight)
    return nodes.groupBy(*by).agg(on_scale(F.sum(w * (2 * F.col(score) - 1)), F.sum(w)).alias("score"))


def relative_gain(full: Column, ablated: Column) -> Column:
    """Percent by which full exceeds ablated."""
    return F.when(ablated != 0, 100 * (full - ablated) / F.abs(ablated))


def first_matches(wanted: DataFrame, nodes: DataFrame, on: list[str], condition: Column, order: str, keep: list[str]) -> DataFrame:
    """keep, first: the first node by order that fits; null if none does. wanted and nodes meet only within on."""
    rows = wanted.join(nodes, on).filter(condition).groupBy(*keep).agg(F.min(order).alias("first"))
    return wanted.select(*keep).distinct().join(rows, keep, "left")


__all__ = ["DEGENERATE", "ablated_score", "chains", "closure", "detail", "detail_maps", "explained", "first_matches", "fixed_edges", "graph_score", "hops", "leaves", "matching_pair", "node_score", "numbered_nodes", "reach", "relation_bucket", "relative_gain", "shadows", "side", "undirected", "with_paths"]
