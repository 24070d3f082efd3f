"""What was extracted from documents, against what they hold: relations and instances out of answers, matches of names, and counters.

Nodes are rows (doc_id, pos, node_id, type, label, source); relations (label, domain, range); closed is closure() of the types.
Documents meet their own rows alone, so nothing grows with the square of the table.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import completions as C
from .graph import matching_pair

ANSWER = "dep STRING, dest STRING, relation STRING"


def from_model(nodes: DataFrame) -> DataFrame:
    """Nodes that the model named: neither inferred nor anchors."""
    return nodes.filter(F.coalesce("source", F.lit("")) == "llm")


def answers(raw: DataFrame, doc: str = "doc_id", text: str = "raw") -> DataFrame:
    """doc, line, dep, dest (positions), relation: the readable lines of each answer; those without two positions are left out."""
    lines = raw.select(doc, F.posexplode(C.json_lines(F.col(text), ANSWER)).alias("line", "a"))
    return lines.select(doc, "line", C.entity_id(F.col("a.dep")).alias("dep"), C.entity_id(F.col("a.dest")).alias("dest"), F.coalesce("a.relation", F.lit("")).alias("relation")).na.drop(subset=["dep", "dest"])


def _end(rows: DataFrame, nodes: DataFrame, at: str, doc: str) -> DataFrame:
    n = nodes.select(F.col(doc), F.col("pos").alias(at), F.col("node_id").alias(f"{at}_id"), F.col("type").alias(f"{at}_type"))
    return rows.join(n, [doc, at])


def _raised(node_id: str, type_: str, wanted: str, lifted: Column) -> Column:
    """The node itself, or its shadow at the class wanted where that is a superclass of its type."""
    other = (F.col(wanted) != "") & (F.col(wanted) != F.col(type_)) & lifted
    return F.when(other, F.concat_ws("__", node_id, wanted)).otherwise(F.col(node_id))


def parsed_relations(raw: DataFrame, nodes: DataFrame, relations: DataFrame, closed: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(edges, isA edges) of answers: positions must be nodes of the document and labels known relations; the last row of a label gives its
    (domain, range). An end whose type lies below its relation's class is its shadow there, with an isA edge to it. Each edge once."""
    known = relations.groupBy("label").agg(F.max_by(F.struct("domain", "range"), F.struct("ord", "domain", "range")).alias("_dr")) if "ord" in relations.columns else relations.groupBy("label").agg(F.max(F.struct("domain", "range")).alias("_dr"))
    known = known.select(F.col("label").alias("relation"), F.coalesce("_dr.domain", F.lit("")).alias("domain"), F.coalesce("_dr.range", F.lit("")).alias("range"))
    rows = _end(_end(answers(raw, doc), nodes, "dep", doc), nodes, "dest", doc).join(known, "relation")
    above = closed.filter("depth > 0").select("node", "ancestor")
    rows = rows.join(above.select(F.col("node").alias("dep_type"), F.col("ancestor").alias("domain"), F.lit(True).alias("_up")), ["dep_type", "domain"], "left")
    rows = rows.join(above.select(F.col("node").alias("dest_type"), F.col("ancestor").alias("range"), F.lit(True).alias("_down")), ["dest_type", "range"], "left")
    up, down = F.col("_up").isNotNull(), F.col("_down").isNotNull()
    rows = rows.select(doc, "relation", "dep_id", "dest_id", _raised("dep_id", "dep_type", "domain", up).alias("source"), _raised("dest_id", "dest_type", "range", down).alias("target"))
    isa = rows.select(doc, F.explode(F.array(F.struct(F.col("dep_id").alias("source"), F.col("source").alias("target")), F.struct(F.col("dest_id").alias("source"), F.col("target").alias("target")))).alias("e"))
    isa = isa.select(doc, "e.*").filter("source <> target").withColumn("relation", F.lit("isA")).distinct()
    return rows.select(doc, "source", "target", "relation").distinct(), isa


def parsed_instances(raw: DataFrame, cv_nodes: DataFrame, jd_nodes: DataFrame, closed: DataFrame, pairs: DataFrame, anchor: str = "", doc: str = "doc_id") -> DataFrame:
    """doc, cv_id, jd_id, each once: dep must be a node of the CV side and dest, counted on from these, one of the other; anchors are passed
    over, and both types must lie below an allowed pair that is not the anchor's. Ends are raised to that pair's classes."""
    n_cv = cv_nodes.groupBy(doc).agg(F.count("*").alias("_n"))
    rows = answers(raw, doc).join(n_cv, doc).withColumn("dest", F.col("dest") - F.col("_n"))
    plain = lambda nodes: nodes.filter(F.coalesce("source", F.lit("")) != "anchor")
    rows = _end(_end(rows, plain(cv_nodes), "dep", doc), plain(jd_nodes), "dest", doc)
    found = matching_pair(jd_nodes.select(F.col("type").alias("left_type")), cv_nodes.select(F.col("type").alias("right_type")), closed, pairs)
    found = found.select(F.col("left_type").alias("dest_type"), F.col("right_type").alias("dep_type"), F.col("pair.jd_type").alias("jd_type"), F.col("pair.cv_type").alias("cv_type")).filter(F.col("jd_type") != anchor)
    rows = rows.join(found, ["dest_type", "dep_type"])
    return rows.select(doc, _raised("dep_id", "dep_type", "cv_type", F.lit(True)).alias("cv_id"), _raised("dest_id", "dest_type", "jd_type", F.lit(True)).alias("jd_id")).distinct()


def string_instances(cv_nodes: DataFrame, jd_nodes: DataFrame, allowed: DataFrame, on: list[str], similar: Column) -> DataFrame:
    """on, cv_id, jd_id: nodes whose types are an allowed pair (cv_type, jd_type) and whose labels are similar. similar names the columns
    of both sides; they meet within on and type pair, and only then by similarity."""
    left = cv_nodes.withColumnsRenamed({"node_id": "cv_id", "type": "cv_type"})
    right = jd_nodes.withColumnsRenamed({"node_id": "jd_id", "type": "jd_type"})
    return left.join(allowed.distinct(), "cv_type").join(right, [*on, "jd_type"]).filter(similar).select(*on, "cv_id", "jd_id").distinct()


def extraction_counters(items: DataFrame, nodes: DataFrame, same: Column, correct: Column, by: list[str], doc: str = "doc_id") -> DataFrame:
    """by, total, span_matched, type_matched, importance_matched: of items (doc, item, expected), those that a node names, the first by pos;
    of these, those of a correct type (correct names columns of both), and those of the expected importance."""
    first = items.join(nodes, doc).filter(same).groupBy(doc, "item").agg(F.min_by(F.struct(correct.alias("typed"), (F.col("importance") == F.col("expected")).alias("rated")), "pos").alias("best"))
    rows = items.select(doc, "item", *by).join(first, [doc, "item"], "left")
    typed, rated = F.count_if(F.coalesce("best.typed", F.lit(False))), F.count_if(F.coalesce("best.rated", F.lit(False)))
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.count("best").alias("span_matched"), typed.alias("type_matched"), rated.alias("importance_matched"))


def instance_recall(truth: DataFrame, cv_nodes: DataFrame, jd_nodes: DataFrame, instances: DataFrame, same_cv: Column, same_jd: Column, allowed: DataFrame, on: list[str]) -> DataFrame:
    """gt_total, span_both, type_compat, inst_found, inst_total, inst_correct of truth (on, code, name).

    A fact has spans where nodes of both sides are named as it is; it is type-compatible where a pair of them has allowed types, and found
    where a pair of them is an instance. An instance is correct if it is such a pair of any fact."""
    left = truth.join(cv_nodes.withColumnsRenamed({"node_id": "cv_id", "type": "cv_type"}), on).filter(same_cv).select(*on, "code", "cv_id", "cv_type")
    right = truth.join(jd_nodes.withColumnsRenamed({"node_id": "jd_id", "type": "jd_type"}), on).filter(same_jd).select(*on, "code", "jd_id", "jd_type")
    both = left.select(*on, "code").distinct().join(right.select(*on, "code").distinct(), [*on, "code"])
    types = left.select(*on, "code", "cv_type").distinct().join(allowed.distinct(), "cv_type").join(right.select(*on, "code", "jd_type").distinct(), [*on, "code", "jd_type"], "left_semi")
    hits = instances.join(left, [*on, "cv_id"]).join(right, [*on, "code", "jd_id"], "left_semi")
    counts = lambda df, name: df.agg(F.count("*").alias(name))
    out = counts(truth.select(*on, "code").distinct(), "gt_total")
    for df, name in ((both, "span_both"), (types.select(*on, "code").distinct(), "type_compat"), (hits.select(*on, "code").distinct(), "inst_found"), (instances, "inst_total"), (hits.select(*on, "cv_id", "jd_id").distinct(), "inst_correct")):
        out = out.crossJoin(counts(df, name))  # one row each
    return out


def matching(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples (s, p, o) with the given parts."""
    tests = [F.col(c) == v for c, v in (("s", s), ("p", p), ("o", o)) if v is not None]
    return triples.filter(reduce(lambda a, b: a & b, tests)) if tests else triples


def described_leaves(triples: DataFrame, namespace: str, is_class: str, below: str, comment: str) -> DataFrame:
    """node: classes of a namespace that have a comment and no class below them. The last three name the type object and two predicates."""
    classes = matching(triples, o=is_class).filter(F.col("s").startswith(namespace)).select(F.col("s").alias("node")).distinct()
    return classes.join(matching(triples, p=below).select(F.col("o").alias("node")), "node", "left_anti").join(matching(triples, p=comment).select(F.col("s").alias("node")), "node", "left_semi")


def described(triples: DataFrame, label: str, comment: str, most: int = 300) -> DataFrame:
    """node, label, comment: the least label, and the first line of the least comment, most characters at most."""
    of = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    rows = triples.filter(reduce(or_, (F.col("p") == p for p in (label, comment)))).groupBy(F.col("s").alias("node")).agg(of(label).alias("label"), of(comment).alias("comment"))
    return rows.withColumn("comment", F.substring(F.trim(F.split("comment", "\n")[0]), 1, most))


def definitions(schema: DataFrame, side: str, without: str = "") -> DataFrame:
    """label, comment of a side's rows that have a comment, without one label (the anchor's)."""
    return schema.filter((F.col("side") == side) & (F.coalesce("comment", F.lit("")) != "") & (F.col("label") != without)).select("label", "comment").distinct()


def enriched_comments(classes: DataFrame, wording: DataFrame) -> DataFrame:
    """classes (side, label, comment) with comments of their own for those in wording (label, lead, of): its lead, then the comments of the classes of the
    other side that of names (an array), by " / "; one that has none adds nothing."""
    comments = classes.filter("side = 'cv'").groupBy("label").agg(F.min("comment").alias("_c"))
    parts = wording.select("label", "lead", F.posexplode("of").alias("_at", "_of")).join(comments.withColumnRenamed("label", "_of"), "_of", "left")
    texts = parts.groupBy("label").agg(F.max("lead").alias("_lead"), F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_c", F.lit("")).alias("c")))), lambda x: x["c"]).alias("_parts"))
    made = texts.select("label", F.lit("jd").alias("side"), F.rtrim(F.concat_ws(" ", "_lead", F.array_join("_parts", " / "))).alias("_made"))
    return classes.join(made, ["label", "side"], "left").withColumn("comment", F.coalesce("_made", "comment")).select(*classes.columns)


def relation_definitions(relations: DataFrame, buckets: list[str]) -> DataFrame:
    """label, domain, range, comment of the relations of some buckets, one a label (the first by domain and range)."""
    rows = relations.filter(F.col("bucket").isin(*buckets))
    return rows.groupBy("label").agg(F.min(F.struct("domain", "range", F.coalesce("comment", F.lit("")).alias("comment"))).alias("_r")).select("label", "_r.*")


def definition_section(rows: DataFrame, by: list[str], label: str = "label", comment: str = "comment") -> DataFrame:
    """by, section: a line "label: comment" for each row, by label."""
    line = F.struct(label, F.concat_ws(": ", label, comment).alias("line"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_set(line)), lambda x: x["line"]), "\n").alias("section"))


def superclass_section(types: DataFrame, closed: DataFrame, by: list[str], kind: str = "type") -> DataFrame:
    """by, section: a line "type: nearest > next > ..." for each type of a document that has classes above it, by type. closed: closure() of the classes."""
    above = closed.filter("depth > 0").groupBy(F.col("node").alias(kind)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))), lambda x: x["ancestor"]), " > ").alias("_chain"))
    return definition_section(types.select(*by, kind).distinct().join(above, kind), by, kind, "_chain")


def anchor_first(nodes: Column, anchor: Column, key: str = "id") -> Column:
    """The array nodes with anchor as its first element, and nowhere else."""
    return F.concat(F.array(anchor), F.filter(nodes, lambda n: n[key] != anchor[key]))


def merged(old: Column, new: Column, key) -> Column:
    """old and those elements of new whose key none of old, nor an earlier one of new, has. key: a function of an element."""
    fresh = F.filter(new, lambda n, i: ~F.exists(old, lambda o: key(o) == key(n)) & ~F.exists(F.slice(new, F.lit(1), i), lambda o: key(o) == key(n)))
    return F.concat(old, fresh)
