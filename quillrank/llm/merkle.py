"""Merkle manifest of a dataset: a tree for each group of rows, a tree over their roots, and proofs by looking up coordinates.

A leaf is the digest of a row's fields, each `-` if null, else its UTF-8 byte count, a colon and its value. In a group the leaves stand by
key; every `size` consecutive nodes (fewer at the end, even one) become their digest, level by level, until one is left: the group's root.
The group roots, in the order of the groups (null first, then bytewise), make a tree of the same kind, whose last node is the root.

Indices come from a range sort: each range numbers its own rows, and offsets are prefix sums over one row for each group and range. A tree
is raised in tiers of `height` levels. A block of at most BLOCK nodes that share an ancestor `height` levels up is folded in its own row, so a
group that holds most of the rows is many blocks, and a tier is one shuffle of digests. All nodes of a tier are written as a table.

For a proof each leaf explodes the coordinates (level, position) of the siblings that it needs, from its index, the number of nodes and
the size of a run; they are joined with the node table, put in order by leaf, and folded. Leaves ask for the siblings of their own tier
only; the path above a block is that of the block's node in the next tier, found once and joined by block. So a node is asked for by less
than BLOCK leaves, however large the tree is: there is no hot node near the root.

Null fields count as stated; rows without a key come first. Rows that share a key stand by their digests, and repeated rows are leaves of
their own. A row alone in its group is the group's root. An empty table has no rows and no root. Texts of any length are digested whole.
Columns that aren't among the fields are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK = 1024
_IN_PART = (1 << 33) - 1


def encoded(value: Column) -> Column:
    """`-`, or the byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(encoded, values.values())), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _placed(rows: DataFrame, order: list[str], name: str, group: str | None = None) -> DataFrame:
    """rows with g (the number of its group), i (its index there, by order) and n (the group's rows)."""
    key = [group] if group else []
    by = [*key, *order, "salt"]  # equal rows are dealt out too
    ranged = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("salt")
    at = written(ranged.withColumn("at", F.monotonically_increasing_id()), name)
    at = at.withColumns({"part": F.shiftright("at", 33), "pos": F.col("at").bitwiseAND(F.lit(_IN_PART))}).drop("at")
    cells = written(at.groupBy(*key, "part").agg(F.count("*").alias("m"), F.min("pos").alias("first")), f"{name}-cells")
    whole = Window.partitionBy(*key)  # one row for each range
    earlier = F.sum("m").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(*key, "part", (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias("shift"), F.sum("m").over(whole).alias("n"))
    if not group:
        return at.join(cells, "part").select(*rows.columns, F.lit(0).cast("long").alias("g"), (F.col("pos") + F.col("shift")).alias("i"), "n")
    groups = _placed(cells.groupBy(group).agg(F.max("n").alias("n_rows")), [group], f"{name}-groups")
    groups = groups.select(F.col(group).alias("group"), F.col("i").alias("g"))
    cells = written(cells.join(groups, cells[group].eqNullSafe(groups["group"])).select("group", F.col("part").alias("in"), "shift", "n", "g"), f"{name}-cells")
    joined = at.join(cells, (at["part"] == cells["in"]) & at[group].eqNullSafe(cells["group"]))
    return joined.select(*rows.columns, "g", (F.col("pos") + F.col("shift")).alias("i"), "n")


@dataclass
class Tree:
    """tiers: for each, its nodes (g, i, h, n) and the table of the levels from it on (g, level, p, h, n, top); the last tier has nodes alone, one for
    each group. A group that is down to one node is found in the tier where that happens."""

    tiers: list[tuple[DataFrame, DataFrame | None]]
    size: int
    height: int

    def roots(self) -> DataFrame:
        found = [nodes.filter("n = 1").select("g", "h") for nodes, _ in self.tiers]
        for more in found[1:]:
            found[0] = found[0].unionByName(more)
        return found[0]


def _over(x: Column, by: int) -> Column:
    """x by a whole number, rounded down."""
    return F.floor(x / F.lit(by)).cast("long")


def _levels(n: Column, size: int, height: int) -> Column:
    """Levels from n nodes up to one, at most height."""
    out = F.when(n <= 1, 0)
    for j in range(1, height):
        out = out.when(n <= size**j, j)
    return out.otherwise(height)


def _folded(nodes: DataFrame, size: int, height: int) -> DataFrame:
    """g, level, p, h, n, top: all nodes of the blocks, from level 0 of the tier to their tops."""
    block = _over(F.col("i"), size**height)
    rows = nodes.filter("n > 1").groupBy("g", "n", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("own"))
    rows = rows.select("g", "n", "block", _levels(F.col("n"), size, height).alias("levels"), F.transform("own", lambda x: hexed(x["h"])).alias("a0"))

    def parents(of: str) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(of) - 1) / size).cast("int"))
        return F.transform(runs, lambda x: F.sha2(F.array_join(F.slice(of, x * size + 1, size), ""), 256))

    def entries(j: int) -> Column:
        found = F.transform(f"a{j}", lambda h, x: F.struct(F.lit(j).alias("level"), (F.col("block") * size ** (height - j) + x).alias("p"), F.unhex(h).alias("h")))
        return F.coalesce(found, F.array().cast("array<struct<level:int,p:bigint,h:binary>>"))

    for j in range(height):
        rows = rows.withColumn(f"a{j + 1}", F.when(F.col("levels") > j, parents(f"a{j}")))
    every = F.concat(*map(entries, range(height + 1)))
    return rows.select("g", "n", "levels", F.explode(every).alias("x")).select("g", "x.level", "x.p", "x.h", "n", (F.col("x.level") == F.col("levels")).alias("top"))


def raised(nodes: DataFrame, size: int, name: str) -> Tree:
    """The tree over nodes (g, i, h, n and others), tier by tier."""
    height = max(1, next(j for j in range(1, 64) if size ** (j + 1) > BLOCK))
    tiers, most = [], nodes.agg(F.max("n")).first()[0] or 0  # one number
    while most > 1:
        table = written(_folded(nodes, size, height), f"{name}-nodes")
        tiers.append((nodes, table))
        nodes = table.filter("top").select("g", F.col("p").alias("i"), "h", F.ceil(F.col("n") / F.lit(size**height)).cast("long").alias("n"))
        most = -(-most // size**height)
    return Tree([*tiers, (nodes, None)], size, height)


def _coordinates(size: int, height: int, own: Column) -> Column:
    """The siblings that node i of n needs in its tier, and first an entry that carries the node itself."""
    levels = _levels(F.col("n"), size, height)

    def siblings(j: int) -> Column:
        at, count = _over(F.col("i"), size**j), F.ceil(F.col("n") / F.lit(size**j)).cast("long")
        run = F.filter(F.array(*(_over(at, size) * size + r for r in range(size))), lambda p: (p != at) & (p < count))
        found = F.transform(run, lambda p: F.struct(F.lit(j).alias("level"), p.alias("p"), (p < at).alias("left"), F.when(F.lit(False), own).alias("own")))
        return F.coalesce(F.when(levels > j, found), F.filter(found, lambda p: F.lit(False)))

    itself = F.struct(F.lit(-1).alias("level"), F.col("i").alias("p"), F.lit(False).alias("left"), own.alias("own"))
    return F.concat(F.array(itself), *map(siblings, range(height)))


def _steps(nodes: DataFrame, table: DataFrame, size: int, height: int, extra: list[str]) -> DataFrame:
    """g, i, n, the extra columns and steps: for each level of the tier, the digests to the left and to the right."""
    asked = nodes.filter("n > 1").select("g", "i", F.explode(_coordinates(size, height, F.struct("n", *extra))).alias("x")).select("g", "i", "x.*")
    stored = table.filter("not top").select("g", "level", "p", "h")
    found = asked.join(stored, ["g", "level", "p"], "left").groupBy("g", "i")
    found = found.agg(F.max_by("own", F.col("own").isNotNull()).alias("own"), F.array_sort(F.collect_list(F.when(F.col("h").isNotNull(), F.struct("level", "p", "left", "h")))).alias("found"))
    side = lambda j, left: F.aggregate(F.filter("found", lambda x: (x["level"] == j) & (x["left"] == left)), F.lit(b""), lambda a, x: F.concat(a, x["h"]))
    steps = F.transform(F.sequence(F.lit(0), _levels(F.col("own.n"), size, height) - 1), lambda j: F.struct(side(j, True).alias("l"), side(j, False).alias("r")))
    return found.select("g", "i", "own.*", steps.alias("steps"))


def paths(tree: Tree, tops: DataFrame, extra: list[str], name: str) -> DataFrame:
    """g, i, the extra columns of the lowest nodes, path (left and right digests from the node up), and the other columns of tops, which
    has g and the path above each group's root."""
    above, rest = None, [c for c in tops.columns if c not in ("g", "path")]
    for t in range(len(tree.tiers) - 1, -1, -1):
        nodes, table = tree.tiers[t]
        own = extra if t == 0 else []
        here = nodes.filter("n = 1").join(tops, "g").select("g", "i", *own, "path", *rest)
        if table is not None:
            steps = _steps(nodes, table, tree.size, tree.height, own).withColumn("block", _over(F.col("i"), tree.size**tree.height))
            parents = above.withColumnsRenamed({"i": "block", "path": "more"})
            here = here.unionByName(steps.join(parents, ["g", "block"]).select("g", "i", *own, F.concat("steps", "more").alias("path"), *rest))
        above = here if t == 0 else written(here, f"{name}-paths")
    return above


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's hexadecimal digest and its path give."""
    return F.aggregate(path, start, lambda a, s: F.sha2(F.concat(hexed(s["l"]), a, hexed(s["r"])), 256))


@dataclass
class Manifest:
    """leaves: key, leaf, changed, g, i, n; groups: the group's value, g, i, h (its root) and n (groups); both with their trees."""

    leaves: DataFrame
    rows: Tree
    groups: Tree

    def root(self) -> DataFrame:
        """One row, h; none for an empty table."""
        return self.groups.roots().select("h")

    def nodes(self) -> DataFrame:
        """All stored nodes: tree (rows or groups), g, level, p, h."""
        found = [
            table.filter("not top").select(F.lit(kind).alias("tree"), "g", (F.col("level") + t * tree.height).alias("level"), "p", "h")
            for kind, tree in (("rows", self.rows), ("groups", self.groups))
            for t, (_, table) in enumerate(tree.tiers)
            if table is not None
        ]
        tops = [tree.roots().select(F.lit(f"{kind}-root").alias("tree"), "g", F.lit(None).cast("int").alias("level"), F.lit(0).cast("long").alias("p"), "h") for kind, tree in (("rows", self.rows), ("groups", self.groups))]
        out = tops[0].unionByName(tops[1])
        for f in found:
            out = out.unionByName(f)
        return out

    def save(self, path: str) -> None:
        """The manifest as tables: leaves, and all nodes."""
        self.leaves.select("key", F.col("h").alias("leaf"), "g", "i").write.mode("overwrite").parquet(f"{path}/leaves")
        self.nodes().write.mode("overwrite").partitionBy("tree").parquet(f"{path}/nodes")

    def proofs(self) -> DataFrame:
        """key, leaf, changed, subroot, root and path for each leaf."""
        top = self.groups.roots().select("g", F.array().cast("array<struct<l:binary,r:binary>>").alias("path"), F.col("h").alias("root"))
        of_groups = paths(self.groups, top, ["h"], "merkle-groups").select(F.col("i").alias("g"), "path", "root", F.col("h").alias("subroot"))
        return paths(self.rows, written(of_groups, "merkle-tops"), ["key", "h", "changed"], "merkle-rows").select("key", F.col("h").alias("leaf"), "changed", "subroot", "root", "path")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", size: int = 2, changed: dict[str, Column] | None = None) -> Manifest:
    """The tree of each value of group over the leaves of docs, by key, and the tree over them. size: nodes of a run, at least 2. changed: what
    became of some fields since; a row's `changed` digest is taken with these, and is null where they are as they were."""
    if size < 2:
        raise ValueError("a run has at least two nodes")
    values = {f: F.col(f) for f in fields}
    later = leaf(**{**values, **changed}) if changed else F.lit(None).cast("binary")
    differs = F.lit(False)
    for f, c in (changed or {}).items():
        differs = differs | ~c.eqNullSafe(F.col(f))
    rows = docs.select(F.col(group).cast("string").alias("group_of"), F.col(key).alias("key"), leaf(**values).alias("h"), F.when(differs, later).alias("changed"))
    leaves = written(_placed(written(rows, "merkle-leaves"), ["key", "h"], "merkle-order", "group_of"), "merkle-placed")
    tree = raised(leaves, size, "merkle-rows")
    tops = tree.roots()
    n = tops.count()
    groups = written(tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), "h", F.lit(n).cast("long").alias("n")), "merkle-subroots")
    return Manifest(leaves, tree, raised(groups, size, "merkle-groups"))


def verified(docs: DataFrame, changed: dict[str, Column] | None = None, size: int = 2) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: whether each row, as it is now, still folds to the root."""
    found = manifest(docs, size=size, changed=changed).proofs()
    proof = F.array_join(F.transform("path", lambda s: F.concat(hexed(s["l"]), hexed(s["r"]))), "")
    out = found.select(F.col("key").alias("doc_id"), hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), F.sha2(proof, 256).alias("proof_sha256"), folded(hexed(F.coalesce("changed", "leaf")), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
