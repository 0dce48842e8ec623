"""Merkle manifest of a table: one digest per row, a tree per group, a tree over the groups, and proofs.

A node is (grp, idx, n, digest): the idx-th of the n nodes of its level in its group.  At every level the nodes at slot
zero of a run compute the indices of their siblings, meet them in an equijoin of the level with itself, and emit the
parent.  Keys of these joins are unique, so a group that holds most rows is spread like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.functions.text import quote
from limpid.llm.common import ranked, stage

FANOUT = 16


def digest_of(columns: list[Column]) -> Column:
    """SHA-256 in lowercase hex of the values: `-` if null, else the UTF-8 bytes' number, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


@dataclass
class Tree:
    """Runs of every level (grp, run, n, digests, parent), and what remains of every group (grp, level, digest)."""

    fanout: int
    runs: list[DataFrame]
    roots: DataFrame

    def paths(self, tops: DataFrame) -> DataFrame:
        """(grp, idx, path, *columns of tops) of the lowest nodes of every group: path holds, level by level from the lowest, what
        stands left and right of the node's own digest in its run, then the path that `tops` (grp, path, ...) gives its
        root.  The lowest level is left to the caller: idx counts its runs, -1 stands for a group of one node."""
        extra = [c for c in tops.columns if c not in ("grp", "path")]
        ends = self.roots.join(tops.withColumnRenamed("grp", "__grp"), F.col("grp").eqNullSafe(F.col("__grp"))).drop("__grp", "digest")
        found = None
        for level in reversed(range(1, len(self.runs) + 1)):
            # The nodes of this level are the runs of the level below.
            finished = ends.where(F.col("level") == level).select("grp", F.lit(0).cast("long").alias("idx"), "path", *extra)
            nodes = finished
            if level < len(self.runs):
                above = found.withColumnRenamed("grp", "__grp")
                run = self.runs[level].drop("parent").join(above, F.col("grp").eqNullSafe(F.col("__grp")) & (F.col("run") == F.col("idx"))).drop("__grp", "idx")
                slots = run.withColumn("slot", F.explode(F.sequence(F.lit(0), F.size("digests") - 1)))
                nodes = finished.unionByName(slots.select(
                    "grp", (F.col("run") * self.fanout + F.col("slot")).alias("idx"), F.concat(F.array(around(F.col("digests"), F.col("slot"))), "path").alias("path"), *extra))
            found = nodes
        single = ends.where(F.col("level") == 0).select("grp", F.lit(-1).cast("long").alias("idx"), "path", *extra)
        return single if found is None else found.unionByName(single)


def around(digests: Column, slot: Column) -> Column:
    """The digests of a run to the left and to the right of a slot."""
    left = F.array_join(F.slice(digests, F.lit(1), slot.cast("int")), "")
    right = F.array_join(F.slice(digests, (slot + 2).cast("int"), F.size(digests)), "")
    return F.struct(left.alias("left"), right.alias("right"))


def build(nodes: DataFrame, fanout: int = FANOUT) -> Tree:
    """The trees of all groups at once, from their lowest nodes (grp, idx, n, digest)."""
    runs, level = [], 0
    roots = nodes.where("n = 1").select("grp", F.lit(0).alias("level"), "digest")
    left = nodes.agg(F.max("n")).first()[0] or 0
    while left > 1:
        runs.append(stage(_parents(nodes.where("n > 1"), fanout), f"merkle-{level}"))
        level, left = level + 1, -(-left // fanout)
        nodes = runs[-1].select("grp", F.col("run").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), F.col("parent").alias("digest"))
        roots = roots.unionByName(nodes.where("n = 1").select("grp", F.lit(level).alias("level"), "digest"))
    return Tree(fanout, runs, stage(roots, "merkle-roots"))


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """One row per run of a level, from the nodes at slot zero and the siblings they meet."""
    first = nodes.where(F.col("idx") % fanout == 0)
    last = F.least(F.col("idx") + fanout, F.col("n")) - 1
    # In a binary tree the one sibling's index differs in the last bit.
    siblings = F.array(F.col("idx").bitwiseXOR(F.lit(1).cast("long"))) if fanout == 2 else F.sequence(F.col("idx") + 1, last)
    alone = F.col("idx") == last
    probes = first.where(~alone).select(F.col("grp").alias("__grp"), F.col("idx").alias("head"), F.explode(siblings).alias("sibling"))
    met = probes.join(nodes, F.col("__grp").eqNullSafe(F.col("grp")) & (F.col("sibling") == F.col("idx"))).select("grp", "head", "idx", "n", "digest")
    own = first.select("grp", F.col("idx").alias("head"), "idx", "n", "digest")
    run = met.unionByName(own).groupBy("grp", "head").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("held"))
    digests = F.col("held.digest")
    return run.select("grp", (F.col("head") / fanout).cast("long").alias("run"), "n", digests.alias("digests"), F.sha2(F.array_join(digests, ""), 256).alias("parent"))


@dataclass
class Manifest:
    """`leaves` (id, grp, idx, n, leaf), the trees of the groups, their roots in order, the tree over those, the root."""

    leaves: DataFrame
    groups: Tree
    subroots: DataFrame
    top: Tree
    root: str


def manifest(df: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source", fanout: int = FANOUT) -> Manifest:
    """Commit to the rows of a table.

    A leaf is the digest of the named columns.  In a group, leaves ascend by id (null first, equal ids by leaf); runs of
    `fanout` become their parent until one is left, a lone leaf being its own subroot.  Subroots, ordered by group (null
    first, by UTF-8 bytes; null is a group of its own and not the empty text), give the root in the same way.  Repeated
    rows are leaves each.  An empty table has the SHA-256 of nothing as its root.  Other columns, whatever their names,
    are ignored."""
    _check(fanout)
    hashed = df.select(quote(id_col).alias("id"), quote(group_col).alias("grp"), digest_of([quote(c) for c in columns]).alias("leaf"))
    return manifest_of_leaves(stage(hashed, "merkle-hashed"), fanout)


def _check(fanout: int) -> None:
    if fanout < 2:
        raise ValueError("the fanout must be 2 or more")


def manifest_of_leaves(hashed: DataFrame, fanout: int = FANOUT) -> Manifest:
    """The same from the digests: a table (id, grp, leaf, ...) that is cheap to read twice.  Other columns stay."""
    leaves = stage(ranked(hashed, "grp", ["id", "leaf"]), "merkle-leaves")
    groups = build(leaves.select("grp", "idx", "n", F.col("leaf").alias("digest")), fanout)
    # One group of all subroots; a stored column keeps the joins on it equijoins.
    subroots = stage(ranked(groups.roots.select("grp", "digest", F.lit(0).alias("all")), "all", ["grp"]), "merkle-subroots")
    top = build(subroots.select(F.col("all").alias("grp"), "idx", "n", "digest"), fanout)
    root = top.roots.first()
    return Manifest(leaves, groups, subroots, top, root["digest"] if root else _nothing(hashed.sparkSession))


def _nothing(spark: SparkSession) -> str:
    return spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def proofs(m: Manifest) -> DataFrame:
    """`leaves` with subroot and path: what stands left and right of the own digest at every level up to the root, as
    array<struct<left, right>> of joined hex digests.  Folding it over a leaf (fold) gives the root."""
    ends = m.top.roots.select("grp", F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    tops = _lowest(m.subroots, m.top, ends, F.col("all")).select("grp", F.col("digest").alias("subroot"), "path")
    return _lowest(m.leaves, m.groups, tops, F.col("grp"))


def _lowest(nodes: DataFrame, tree: Tree, tops: DataFrame, group: Column) -> DataFrame:
    """Nodes of the lowest level with their paths: the run that holds them, then the path of its parent."""
    above = tree.paths(tops).select(F.col("grp").alias("__grp"), F.col("idx").alias("__run"), *[c for c in tops.columns if c != "grp"])
    if tree.runs:
        own = tree.runs[0].select(F.col("grp").alias("__g"), F.col("run").alias("__r"), "digests")
        above = above.join(own, F.col("__grp").eqNullSafe(F.col("__g")) & (F.col("__run") == F.col("__r")), "left").drop("__g", "__r")
    else:
        above = above.withColumn("digests", F.lit(None).cast("array<string>"))
    run = F.when(F.col("n") == 1, F.lit(-1)).otherwise(F.floor(F.col("idx") / tree.fanout)).cast("long")
    met = nodes.join(above, group.eqNullSafe(F.col("__grp")) & (run == F.col("__run")))
    path = F.when(F.col("digests").isNull(), F.col("path")).otherwise(F.concat(F.array(around(F.col("digests"), F.col("idx") % tree.fanout)), F.col("path")))
    return met.withColumn("path", path).drop("__grp", "__run", "digests")


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda own, p: F.sha2(F.concat(p["left"], own, p["right"]), 256))
