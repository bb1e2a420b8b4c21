"""Merkle manifest of a dataset: a tree for each group, and one over the groups' roots.

1. Leaves: each row's digest is computed where the row is read, so no text is
   shuffled. Digests are range-sorted by (group, key); a row's place in its
   group is its place in that order less the group's first one, so a group of
   any size spreads over all tasks.
2. Levels: a window by (group, parent) over the nodes' order collects each run
   of ``fanout`` digests over the full frame. The list is the parent's
   preimage and holds a node's siblings. One row a run is kept before the next
   level, so level k has rows / fanout^k of them. A run is the largest group
   that any task holds at once.
3. Proofs: from the root down, each run's nodes take their run's path and add
   their own siblings. The last join meets leaves by run, not by row, so paths
   move once per ``fanout`` leaves.

Every level is written to the shared folder: a lost executor costs a reread.

H is the lowercase hex SHA-256 of its inputs' concatenation; a field counts as
``-`` if null, else as its UTF-8 byte count, ``:`` and its value as a string.

Defined results: a null group is a group, first in order; a null key is first
in its group; equal keys stand by digest, and rows that are equal in all fields
are leaves of their own, alike; a group of one row has its leaf as root, and so
has a table of one group the group's root; without siblings a proof is H of
nothing; an empty table gives an empty result and no root; texts of any length
are digested whole; columns beside the named ones are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeweave.llm.common import materialize

FANOUT = 16
_PATH = "array<struct<left:string,right:string>>"


def leaf_digest(*fields: Column) -> Column:
    """H of the fields, each with its byte count."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts)), 256)


def parent_digest(run: Column) -> Column:
    return F.sha2(F.array_join(run, ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path of siblings give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """H of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


@dataclass(frozen=True)
class Tree:
    """leaves: key, group, tree, idx, n, leaf and what was carried; runs: (tree, parent, n, run) of each level; tops: (tree, n, subroot, path) of each group."""

    leaves: DataFrame
    runs: list[DataFrame]
    tops: DataFrame
    root: str | None
    fanout: int


def _placed(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Add ``place``, from 0, in the order of ``by`` over all rows (nulls first), and the task ``__part`` that sorted them."""
    keys = [F.col(c).asc_nulls_first() for c in by]
    keyed = rows.withColumn("__tie", F.monotonically_increasing_id())  # equal rows spread, too
    at = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    ordered = keyed.repartitionByRange(*keys, "__tie").sortWithinPartitions(*keys, "__tie").drop("__tie")
    parts = materialize(ordered.withColumns({"__part": F.spark_partition_id(), "__at": at}), name)
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task of the sort
    before = parts.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before"))
    return parts.join(before, "__part").withColumn("place", F.col("__before") + F.col("__at")).drop("__before", "__at")


def _nodes_at(n: Column, fanout: int, level: int) -> Column:
    """Nodes of a tree of ``n`` leaves at a level."""
    step = fanout**level
    return F.floor((n + (step - 1)) / step)


def _with_runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes with their parent's place and, as ``run``, all its children in order."""
    full = Window.partitionBy("tree", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumn("parent", F.floor(F.col("idx") / fanout)).withColumn("run", F.collect_list("digest").over(full))


def _levels(nodes: DataFrame, largest: int, fanout: int, name: str) -> list[DataFrame]:
    """The runs of each level of trees given as (tree, idx, n, digest); the largest has ``largest`` leaves."""
    out = []
    while largest > 1:
        level = len(out)
        # the first of a run stands for its parent, so each parent comes once
        runs = _with_runs(nodes.where(_nodes_at(F.col("n"), fanout, level) > 1), fanout).where(F.col("idx") % fanout == 0)
        out.append(materialize(runs.select("tree", "parent", "n", "run"), name))
        nodes = out[-1].select("tree", F.col("parent").alias("idx"), "n", parent_digest(F.col("run")).alias("digest"))
        largest = -(-largest // fanout)
    return out


def _roots(nodes: DataFrame, runs: list[DataFrame], fanout: int) -> DataFrame:
    """(tree, n, digest) of each tree's root: of its last run, or its only leaf."""
    out = nodes.where("n = 1").select("tree", "n", "digest")
    for level, r in enumerate(runs):
        last = r.where(_nodes_at(F.col("n"), fanout, level + 1) == 1)
        out = out.unionByName(last.select("tree", "n", parent_digest(F.col("run")).alias("digest")))
    return out


def _step(run: Column, at: Column) -> Column:
    """Siblings left and right of the place ``at`` (from 0) in a run."""
    left = F.array_join(F.slice(run, F.lit(1), at), "")
    right = F.array_join(F.slice(run, at + 2, F.size(run)), "")
    return F.struct(left.alias("left"), right.alias("right"))


def _descend(runs: list[DataFrame], tops: DataFrame, fanout: int, to: int) -> DataFrame:
    """(tree, idx, subroot, path) of each node at level ``to``: siblings from there up, then the path of its tree's root in ``tops``.

    Trees of fewer levels give their root.
    """
    enter = lambda level: tops.where(_nodes_at(F.col("n"), fanout, level) == 1)
    own = lambda df: df.select("tree", F.lit(0).cast("long").alias("idx"), "subroot", "path")
    found = None
    for level in reversed(range(to, len(runs))):
        fresh = own(enter(level + 1).where(_nodes_at(F.col("n"), fanout, level) > 1))
        above = fresh if found is None else found.unionByName(fresh)
        met = runs[level].select("tree", F.col("parent").alias("idx"), "run").join(above, ["tree", "idx"])
        child = met.select("tree", "idx", "subroot", "path", "run", F.posexplode("run").alias("__at", "__digest"))
        path = F.concat(F.array(_step(F.col("run"), F.col("__at"))), F.col("path"))
        found = child.select("tree", (F.col("idx") * fanout + F.col("__at")).alias("idx"), "subroot", path.alias("path"))
    rest = own(enter(to))
    return rest if found is None else found.unionByName(rest)


def build(docs: DataFrame, fields: Sequence[str], key: str = "doc_id", group: str = "source", fanout: int = FANOUT, carry: Mapping[str, Column] | None = None) -> Tree:
    """Digest every row, and build the groups' trees and the one over them.

    ``carry`` names further columns of ``docs`` that go with the leaves.
    """
    named = {name: f"__c{i}" for i, name in enumerate(carry or {})}
    digest = leaf_digest(*(F.col(f"`{c}`") for c in fields))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("group"), digest.alias("leaf"), *((carry or {})[n].alias(c) for n, c in named.items()))
    rows = _placed(materialize(rows, "merkle-rows"), ["group", "key", "leaf"], "merkle-order")
    # a group's share of each task's rows: a hot group is as many rows here as tasks
    spans = materialize(rows.groupBy("group", "__part").agg(F.min("place").alias("__first"), F.count("*").alias("__rows")), "merkle-spans")
    groups = materialize(_placed(spans.groupBy("group").agg(F.min("__first").alias("first"), F.sum("__rows").alias("n")), ["group"], "merkle-groups").withColumnRenamed("place", "tree").drop("__part"), "merkle-trees")
    g, s = groups.alias("g"), spans.alias("s")
    spans = s.join(g, F.col("s.group").eqNullSafe(F.col("g.group"))).select(F.col("s.group").alias("__group"), F.col("s.__part").alias("__p"), "tree", "first", "n")
    leaves = rows.join(spans, F.col("group").eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__p")))
    leaves = materialize(leaves.select("key", "group", "tree", (F.col("place") - F.col("first")).alias("idx"), "n", "leaf", *named.values()), "merkle-leaves")

    nodes = leaves.select("tree", "idx", "n", F.col("leaf").alias("digest"))
    most, count = groups.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    runs = _levels(nodes, most, fanout, "merkle-level")
    subroots = materialize(_roots(nodes, runs, fanout).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(count).alias("n"), "digest", F.col("n").alias("leaves")), "merkle-subroots")
    top = _levels(subroots, count, fanout, "merkle-top")
    root = _roots(subroots, top, fanout).select("digest").first()
    root = root and root[0]
    start = _roots(subroots, top, fanout).select("tree", "n", F.lit(None).cast("string").alias("subroot"), F.array().cast(_PATH).alias("path"))
    over = _descend(top, start, fanout, 0).select(F.col("idx").alias("__group_no"), "path")
    tops = subroots.join(over, F.col("idx") == F.col("__group_no")).select(F.col("idx").alias("tree"), F.col("leaves").alias("n"), F.col("digest").alias("subroot"), "path")
    back = {c: n for n, c in named.items()}
    leaves = leaves.select(*(F.col(c).alias(back[c]) if c in back else F.col(c) for c in leaves.columns))
    return Tree(leaves, runs, materialize(tops, "merkle-tops"), root, fanout)


def proofs(tree: Tree) -> DataFrame:
    """The leaves with ``subroot``, ``root`` and ``path``, the siblings left and right of each node up to the root."""
    runs = _with_runs(tree.leaves.withColumn("digest", F.col("leaf")), tree.fanout).drop("digest")
    above = _descend(tree.runs, tree.tops, tree.fanout, 1).withColumnRenamed("idx", "parent")
    own = F.array(_step(F.col("run"), (F.col("idx") % tree.fanout).cast("int")))
    path = F.when(F.col("n") > 1, F.concat(own, F.col("path"))).otherwise(F.col("path"))
    met = runs.join(above, ["tree", "parent"])
    return met.select(*tree.leaves.columns, "subroot", F.lit(tree.root).cast("string").alias("root"), path.alias("path"))
