"""Parent-child rows to full hierarchies.

Frontier joins start at the roots and extend root, depth and path level band by level band: round k
holds every node of depth below 2^k and joins it with the 2^k-step ancestor pairs of the others, which
yields exactly the nodes of depth 2^k to 2^(k+1)-1. Ancestor pairs double each round, so a chain of
depth d takes log2(d) rounds instead of d. Nodes that no frontier reaches sit on a cycle or run into
one; their ancestor pairs are doubled until they land on the cycle.

Defined cases: rows with a null in any child key column are no links; a null in a parent key column
leaves the child a root; repeated rows count once; a child with several parents keeps the smallest
one in byte order (``parent_conflicts`` reports the rest); a node that names itself is a cycle of one;
an empty table gives empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut


@dataclass(frozen=True)
class Hierarchy:
    """``trees``: node, root, depth (and path, root first). ``looped``: node, root (the smallest node of
    the cycle it reaches), on_cycle."""

    trees: DataFrame
    looped: DataFrame

    def roots(self) -> DataFrame:
        return self.trees.select("node", "root").unionByName(self.looped.select("node", "root"))


def _key(cols: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)])


def _links(edges: DataFrame, child: list[str], parent: list[str]) -> tuple[DataFrame, DataFrame]:
    present = lambda cols: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    pairs = edges.where(present(child)).select(
        _key(child).alias("node"), F.when(present(parent), _key(parent)).alias("parent")
    )
    lone = edges.where(~present(child) & present(parent)).select(_key(parent).alias("node"))
    return pairs, lone


def parent_conflicts(edges: DataFrame, child: list[str], parent: list[str]) -> DataFrame:
    """node, parents: children that name more than one parent."""
    pairs, _ = _links(edges, child, parent)
    named = pairs.where("parent is not null").distinct().groupBy("node").agg(F.count("*").alias("parents"))
    return named.where("parents > 1")


def resolve_hierarchy(edges: DataFrame, child: list[str], parent: list[str], with_paths: bool = False) -> Hierarchy:
    pairs, lone = _links(edges, child, parent)
    # min() combines before the shuffle, so a child repeated a million times is no hot key.
    parents = cut(pairs.groupBy("node").agg(F.min("parent").alias("anc")))
    linked = parents.where("anc is not null")
    starts = (
        linked.select(F.col("anc").alias("node"))
        .distinct()
        .join(linked.select("node"), "node", "left_anti")
        .union(parents.where("anc is null").select("node"))
        .union(lone.distinct().join(linked.select("node"), "node", "left_anti"))
        .distinct()
    )
    path = lambda c: [c.alias("path")] if with_paths else []
    reached = starts.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), *path(F.array("node")))
    reached = cut(reached)
    jumps = linked.select("node", "anc", *path(F.array("node")))
    step = 1
    while True:
        head = reached.select(
            F.col("node").alias("anc"), "root", F.col("depth").alias("above"), *([F.col("path").alias("front")] if with_paths else [])
        )
        band = cut(
            jumps.join(head, "anc").select(
                "node", "root", (F.col("above") + step).alias("depth"), *path(F.concat("front", "path")) if with_paths else ()
            )
        )
        if band.isEmpty():
            break
        reached = reached.unionByName(band)
        far = jumps.select(F.col("node").alias("anc"), F.col("anc").alias("next"), *([F.col("path").alias("front")] if with_paths else []))
        jumps = cut(jumps.join(far, "anc").select("node", F.col("next").alias("anc"), *path(F.concat("front", "path")) if with_paths else ()))
        step *= 2
    return Hierarchy(reached, _loops(jumps.select("node", "anc"), linked))


def _loops(jumps: DataFrame, linked: DataFrame) -> DataFrame:
    """Every node left after the tree rounds runs into a cycle: follow doubled ancestor pairs onto it."""
    n = jumps.count()
    if n == 0:
        return jumps.select("node", F.col("node").alias("root"), F.lit(True).alias("on_cycle"))
    landed, size = jumps, -1
    while True:
        # The image of the step map only shrinks; once it stops, the map permutes it: all on cycles.
        on = landed.select("anc").distinct()
        now = on.count()
        if now == size:
            break
        size = now
        far = landed.select(F.col("node").alias("anc"), F.col("anc").alias("next"))
        landed = cut(landed.join(far, "anc").select("node", F.col("next").alias("anc")))
    cycle = on.withColumnRenamed("anc", "node").join(linked, "node")
    cycle = cut(cycle.select("node", F.col("anc").alias("parent"), "anc", F.least("node", "anc").alias("root")))
    while True:
        ahead = cycle.select(F.col("node").alias("parent"), F.col("root").alias("other"))
        if cycle.join(ahead, "parent").where(F.col("root") != F.col("other")).isEmpty():
            break
        far = cycle.select(F.col("node").alias("anc"), F.col("anc").alias("next"), F.col("root").alias("other"))
        cycle = cut(cycle.join(far, "anc").select("node", "parent", F.col("next").alias("anc"), F.least("root", "other").alias("root")))
    labels = cycle.select(F.col("node").alias("anc"), "root")
    members = cycle.select("node", F.lit(True).alias("on_cycle"))
    return (
        landed.join(labels, "anc").join(members, "node", "left").select("node", "root", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))
    )


def descendants(hierarchy: Hierarchy) -> DataFrame:
    """ancestor, node, distance: one row for each pair in a tree, from the stored paths."""
    spread = hierarchy.trees.where("depth > 0").select("node", "depth", F.posexplode("path").alias("at", "ancestor"))
    return spread.where("at < depth").select("ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))
