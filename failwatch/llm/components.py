"""Connected components by contraction, in tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from failwatch.storage import materialize, remove


def forest_roots(moves: DataFrame) -> DataFrame:
    """(node, root) of a forest given as (node, to), by pointer jumping."""
    known = materialize(moves.select("node", F.col("to").alias("root")), "roots")
    while True:
        on = known.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = known.join(on, "root", "left").select("node", F.coalesce("next", "root").alias("root"), "next")
        jumped = materialize(jumped, "roots")
        remove(known)
        known = jumped.drop("next")
        if jumped.where("next is not null").isEmpty():
            return known


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge; component is the smallest node reachable.

    ``edges`` has columns a and b. Each round every node that has a smaller neighbour moves to the
    smallest one; moves lead to ever smaller nodes, so they form a forest, and all nodes of a tree
    become its root. Edges are renamed to roots, those inside a tree go and equal ones become one,
    so the rows of a round shrink at least by the nodes that moved, and long chains end in one
    round. Minima are taken on the map side first, so a node with many edges costs one row per
    task. The smallest node of a component never moves. Edges with a null end are ignored."""
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("component")), "labels")
    while not edges.isEmpty():
        roots = forest_roots(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")))
        ends = {end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")) for end in "ab"}
        a, b = F.coalesce("a_root", "a"), F.col("b_root")
        renamed = edges.join(ends["b"], "b").join(ends["a"], "a", "left").where(a != b)
        fewer = materialize(renamed.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
        moved = roots.select(F.col("node").alias("component"), "root")
        named = labels.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        named = materialize(named, "labels")
        remove(edges, labels, roots)
        edges, labels = fewer, named
    return labels
