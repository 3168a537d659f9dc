"""Connected components with joins and aggregates, for graphs of any size.

Nodes are longs and edges are pairs of them. Every round contracts the graph:
each node is hooked to its smallest neighbour, chains of hooks are shortened by
pointer jumping until all nodes point at the root of their tree, and the edges
are rewritten to roots. Edges inside a tree vanish. Tables are written to the
shared folder after each step, so the lineage stays short, and only row counts
reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import drop_stored, stored


def _jump_to_roots(parents: DataFrame) -> DataFrame:
    """``parents`` (node, parent), parent < node or equal: each node with its root."""
    spark = parents.sparkSession
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = stored(
            parents.join(up, "parent", "left").select(
                "node",
                F.coalesce("grand", "parent").alias("parent"),
                (F.coalesce("grand", "parent") != F.col("parent")).alias("moved"),
            ),
            "roots",
        )
        moved = jumped.filter("moved").limit(1).count()
        drop_stored(spark, parents)
        parents = jumped.select("node", "parent")
        if not moved:
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from every node of ``edges``.

    ``edges`` has the long columns a and b. Rows with a null and loops join
    nothing; repeated edges count once. Nodes without an edge are not returned,
    so an empty table gives an empty table. The smallest node of a component is
    never hooked away, hence the root of its tree at the end.

    No node's neighbours are gathered: the smallest one is an aggregate that
    combines before its shuffle, and both joins of a round are equality joins
    with one row per node on one side.
    """
    spark = edges.sparkSession
    edges = stored(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    labels = None
    while edges.limit(1).count():
        hooks = stored(
            edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")), "hooks"
        )
        roots = _jump_to_roots(hooks)
        if labels is None:
            smallest = edges.select(F.col("b").alias("node")).distinct()
            labels_new = roots.select("node", F.col("parent").alias("component")).unionByName(
                smallest.join(roots, "node", "left_anti").select(
                    "node", F.col("node").alias("component")
                )
            )
        else:
            labels_new = labels.join(
                roots.select(F.col("node").alias("component"), "parent"), "component", "left"
            ).select("node", F.coalesce("parent", "component").alias("component"))
        labels_new = stored(labels_new, "labels")
        left = roots.select(F.col("node").alias("a"), F.col("parent").alias("root_a"))
        right = roots.select(F.col("node").alias("b"), F.col("parent").alias("root_b"))
        ends = (
            edges.join(left, "a", "left")
            .join(right, "b", "left")
            .select(
                F.coalesce("root_a", "a").alias("a"),
                F.coalesce("root_b", "b").alias("b"),
            )
            .filter("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )
        contracted = stored(ends, "edges")
        for table in (edges, roots, labels):
            if table is not None:
                drop_stored(spark, table)
        edges, labels = contracted, labels_new
    if labels is None:
        return spark.createDataFrame([], "node long, component long")
    return labels
