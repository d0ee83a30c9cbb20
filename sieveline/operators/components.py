"""Connected components over an edge table, by contraction of minimum-neighbour forests.

Each round, every node with a smaller neighbour takes the smallest as its parent, pointer jumping flattens the forest,
and the edges are rewritten to the roots. Every step reads tables cut by ``durable``, so that each join has a plain
shuffle on both sides and the adaptive planner can split a hub's rows among tasks. Nothing is collected but row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.plans.durable import durable


def flatten_forest(forest: DataFrame) -> DataFrame:
    """(node, parent) with every parent a root, by pointer jumping; ``forest`` must be durable and without cycles."""
    while True:
        up = forest.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
        jumped = durable(
            forest.join(up, F.col("parent") == F.col("_n"), "left").select(
                "node", F.coalesce("_p", "parent").alias("parent"), F.col("_p").isNotNull().alias("moved")
            )
        )
        forest = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return forest


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Columns node, component (the smallest node reachable) for each node that has an edge to another node.

    Nodes may be of any type that can be ordered. Edges with a null end and loops are ignored; repeated edges and either
    direction count once; an empty edge table gives an empty result.
    """
    ends = edges.select(F.col(src).alias("x"), F.col(dst).alias("y"))
    e = durable(
        ends.where(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct()
    )
    rounds: list[DataFrame] = []
    while not e.isEmpty():
        forest = flatten_forest(durable(e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent"))))
        rounds.append(forest)
        a = forest.select(F.col("node").alias("_a"), F.col("parent").alias("_pa"))
        b = forest.select(F.col("node").alias("_b"), F.col("parent").alias("_pb"))
        half = durable(e.join(a, F.col("hi") == F.col("_a"), "left").select(F.coalesce("_pa", "hi").alias("x"), "lo"))
        moved = half.join(b, F.col("lo") == F.col("_b"), "left").select("x", F.coalesce("_pb", "lo").alias("y"))
        e = durable(
            moved.where(F.col("x") != F.col("y"))
            .select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo"))
            .distinct()
        )
    if not rounds:
        return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    labels = rounds[0]
    for later in rounds[1:]:
        up = later.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
        kept = labels.join(up, F.col("parent") == F.col("_n"), "left").select("node", F.coalesce("_p", "parent").alias("parent"))
        labels = durable(kept.unionByName(later))
    roots = labels.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return labels.select("node", F.col("parent").alias("component")).unionByName(roots)
