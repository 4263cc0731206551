"""Connected components by hooking, pointer jumping and contraction.

Each round hooks every vertex to its smallest neighbour, jumps pointers until
every tree is a star, and contracts the edges to the roots.  A round at least
halves the vertices that still have edges, so rounds are logarithmic.  All
state lives in tables in the shared folder; the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import materialize

#: Edges that one task works on, at least: a few links make one small file a round, not one for each shuffle partition.
EDGES_A_TASK = 50_000


def _jump(parent: DataFrame, parts: int) -> DataFrame:
    """Follow parents until every vertex points at its root; one table is written for every three steps."""
    while True:
        up = parent.select(F.col("v").alias("root"), F.col("root").alias("next"))
        deeper = parent
        for _ in range(3):
            deeper = deeper.join(up, "root").select("v", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        deeper = materialize(deeper.coalesce(parts), "jump")
        moved = deeper.where("moved").limit(1).count()
        parent = deeper.select("v", "root")
        if not moved:
            return parent


def connected_components(edges: DataFrame) -> DataFrame:
    """``v, component`` for every vertex with an edge; edges are pairs ``a, b`` of bigints.

    The component is the smallest vertex of those reachable.  Self-loops and
    repeated edges are harmless; an empty input gives an empty result.
    """
    edges = materialize(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while n := edges.count():
        parts = -(-n // EDGES_A_TASK)
        both = edges.select(F.col("b").alias("v"), F.col("a").alias("n")).union(edges.select(F.col("a").alias("v"), F.col("a").alias("n")))
        up = edges.select(F.col("a").alias("v"), F.col("b").alias("n"))
        parent = both.union(up).groupBy("v").agg(F.min("n").alias("n")).select("v", F.least("v", "n").alias("root"))
        roots = _jump(materialize(parent.coalesce(parts), "parent"), parts)
        if labels is None:
            labels, parts_of_labels = roots.select("v", F.col("root").alias("component")), parts
        else:
            step = roots.select(F.col("v").alias("component"), "root")
            labels = materialize(labels.join(step, "component", "left").select("v", F.coalesce("root", "component").alias("component")).coalesce(parts_of_labels), "labels")
        at_a, at_b = (roots.select(F.col("v").alias(k), F.col("root").alias(f"root_{k}")) for k in "ab")
        moved = edges.join(at_a, "a").join(at_b, "b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
        edges = materialize(moved.where("a != b").distinct().coalesce(parts), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("component"))
    return labels
