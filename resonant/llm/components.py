"""Connected components of an edge table, distributed and restartable."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .spark_io import written

#: Steps between two tables written to the shared folder.
STEPS = 2


def _step(labels: DataFrame, both: DataFrame) -> DataFrame:
    """The smallest label among a node and its neighbours, then that label's own label."""
    around = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
    moved = labels.join(around, "node").select("node", F.least("root", "near").alias("root"))
    own = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return moved.join(own, "root").select("node", F.least("root", "next").alias("root"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of edges (a, b); the root is the component's smallest node.

    Labels spread to neighbours and jump to their own labels, so the rounds grow with the logarithm
    of the longest path; more than `rounds` of them raise an error. Every round is written to the shared folder.
    The joins are by node and by label, so the edges of a hub and the rows of a large component have one key. Adaptive
    execution splits these, which it does only between sides that come straight from a shuffle: so the first labels,
    an aggregate, are written before they are joined.
    """
    edges = edges.where("a != b")
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    for _ in range(rounds):
        moved = labels
        for _ in range(STEPS):
            moved = _step(moved, both)
        done = written(moved.join(labels.select("node", F.col("root").alias("old")), "node"), "labels")
        labels = done.select("node", "root")
        if done.where("old != root").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
