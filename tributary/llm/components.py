"""Connected components by repeated joins: smallest neighbouring label, then pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import discard, materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b): component is the smallest node that is reachable.

    Each round gives a node the smallest label among its own and its neighbours' and then the label of that label,
    which about halves the remaining distance to the smallest node. Every round's labels are written to the shared
    folder. Fails if labels still change after ``rounds`` rounds, which takes paths of more than 2^rounds nodes or so.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "cc-labels")
    for _ in range(rounds):
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("near").alias("near"))
        )
        hooked = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("beyond"))
        nexts = hooked.join(jump, "to").select("node", F.least("to", "beyond").alias("component"), (F.least("to", "beyond") < F.col("component")).alias("changed"))
        nexts = materialize(nexts, "cc-labels")
        discard(labels)
        if nexts.where("changed").isEmpty():
            discard(both)
            out = nexts.select("node", "component")
            out._written_at = nexts._written_at
            return out
        labels = nexts
    raise RuntimeError(f"components still change after {rounds} rounds")
