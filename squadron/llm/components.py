"""Connected components over an edge table, with joins and aggregates only.

Every round gives each node the smallest label among its own and its
neighbours' labels, then lets each label jump to that label's label, so
chains shorten by half a round.  Rounds end when no label changed; each is
written to the shared checkpoint folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from squadron.session import stage_table


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node
    reachable.  Self links and repeated links are allowed; no edges, no rows."""
    both = stage_table(edges.select("a", "b").union(edges.select("b", "a"))
                       .filter("a <> b").distinct(), "edges")
    labels = stage_table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                         .select("node", F.least("node", "low").alias("component")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), F.col("component")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen")))
        step = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "seen").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = stage_table(step.join(jump, "component", "left")
                            .select("node", "old", F.least("component", F.coalesce("further", "component"))
                                    .alias("component")), "labels")
        labels = moved.select("node", "component")
        if moved.filter("old <> component").isEmpty():
            return labels
