"""Connected components by repeated contraction: a distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.store import materialise


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)``: the smallest id reachable from each node.

    Each round points every node at the smallest id of its closed neighbourhood, follows that
    pointer twice, and rewrites the edges between the new labels. Every node that is not the
    smallest of its neighbourhood disappears, so a component at least halves in a round and long
    chains take logarithmically many. Nulls and loops are ignored; no edges give no rows.
    """
    live = (
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .distinct()
    )
    live = materialise(live, "links")
    labels = None
    while True:
        up = live.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        up = materialise(up, "pointers")
        jump = up.select(F.col("a").alias("q"), F.col("p").alias("pp"))
        far = materialise(up.join(jump, up.p == jump.q).select("a", F.col("pp").alias("p")), "pointers")
        if labels is None:
            labels = far.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            step = far.select(F.col("a").alias("from"), F.col("p").alias("to"))
            labels = labels.join(step, labels.component == step["from"], "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = materialise(labels, "labels")
        left = far.select("a", F.col("p").alias("pa"))
        right = far.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        live = materialise(
            live.join(left, "a").join(right, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(),
            "links",
        )
        if live.isEmpty():
            return labels
