"""Connected components of a graph given by its edges, in Spark only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.runtime import attach, materialize, release


def connected_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """node, label (the smallest node of its component) for each node of edges (a long, b long).

    Each round takes the smallest label among a node and its neighbours, then jumps to the label of that label, so that
    long chains shorten by powers. Every round is written to the shared folder; nothing is gathered on the driver but a
    count and a sum. An edge from a node to itself makes it a component of its own; no edges give no rows.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    both = materialize(both.where("node is not null and other is not null").distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.min(F.least("node", "other")).alias("label")), "labels")
    total = F.sum(F.col("label").cast("decimal(38,0)"))
    n, before = labels.agg(F.count("*"), total).first()
    for _ in range(rounds if n else 0):
        near = attach(both.select("node", F.col("other").alias("key")), labels.select(F.col("node").alias("key"), "label"), "key", n, 40, "inner")
        least = near.select("node", "label").union(labels).groupBy("node").agg(F.min("label").alias("key"))
        jump = attach(least, labels.select(F.col("node").alias("key"), "label"), "key", n, 40, "inner")
        after = materialize(jump.select("node", F.least("key", "label").alias("label")), "labels")
        now = after.agg(total).first()[0]
        release(labels)
        labels = after
        if now == before:
            break
        before = now
    else:
        if n:
            raise RuntimeError("components did not settle")
    release(both)
    return labels
