"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planforge.llm.common import materialize, release


def components(links: DataFrame) -> DataFrame:
    """links: a, b (longs, undirected). One row per linked node: node, component (its smallest reachable node).

    Each round takes the smallest label of a node's neighbours and then the label of that label, so
    the number of rounds is about the logarithm of the longest chain. Labels are written each round;
    aggregates combine before the shuffle and the joins are plain equi-joins, which adaptive
    execution splits at a hub.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    edges = materialize(both, "cc-links")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "cc-labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        moved = lower.join(jump, "low", "left").select("node", F.least("low", F.coalesce("next", "low")).alias("label"), F.col("label").alias("was"))
        moved = materialize(moved, "cc-labels")
        release(labels)
        labels = moved
        if not moved.where("label <> was").limit(1).count():
            release(edges)
            return moved.select("node", F.col("label").alias("component"))
