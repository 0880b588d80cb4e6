"""Connected components of a link table, by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); the label is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours, then the label of that label.
    Minima are aggregates that combine before the shuffle; the tables are written each round. A round that
    changes nothing ends it, whatever the number of rounds.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = scratch.store(both.filter("a <> b").distinct())
    labels = scratch.store(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a")).agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("next"))
        lower = scratch.store(lower)
        target = lower.select(F.col("node").alias("_node"), F.col("next").alias("_next"))
        jumped = scratch.store(
            lower.join(target, F.col("next") == F.col("_node"), "left").select(
                "node", F.least("next", F.coalesce("_next", "next")).alias("next"), F.col("label").alias("old")
            )
        )
        done = jumped.filter("next <> old").isEmpty()
        scratch.drop(labels)
        scratch.drop(lower)
        labels = jumped.select("node", F.col("next").alias("label"))
        labels.scratch_path = jumped.scratch_path
        if done:
            scratch.drop(edges)
            return labels
