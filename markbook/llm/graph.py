"""Connected components by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm.common import discard, lookup_join, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all ends of ``links`` (a, b): the smallest node reachable.

    Each round takes the least label of a node's neighbours, then the label of that label, so paths shorten by more than
    half.  A hub's edges are spread by ``lookup_join``; the least label is combined map-side.  Labels are written each round.
    """
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = stored(edges, "edges")
    total = edges.count()
    nodes = edges.select("a").distinct().count()
    labels = stored(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"), F.count("*").alias("degree")), "labels")
    while True:
        asked = lookup_join(edges, labels.select(F.col("a").alias("b"), "label", "degree"), "b", "degree", total, F.col("a").cast("string"))
        near = asked.groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(near, "a").select("a", "degree", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        nearer = stored(nearer, "labels")
        held = nearer.groupBy("label").agg(F.count("*").alias("holders"))
        roots = held.join(nearer.select(F.col("a").alias("label"), F.col("label").alias("root")), "label")
        jumped = lookup_join(nearer, roots, "label", "holders", nodes, F.col("a").cast("string"))
        after = stored(jumped.select("a", "degree", "old", F.least("label", F.coalesce("root", "label")).alias("label")), "labels")
        moved = after.where("label <> old").limit(1).count()
        discard(labels, nearer)
        labels = after.drop("old")
        labels.stored_path = after.stored_path
        if not moved:
            discard(edges)
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
