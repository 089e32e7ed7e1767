"""Connected components of a graph of links, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """a, b -> node, label: the smallest node that links connect it to, for every node that has a link.

    Each round takes the least label among a node and its neighbours, then that of its label, so chains halve. Rounds
    are written to the shared folder and read again; they end when one changes nothing. Neighbours' labels combine
    before they shuffle, and a node of many links is one of AQE's skewed keys at most.
    """
    both = links.where(F.col("a") != F.col("b"))
    edges = stored(both.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(both.select(F.col("b").alias("node"), F.col("a").alias("to"))).distinct(), "edges")
    label = stored(edges.groupBy("node").agg(F.min("to").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        near = edges.join(label.withColumnsRenamed({"node": "to"}), "to").groupBy("node").agg(F.min("label").alias("near"))
        best = label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("best"))
        up = label.select(F.col("node").alias("best"), F.col("label").alias("up"))
        step = stored(best.join(up, "best").select("node", "old", F.least("best", "up").alias("label")), "labels")
        changed = step.where(F.col("label") < F.col("old")).limit(1).count()
        label = step.select("node", "label")
        if not changed:
            return label
