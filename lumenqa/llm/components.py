"""Connected components by minimum labels with pointer jumping, on edges (u, v) of long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges``; label is the least node of its component.

    Each round takes the least label among neighbours and then the label's own label, so chains halve. Minima
    are taken map-side first, so a hub sends one row a task. Rounds end when a full one changes nothing; every
    round is checkpointed to the shared folder, so lost executors cost one round at most.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")).checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), "label")
        own = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        after = nearer.join(own, "to").select("node", F.least("to", "far").alias("label"), (F.least("to", "far") < F.col("label")).alias("moved")).checkpoint()
        labels = after.select("node", "label")
        if not after.where("moved").head(1):
            return labels
