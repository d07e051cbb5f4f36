"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b), any order, no nulls.  Returns (node, component): the least node reachable, for every node named.

    A round takes the least label among neighbours and then the label of that label, so a path of n nodes needs about
    log n rounds.  Every round is a written table; joins are plain exchanges, so a node with very many edges is split at
    run time, and minima are combined before they shuffle.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "cc-labels")
    while True:
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy("a")
            .agg(F.min("label").alias("near"))
            .join(labels, F.col("a") == labels.node)
            .select("node", "label", F.least("near", "label").alias("near"))
        )
        far = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        found = materialize(
            near.join(far, near.near == far["at"]).select("node", F.least("near", "far").alias("label"), (F.least("near", "far") != F.col("label")).alias("moved")),
            "cc-labels",
        )
        labels = found.select("node", "label")
        if not found.where("moved").limit(1).count():
            return labels.withColumnRenamed("label", "component")
