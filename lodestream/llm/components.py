"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the links, for every node that has a link. Nodes without links are absent.

    Each round takes the smallest label among a node's neighbours, then the label of that label. Minima are combined before the
    shuffle, so a node with very many links is no single task's work; the joins are plain equi-joins that adaptive execution splits.
    Every round ends in a reliable checkpoint. Self links are ignored; null ends are dropped.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = checkpoint(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = checkpoint(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", F.least("component", "m").alias("l"), F.col("component").alias("old"))
        of = labels.select(F.col("node").alias("l"), F.col("component").alias("jump"))
        labels_and_old = checkpoint(step.join(of, "l", "left").select("node", F.least("l", F.coalesce("jump", "l")).alias("component"), "old"))
        labels = labels_and_old.select("node", "component")
        if labels_and_old.where("component <> old").isEmpty():
            return labels
