"""Connected components of links, by passing on least labels and following them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relaygauge.llm.frames import stage


def thinned(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same components as ``links``, a the greater node: each node keeps the link to its least
    neighbour below, and its other neighbours below are linked to that one instead.

    Links of many nodes to the same few, as blocks of a large component give them, fall to one a node.  A task
    holds a node's neighbours below, which are sorted and may spill.
    """
    least = F.min("b").over(W.partitionBy("a"))
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().withColumn("_least", least)
    other = F.when(F.col("b") == F.col("_least"), F.col("a")).otherwise(F.col("b"))
    return down.select(other.alias("a"), F.col("_least").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the least node of its component.

    Links are thinned twice before they are joined.  Each round takes the least label of all neighbours and then the label of that label, so
    rounds grow with the logarithm of the longest chain.  Only a count of changes comes to the driver.
    """
    few = stage(thinned(thinned(links)), "thinned")
    both = stage(few.unionByName(few.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "neighbours")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("_near"))
        )
        low = labels.join(near, "node").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("_low"))
        beyond = labels.select(F.col("node").alias("_low"), F.col("component").alias("_beyond"))
        labels = stage(
            low.join(beyond, "_low").select("node", "_old", F.least("_low", "_beyond").alias("component")), "labels"
        )
        if labels.where("component != _old").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
