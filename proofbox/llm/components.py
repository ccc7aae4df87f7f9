"""Connected components of a link table, on Spark: smallest-label propagation with label jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofbox.llm.common import scratch, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b: long); the label is the smallest node of its component.

    Each round a node takes the smallest label beside it and then that label's own label, so
    the rounds grow with the logarithm of a component's width. Labels are stored each round;
    only two sums reach the driver.
    """
    with scratch(links.sparkSession) as keep:
        return keep(_spread(links))


def _spread(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b")
    both = stored(both.distinct(), "links")
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    total = None
    while True:
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = stored(labels.join(jump, "label", "left").select("node", F.coalesce("further", "label").alias("label")), "labels")
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        labels = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"))
