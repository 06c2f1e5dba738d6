"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.llm.common import keep, scratch, stored


def connected(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, label) for every node of links (a, b), where label is the smallest node of its
    component.  start: (node, label) known beforehand, each label a node reachable from its node
    and not larger.  Each round takes the smallest label next to a node and then follows labels
    once more, so paths shrink by half or better a round.  Nodes without links have no row."""
    with scratch(links.sparkSession):
        return keep(_spread_labels(links, start))


def _spread_labels(links: DataFrame, start: DataFrame | None) -> DataFrame:
    both = stored(
        links.filter("a <> b").select("a", "b").unionByName(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    nodes = both.select(F.col("a").alias("node")).distinct()
    if start is None:
        labels = nodes.withColumn("label", F.col("node"))
    else:
        labels = nodes.join(start, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    labels = stored(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        next_ = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        # hop: what the label itself is now labelled
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("hop"))
        next_ = stored(next_.join(hop, "label", "left").select("node", F.least("label", "hop").alias("label"), "old"), "labels")
        changed = next_.filter("label <> old").limit(1).count()
        labels = next_.select("node", "label")
        labels._scratch = next_._scratch
        if not changed:
            return labels
