"""Connected components of a table of links, by distributed rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.tables import discard, passing, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node reachable, for every node of ``links`` (a, b).

    Each round takes the least label among a node and its neighbours, then that label's own label, so
    that stars settle in two rounds and chains in about the logarithm of their length. Every round is written to
    the shared folder, where the last one stays; only its number of changes comes to the driver.
    """
    with passing(links.sparkSession) as keep:
        both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
        labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
                        .select("node", F.least("node", "b").alias("label")), "labels")
        while True:
            near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
            own = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
            own = stored(own, "labels")
            jump = own.select(F.col("node").alias("_at"), F.col("label").alias("_to"))
            next_ = stored(own.join(jump, own["label"] == jump["_at"]).select("node", "old", F.least("label", "_to").alias("label")), "labels")
            discard(labels, own)
            labels = next_.select("node", "label")
            if next_.where("old != label").isEmpty():
                return keep(labels)
