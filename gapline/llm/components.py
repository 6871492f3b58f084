"""Connected components by least labels and pointer jumping, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node reachable) for every node of `links` (a, b). Neither links nor labels reach the driver.

    Null ends are not allowed; repeated links and links to oneself change nothing; no links give no rows.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = staged(both, "links")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        jumped = lower.join(up, "low").select("node", F.least("low", "up").alias("label"), (F.least("low", "up") < F.col("label")).alias("moved"))
        done = staged(jumped, "labels")
        labels = done.select("node", "label")
        if done.where("moved").isEmpty():
            return labels
