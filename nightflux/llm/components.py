"""Connected components of a large set of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for links (a, b).

    Each round takes the least label among a node and its neighbours, and then the label that this label had, so long
    chains shrink quickly. A round is one table in the shared folder; only whether it changed anything reaches the driver.
    """
    both = C.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = C.written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        told = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        lower = told.unionByName(labels.withColumn("old", F.col("label"))).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("via_label"))
        new = C.written(lower.join(jump, lower["label"] == jump["via"]).select("node", "old", F.least("label", "via_label").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
