"""Connected components of a table of links, by hooking and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links (a, b)``; a component is named by its smallest node.

    Every round lets a node take the smallest label among its neighbours and then
    its label's label, so paths shorten by halves; rounds are written to the
    shared folder and nothing but their count of changes reaches the driver.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("component")
        )
        above = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        moved = stage(
            hooked.join(above, "component").select("node", "was", F.least("component", "above").alias("component"))
        )
        labels = moved.select("node", "component")
        if moved.filter("component <> was").isEmpty():
            return labels
