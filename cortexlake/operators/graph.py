"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cortexlake.operators.stages import settled


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``links`` (``a, b``) that isn't its component's smallest.

    Each round every node hooks to its smallest neighbour and pointers are followed to their ends by doubling; the links go on between the ends.
    """
    live = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    labels = None
    while True:
        up = settled(live.groupBy("b").agg(F.min("a").alias("a")), "hooks")
        if not up.take(1):
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if labels is None else labels
        ends = lambda: up.select(F.col("b").alias("p"), F.col("a").alias("top"))  # noqa: E731, B023
        while up.join(ends(), up.a == F.col("p"), "left_semi").take(1):
            up = settled(up.join(ends(), up.a == F.col("p"), "left").select("b", F.coalesce("top", "a").alias("a")), "hooks")
        here = up.select(F.col("b").alias("node"), F.col("a").alias("root"))
        if labels is not None:
            here = labels.join(ends(), labels.root == F.col("p"), "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(here)
        labels = settled(here, "labels")
        x = live.join(ends(), live.a == F.col("p"), "left").select(F.coalesce("top", "a").alias("a"), "b")
        y = x.join(ends(), x.b == F.col("p"), "left").select("a", F.coalesce("top", "b").alias("b"))
        live = settled(y.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
