"""Connected components of a table of edges, by shuffled minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each end of edges (a, b): the smallest node reachable. Each round takes the least label among
    the neighbours and then the label of that label, so that long chains shrink fast; it ends when nothing changes."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels.node == near.a, "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("aim"))
        hooked = stored(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("via"), F.col("aim").alias("end"))
        after = hooked.join(jump, hooked.aim == jump.via, "left").select("node", F.least("aim", F.coalesce("end", "aim")).alias("label"), F.col("label").alias("old"))
        after = stored(after, "labels")
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return labels
