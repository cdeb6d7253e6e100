"""Relation and co-occurrence networks over statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges(triples: DataFrame, least: int = 1) -> DataFrame:
    """Statements by the number of distinct ids that make them."""
    return triples.groupBy("source", "relation", "target").agg(F.countDistinct("id").alias("count")).where(F.col("count") >= least)


def nodes(triples: DataFrame, least: int = 1) -> DataFrame:
    """Components by the number of distinct ids that name them on either side."""
    ends = triples.select("id", F.col("source").alias("node")).unionByName(triples.select("id", F.col("target").alias("node")))
    return ends.groupBy("node").agg(F.countDistinct("id").alias("count")).where(F.col("count") >= least)


def touched(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """Nodes at an end of some edge; all nodes where there is no edge."""
    ends = edges_.select(F.col("source").alias("node")).union(edges_.select("target")).distinct()
    none = edges_.groupBy().agg(F.count("*").alias("edges"))
    return nodes_.join(ends.withColumn("hit", F.lit(True)), "node", "left").crossJoin(F.broadcast(none)).where(F.col("hit") | (F.col("edges") == 0)).drop("hit", "edges")


def cooccurrence(codes: DataFrame, least: int = 1) -> DataFrame:
    """Pairs of different codes by the number of ids that hold both. Codes meet within an id only, whose distinct codes are few."""
    sets = codes.groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    pairs = sets.select("id", F.posexplode("codes").alias("i", "a"), "codes").select("a", F.explode(F.expr("slice(codes, i + 2, size(codes))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("count")).where(F.col("count") >= least)


def degrees(edges_: DataFrame) -> DataFrame:
    """Edges at each node; a loop counts for none."""
    real = edges_.where("source <> target")
    return real.select(F.col("source").alias("node")).unionAll(real.select("target")).groupBy("node").agg(F.count("*").alias("degree"))


def neighbours(edges_: DataFrame, node: str) -> DataFrame:
    """Nodes joined to a node, by the sum of the counts of the edges between."""
    near = edges_.where((F.col("source") == node) | (F.col("target") == node))
    return near.groupBy(F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source")).alias("neighbour")).agg(F.sum("count").alias("weight"))


def labelled(nodes_: DataFrame, n: int = 35) -> DataFrame:
    """Nodes whose count reaches that of the n-th largest (the smallest, where there are fewer)."""
    best = nodes_.orderBy(F.desc("count")).limit(n).agg(F.min("count").alias("limit"))
    return nodes_.crossJoin(F.broadcast(best)).where(F.col("count") >= F.col("limit")).drop("limit")


def scaled(nodes_: DataFrame) -> DataFrame:
    """Adds the count over the largest count."""
    most = nodes_.agg(F.max("count").alias("most"))
    return nodes_.crossJoin(F.broadcast(most)).withColumn("scale", F.try_divide(F.col("count").cast("double"), "most")).drop("most")


def depths(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Least depth of each node below the roots, level by level until no new node is found."""
    front = found = roots.select("node", F.lit(0).alias("depth")).distinct()
    depth = 0
    while not front.isEmpty():
        depth += 1
        below = front.join(links, front.node == links.source).select(F.col("target").alias("node")).distinct()
        front = below.join(found, "node", "left_anti").select("node", F.lit(depth).alias("depth")).checkpoint()
        found = found.unionByName(front)
        if depth % 20 == 0:  # so that the plan of a deep tree stays short
            found = found.checkpoint()
    return found


def crossing(links: DataFrame, depth: DataFrame) -> DataFrame:
    """Links that do not go exactly one level down."""
    a, b = depth.select(F.col("node").alias("source"), F.col("depth").alias("above")), depth.select(F.col("node").alias("target"), F.col("depth").alias("below"))
    return links.join(a, "source").join(b, "target").where("below <> above + 1").select("source", "target")


def surfaces(triples: DataFrame, most: int = 4) -> DataFrame:
    """The first few distinct spellings of each base term."""
    return triples.groupBy("base").agg(F.slice(F.array_sort(F.collect_set("surface")), 1, most).alias("surfaces"))


def best_of(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")
