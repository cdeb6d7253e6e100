"""Canonical names: spellings that mean one thing, and statements rewritten to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text


def lenient(c: Column) -> Column:
    """A name in compatibility form without spaces, case, hyphens and dots between words, references and quantities before it."""
    return F.regexp_replace(F.lower(text.norm(text.nfkc(c))), "[-‐‑–—_・·.']", "")


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node reachable, of all ends of edges (a, b). A round takes the smallest label among a node's
    neighbours and then that label's own label, which shortens chains fast; rounds end when nothing changes."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")).checkpoint()
    moved = True
    while moved:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("aim"))
        further = labels.select(F.col("node").alias("aim"), F.col("label").alias("end"))
        after = lower.join(further, "aim").select("node", F.least("aim", "end").alias("next"), "label").checkpoint()
        moved = not after.where("next <> label").isEmpty()
        labels = after.select("node", F.col("next").alias("label"))
    return labels


def names(spelled: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """name and canonical of every spelling (name): names that are one after `lenient`, or that merges (name, into) join, directly or
    in steps, go by the smallest spelling among them. Null names are dropped, and what only merges name is no spelling."""
    every = spelled.select("name").where("name IS NOT NULL").distinct()
    same = every.select("name", lenient(F.col("name")).alias("form"))
    first = same.groupBy("form").agg(F.min("name").alias("first"))
    edges = same.join(first, "form").select(F.col("name").alias("a"), F.col("first").alias("b"))
    if merges is not None:
        known = every.select(F.col("name").alias("into"))
        edges = edges.unionByName(merges.join(every, "name", "left_semi").join(known, "into", "left_semi").select(F.col("name").alias("a"), F.col("into").alias("b")))
    return components(edges).select(F.col("node").alias("name"), F.col("label").alias("canonical"))


def rewritten(rows: DataFrame, canonical: DataFrame, *columns: str) -> DataFrame:
    """Rows with the canonical name in place of each spelling in these columns; names without one stay."""
    for c in columns:
        table = canonical.select(F.col("name").alias(c), F.col("canonical").alias(f"{c}_to"))
        rows = rows.join(table, c, "left").withColumn(c, F.coalesce(f"{c}_to", c)).drop(f"{c}_to")
    return rows


def tidy(relations: DataFrame, canonical: DataFrame) -> DataFrame:
    """id, source, relation, target, n: statements by canonical names and trimmed relations, each once with the number of rows that
    make it; those without an end or a relation, or from a name to itself, are dropped."""
    rows = rewritten(relations.select("id", "source", "target", text.stripped(F.col("relation")).alias("relation")), canonical, "source", "target")
    real = rows.where("trim(source) <> '' AND trim(target) <> '' AND relation <> '' AND source <> target")
    return real.groupBy("id", "source", "relation", "target").agg(F.count("*").alias("n"))
