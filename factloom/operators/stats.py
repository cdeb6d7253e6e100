"""Counts, shares and rankings over entities and their multi-valued codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, by: str, n: int, *, ties: str | None = None) -> DataFrame:
    """The n rows of the largest `by`; equal ones by `ties`, ascending."""
    return df.orderBy(F.desc(by), *([ties] if ties else [])).limit(n)


def rank_values(df: DataFrame, column: str, n: int | None = None, *, name: str = "n") -> DataFrame:
    """Values of a column by how many rows hold them; nulls are dropped."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name))
    return counts if n is None else top(counts, name, n, ties=column)


def bubble(entities: DataFrame, codes: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """Counts and mean size by (year, code, grp) over the n most frequent codes. A code counts once for an entity, rows
    without a year are dropped. The top codes are found first and then kept by a semi-join, so nothing is pivoted."""
    flat = entities.where(F.col("year").isNotNull()).join(codes.distinct(), "id").join(sizes, "id", "left")
    best = top(flat.groupBy("code").agg(F.count("*").alias("n")), "n", n, ties="code")
    return flat.join(F.broadcast(best), "code", "left_semi").groupBy("year", "code", "grp").agg(F.count("*").alias("n"), F.bround(F.avg(F.coalesce("size", F.lit(0))), 1).alias("mean_size"))


def matrix(rows: DataFrame, row: str, column: str, n_rows: int, n_columns: int) -> DataFrame:
    """Long-form matrix of distinct ids over the most frequent rows and columns; missing cells are 0."""
    cells = rows.select("id", row, column).distinct()
    r = F.broadcast(top(cells.groupBy(row).agg(F.countDistinct("id").alias("n")), "n", n_rows, ties=row).select(row))
    c = F.broadcast(top(cells.groupBy(column).agg(F.countDistinct("id").alias("n")), "n", n_columns, ties=column).select(column))
    counted = cells.join(r, row, "left_semi").join(c, column, "left_semi").groupBy(row, column).agg(F.count("*").alias("n"))
    grid = r.crossJoin(c)  # n_rows x n_columns names
    return grid.join(counted, [row, column], "left").select(row, column, F.coalesce("n", F.lit(0)).alias("n"))


def ratio(x: Column, y: Column) -> Column:
    """x / y, and 0 where y is."""
    return F.coalesce(F.try_divide(x.cast("double"), y), F.lit(0.0))


def shares(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Entities of each (group, value), the group's entities, and the share; multi-valued entities count once for a value."""
    flat = rows.select("id", group, value).distinct()
    counts = flat.groupBy(group, value).agg(F.count("*").alias("n"))
    sizes = flat.groupBy(group).agg(F.countDistinct("id").alias("size"))
    return counts.join(sizes, group).withColumn("share", ratio(F.col("n"), F.col("size")))


def specialisation(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Share in the group over share in all: 1 where the group is like the whole."""
    flat = rows.select("id", group, value).distinct()
    everything = flat.agg(F.countDistinct("id").alias("all_ids"))
    overall = flat.groupBy(value).agg(F.countDistinct("id").alias("all_n"))
    part = shares(rows, group, value)
    return part.join(overall, value).crossJoin(F.broadcast(everything)).select(group, value, "n", "size", "all_n", "all_ids", ratio(F.col("share"), ratio(F.col("all_n"), F.col("all_ids"))).alias("coefficient"))


def terms(rows: DataFrame, chosen: Column, least: int, n: int) -> DataFrame:
    """Terms of a selection of rows (id, term): ids that hold them there and overall, and the ratio of shares. Both counts come
    from one pass; a row without an id counts for nothing."""
    rows = rows.select("id", "term", F.coalesce(chosen, F.lit(False)).alias("chosen")).where(F.col("id").isNotNull())
    both = lambda df, a, b: df.agg(F.count_if("chosen").alias(a), F.count("*").alias(b))
    counts = both(rows.groupBy("id", "term").agg(F.bool_or("chosen").alias("chosen")).groupBy("term"), "n_selected", "n_all").where(F.col("term").isNotNull())
    totals = both(rows.groupBy("id").agg(F.bool_or("chosen").alias("chosen")).groupBy(), "ids", "all_ids")
    share = ratio(ratio(F.col("n_selected"), F.col("ids")), ratio(F.col("n_all"), F.col("all_ids")))
    found = counts.where(F.col("n_selected") >= least).crossJoin(F.broadcast(totals))  # one row
    return top(found.select("term", "n_selected", "n_all", share.alias("coefficient")), "n_selected", n, ties="term")


def majority(votes: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """The most frequent value of each key; equal ones by first appearance, or by value."""
    counts = votes.groupBy(key, value).agg(F.count("*").alias("n"), *([F.min(order).alias("first")] if order else []))
    w = Window.partitionBy(key).orderBy(F.desc("n"), *(["first"] if order else []), value)
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "first")


def top_groups(df: DataFrame, column: str, n: int, other: str = "other") -> DataFrame:
    """Adds `bucket`: the value where it is among the n most frequent, else the name for the rest."""
    best = rank_values(df, column, n).select(F.col(column).alias("kept"))
    return df.join(F.broadcast(best), F.col(column) == F.col("kept"), "left").withColumn("bucket", F.coalesce("kept", F.lit(other))).drop("kept")


def held_terms(entities: DataFrame, statements: DataFrame, codes: DataFrame, kinds: tuple[str, ...] = ("code", "component", "relation", "title")) -> DataFrame:
    """id, kind and term, each once, of the kinds asked for: classification codes (id, code), components and relations of statements,
    and words of two letters or more in titles (id, title)."""
    word = F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"\p{L}{2,}"), F.lit(0)))
    ends = F.explode(F.array("source", "target"))
    made = {"code": (codes, F.col("code")), "component": (statements, ends), "relation": (statements, F.col("relation")), "title": (entities, word)}
    parts = [df.select("id", c.alias("term")).select("id", F.lit(k).alias("kind"), "term") for k, (df, c) in made.items() if k in kinds]
    return reduce(DataFrame.unionByName, parts).where("term IS NOT NULL").distinct()


def members(entities: DataFrame, held: DataFrame, company: str, kind: str, term: str) -> DataFrame:
    """Entities of a company that hold a term of a kind; held as `held_terms` gives it."""
    ids = held.where((F.col("kind") == kind) & (F.col("term") == term)).select("id")
    return entities.where(F.col("company") == company).join(ids, "id", "left_semi")
