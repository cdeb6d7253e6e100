"""The library's model as lazy views over the tables of an input folder.

entity       one row for each item of the collection
entity_code  classification codes of entities at three levels; repeats are kept
triple       source - relation - target statements with an integer score, 0 to 10
doc          texts with a group and a source
review       the human verdict on some documents
Each view has its SQL beside it, as a common table expression of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str, name: str, rows: int = 250_000) -> int:
    """Number of partitions that hold about so many rows of a table each, one a core at least: what a task holds does not follow the table."""
    return max(spark.sparkContext.defaultParallelism, table(spark, sf_dir, name).count() // rows + 1)


def entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("company"), F.col("n_name").alias("grp"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("title"))


def entity_code(spark: SparkSession, sf_dir: str, level: int) -> DataFrame:
    """Level 0 to 2, from the broadest code to the finest."""
    code = F.col(("p_type", "p_brand", "p_size")[level]).cast("string")
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return line.join(part, line.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("id"), code.alias("code"))


def triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    joined = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey).join(nation, supplier.s_nationkey == nation.n_nationkey)
    return joined.select(F.col("l_orderkey").alias("id"), F.col("p_brand").alias("source"), F.col("l_returnflag").alias("relation"), F.col("n_name").alias("target"), F.round(F.col("l_discount") * 100).cast("int").alias("score"))


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("grp"), F.col("source").alias("company"))


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("keep"))


ENTITY = "entity AS (SELECT o_orderkey AS id, c_mktsegment AS company, n_name AS grp, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS title FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
TRIPLE = "triple AS (SELECT l_orderkey AS id, p_brand AS source, l_returnflag AS relation, n_name AS target, CAST(round(l_discount * 100) AS INTEGER) AS score FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"


def code_sql(level: int) -> str:
    return f"entity_code AS (SELECT l_orderkey AS id, CAST({('p_type', 'p_brand', 'p_size')[level]} AS VARCHAR) AS code FROM lineitem JOIN part ON l_partkey = p_partkey)"
