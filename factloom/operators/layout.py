"""Coordinates of items by the main directions of their terms."""

from __future__ import annotations

from pyspark.ml.feature import PCA, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coordinates(terms: DataFrame, *, dimensions: int = 2, features: int = 256) -> DataFrame:
    """id and its coordinates, from rows (id, term): hashed term counts of unit length, projected on their principal components.
    A direction's sign is that of its largest projection, so the layout does not flip between runs."""
    lists = terms.groupBy("id").agg(F.collect_list("term").alias("terms"))
    vectors = Normalizer(inputCol="raw", outputCol="unit").transform(HashingTF(numFeatures=features, inputCol="terms", outputCol="raw").transform(lists)).select("id", "unit")
    placed = PCA(k=dimensions, inputCol="unit", outputCol="at").fit(vectors).transform(vectors).select("id", vector_to_array("at").alias("at"))
    sides = placed.agg(*(F.max_by(F.signum(F.col("at")[k]), F.struct(F.abs(F.col("at")[k]), F.col("id"))).alias(f"s{k}") for k in range(dimensions)))
    turned = F.array(*(F.col("at")[k] * F.col(f"s{k}") for k in range(dimensions)))
    return placed.crossJoin(F.broadcast(sides)).select("id", turned.alias("at"))
