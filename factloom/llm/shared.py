"""Session settings and shared-folder tables that the operators of this package use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import fresh_path, shared_dir, stored  # noqa: F401

#: Rows and bytes in an Arrow batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table of the input folder, pruned to the columns named."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def spread(table: DataFrame) -> DataFrame:
    """A table just read, dealt out anew if its files give fewer splits than there are cores, as a small or a single-block file does."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keeps Arrow batches small, so that a worker's memory does not follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def sampled(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """The different rows of df by the columns named, all of them if there are at most `most`, else those with the smallest hashes:
    the same on every run, never more than `most`, and none only where df is empty. Equal rows count once, however many there are."""
    key = F.xxhash64(*columns)
    low = df.select(key.alias("key")).distinct().orderBy("key").limit(most + 1).agg(F.count("*").alias("rows"), F.max("key").alias("key")).first()
    some = df if low["rows"] <= most else df.where(key < low["key"])
    return some.withColumn("sample_key", key).dropDuplicates(["sample_key"]).select(*df.columns)
