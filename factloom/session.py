"""Session factory with the settings the library is written for, and tables in the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "factloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI; master and settings override what the cluster gives."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this machine only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = sc.getCheckpointDir()
        if not held:
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="factloom-"))
            held = sc.getCheckpointDir()
        found = held
    return found.rstrip("/")


def by_key(df: DataFrame) -> DataFrame:
    """df as a side of a join that deals rows by key. By itself the planner sends a table whole through the driver if its files or shuffled
    blocks are small; those are compressed, and of few different values a table takes ten times as much in memory."""
    return df.hint("merge")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends there, and a lost executor loses nothing.
    A reader takes up to 4096 rows of a row group into memory at once; where rows are large, `rows` is how many a group may hold."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    written = df.write.option("compression", "zstd")
    (written if rows is None else written.option("parquet.block.row.count.limit", rows)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
