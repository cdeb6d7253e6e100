"""A collection's life: versions of its tables, a log of review changes, undo.

A collection is a folder that Spark can write to:

  tables/<table>/<version>   Parquet, written once and never changed
  manifest/<version>         one row for each table: where its current state lies. A version exists once its manifest does; Spark
                             commits that by one rename, so readers see all of a version or nothing
  log                        review changes in the order of `seq`: id, rows (null: the review is taken back)

A table that a version does not write is taken over from the one before, by its path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

ROWS = "array<struct<source:string,relation:string,target:string,keep:boolean>>"
LOG = f"seq long, id string, rows {ROWS}"
_MANIFEST = "version long, name string, path string"


class Collection:
    """One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self, version: int | None = None) -> DataFrame:
        """version, name and path of the tables of a version, the last one by default; none for a new collection."""
        try:
            every = self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifest/*")
        except AnalysisException:  # nothing is there yet
            return self.spark.createDataFrame([], _MANIFEST)
        of = every.agg(F.max("version").alias("version")) if version is None else self.spark.createDataFrame([(version,)], "version long")
        return every.join(F.broadcast(of), "version", "left_semi")

    def state(self) -> tuple[int, dict[str, str]]:
        """The last version (0 for a new collection) and its tables' paths."""
        rows = self.manifest().collect()  # a row for each table
        return (rows[0].version, {r.name: r.path for r in rows}) if rows else (0, {})

    def read(self, name: str, version: int | None = None) -> DataFrame:
        found = self.manifest(version).where(F.col("name") == name).collect()
        if not found:
            raise ValueError(f"no table {name} in {self.root}" + ("" if version is None else f", version {version}"))
        return self.spark.read.parquet(found[0].path)

    def commit(self, **tables: DataFrame) -> int:
        """Writes a new version with these tables in place of the ones before, and returns its number."""
        version, paths = self.state()
        version += 1
        for name, df in tables.items():
            paths[name] = f"{self.root}/tables/{name}/{version}"
            df.write.mode("overwrite").parquet(paths[name])  # what an attempt without a manifest left is replaced
        return self._committed(version, paths)

    def restore(self, version: int) -> int:
        """A new version that is as an old one was; nothing in between is lost."""
        old = {r.name: r.path for r in self.manifest(version).collect()}
        if not old:
            raise ValueError(f"no version {version} in {self.root}")
        return self._committed(self.state()[0] + 1, old)

    def _committed(self, version: int, paths: dict[str, str]) -> int:
        rows = [(version, n, p) for n, p in paths.items()]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.json(f"{self.root}/manifest/{version}")
        return version

    @property
    def log_path(self) -> str:
        return f"{self.root}/log"

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(self.log_path)
        except AnalysisException:
            return self.spark.createDataFrame([], LOG)

    def record(self, changes: DataFrame) -> None:
        """Appends changes (id, rows) to the log; their order is that of `seq` if they have it, else of their ids."""
        last = self.log().agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
        order = ["seq", "id"] if "seq" in changes.columns else ["id"]
        numbered = changes.withColumn("n", F.row_number().over(Window.orderBy(*order)))  # changes of one session of reviewing are few
        numbered.crossJoin(last).select((F.col("last") + F.col("n")).alias("seq"), F.col("id").cast("string").alias("id"), F.col("rows").cast(ROWS).alias("rows")).write.mode("append").parquet(self.log_path)


def create(spark: SparkSession, root: str, name: str, entities: DataFrame, statements: DataFrame) -> Collection:
    """A new collection with its first version: name, entities, statements and an empty table of reviews."""
    made = Collection(spark, root)
    if made.state()[0]:
        raise ValueError(f"{root} holds a collection already")
    made.commit(meta=spark.createDataFrame([(name,)], "name string"), entities=entities, statements=statements, reviews=spark.createDataFrame([], LOG))
    return made


def latest(log: DataFrame) -> DataFrame:
    """seq, id, rows: the last change of each id, reviews taken back included. Order and repeats of the changes do not matter."""
    return log.groupBy("id").agg(F.max_by(F.struct("seq", "rows"), "seq").alias("c")).select("c.seq", "id", "c.rows")


def reviews_of(state: DataFrame) -> DataFrame:
    """id, rows of ids with a review: those whose last change did not take it back."""
    return latest(state).where("rows IS NOT NULL").select("id", "rows")


def undone(log: DataFrame, since: int) -> DataFrame:
    """Changes (id, rows) that take back all changes from number `since` on: each id gets the review that it had before, or none."""
    before = latest(log.where(F.col("seq") < since)).select("id", "rows")
    return log.where(F.col("seq") >= since).select("id").distinct().join(before, "id", "left")


def applied(collection: Collection) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges a batch of changes into the table of reviews and commits it as a version. Changes that the table has
    already, from this stream or any other, change nothing and make no version."""

    def merge(changes: DataFrame, batch: int) -> None:
        known = collection.read("reviews")
        new = changes.join(known.select("id", F.col("seq").alias("held")), "id", "left").where("held IS NULL OR seq > held")
        if not new.isEmpty():
            collection.commit(reviews=latest(known.unionByName(new.select("seq", "id", "rows"))))

    return merge


def follow(collection: Collection, checkpoint: str):
    """Applies all changes that the log has got since the last call, and stops."""
    stream = collection.spark.readStream.schema(LOG).parquet(collection.log_path)
    return stream.writeStream.foreachBatch(applied(collection)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def analysed(entities: DataFrame, statements: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and statements after an analysis (id, candidates, error) came in: statements of the ids analysed are replaced, and
    those ids marked; ids whose analysis failed stay as they were."""
    good = found.where("error IS NULL").select("id", "candidates")
    new = good.select("id", F.posexplode("candidates").alias("ord", "c")).select("id", "ord", "c.*")
    ids = good.select("id").withColumn("now", F.lit(True)).distinct()
    marked = entities.join(ids, "id", "left").withColumn("analyzed", F.coalesce("now", "analyzed" if "analyzed" in entities.columns else F.lit(False))).drop("now")
    return marked, statements.join(ids, "id", "left_anti").unionByName(new, allowMissingColumns=True)
