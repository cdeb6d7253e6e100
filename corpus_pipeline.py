"""A training-data pipeline in five stages over the table documents.

Each stage reads what the one before wrote and keeps the columns of documents;
the last returns token ids. A stage's decisions take effect: rejected documents
are gone for all later stages, redacted texts stay redacted.

Defined cases are those of the operators: null and empty texts have no language
and go at the first stage; a document of a null id is handled like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, decontaminate, language, minhash, secrets
from factloom.llm.shared import fresh_path, read, spread

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least share of the best language among all, below which a document is rejected.
LEAST_SCORE = 0.5


def _known(docs: DataFrame) -> DataFrame:
    """The columns of documents, and no others that clash."""
    return docs.select(*COLUMNS)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no known language; lang becomes the one found."""
    docs = _known(docs)
    model = language.train(docs.where(F.col("doc_id").isNotNull() & ~language.held_out()), id_col="doc_id")
    # The other columns ride along as the id, so nothing is shuffled to bring them back.
    found = language.predict(docs.select(F.struct("doc_id", "source", "n_chars").alias("row"), "text"), model, id_col="row", with_text=True)
    good = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return good.select("row.doc_id", "text", F.col("lang_pred").alias("lang"), "row.source", "row.n_chars")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates. Ids may repeat: what goes is told by id and text,
    so other texts of a copy's id stay, and of rows equal in both one stays. Near texts of one id all stay. The operator takes an id
    for one document where it is the smallest of several sets: if one of its texts is then near to a smaller id's, all of them go."""
    keyed = _known(docs).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = minhash.near_duplicates(_known(docs), with_key=True).where(~F.col("kept"))
    dropped = found.select(F.col("doc_id").alias("gone"), F.col("text_key").alias("gone_key")).distinct()
    stay = keyed.join(dropped, keyed.doc_id.eqNullSafe(F.col("gone")) & (keyed.text_key == F.col("gone_key")), "left_anti")
    return stay.dropDuplicates(["doc_id", "text_key"]).drop("text_key")


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth of the words or more is test text."""
    rows = _known(docs).select(F.struct("doc_id", "lang", "source", "n_chars").alias("row"), "text")
    found = decontaminate.decontaminate(rows, read(spark, sf_dir, "benchmark", "item_id", "text"), id_col="row", with_text=True)
    return decontaminate.judged(found).where(~F.col("contaminated")).select("row.doc_id", "text", "row.lang", "row.source", "row.n_chars")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; n_chars follows."""
    docs = _known(docs)
    rows = docs.select(F.struct("doc_id", "lang", "source", "n_chars").alias("row"), "text")
    found = secrets.scan(rows, secrets.train(docs, id_col="doc_id"), id_col="row", redact=True)
    n_chars = F.when(F.size("spans") > 0, F.length("redacted").cast("long")).otherwise(F.col("row.n_chars"))
    return found.select("row.doc_id", F.col("redacted").alias("text"), "row.lang", "row.source", n_chars.alias("n_chars"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, proved by decoding: round_trip tells whether they give the text again."""
    rows = _known(docs).select(F.struct("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")).alias("row"), "text")
    back = bpe.round_trip(rows, id_col="row")
    same = F.sha2(F.col("decoded").cast("binary"), 256) == F.col("row.digest")
    return back.select("row.doc_id", "row.lang", "row.source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify),
    ("near_duplicates", deduplicate),
    ("benchmark", remove_benchmark),
    ("secrets", redact),
    ("tokens", tokenize),
]

#: SQL cannot express the trained models; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
