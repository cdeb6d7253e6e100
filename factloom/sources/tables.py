"""Readers and writers of lists, saved collections and reviews."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in column headers that tell a column's role; the first header that holds one wins. Fixed values.
ROLES = {
    "id": ("文献番号", "公報番号", "番号", "publication", "doc_id", "id"),
    "title": ("発明の名称", "名称", "title"),
    "applicant": ("出願人", "権利者", "applicant", "assignee", "company"),
    "fi": ("FI", "classification", "code"),
    "date": ("出願日", "filing", "date"),
    "url": ("URL", "link"),
    "claim": ("請求項", "請求の範囲", "claim"),
    "abstract": ("要約", "abstract", "text"),
    "alt": ("代替", "課題", "解決手段", "summary", "description"),
    "ipc": ("IPC",),
}


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or XLSX list with a header, all columns strings, quoted line ends allowed; a byte-order mark is dropped."""
    if path.lower().endswith(".xlsx"):
        from factloom.sources import workbooks

        return workbooks.read_workbook(spark, path)
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def detect_columns(columns: list[str]) -> dict[str, str]:
    """Role to column name, by header; a column has one role."""
    found: dict[str, str] = {}
    for role, words in ROLES.items():
        for word in words:
            hit = next((c for c in columns if c not in found.values() and re.search(re.escape(word), c, re.IGNORECASE)), None)
            if hit:
                found[role] = hit
                break
    return found


def documents(df: DataFrame, roles: dict[str, str], limit: int = 0) -> DataFrame:
    """Rows by role: id, title, applicant, fi (codes of the other scheme where it has none), year, url, text (claim, else abstract,
    else the alternative column) and where the text came from. limit: at most so many rows, 0 for all."""
    get = lambda role: F.nullif(F.trim(F.col(f"`{roles[role]}`")), F.lit("")) if role in roles else F.lit(None).cast("string")
    texts = [(role, get(role)) for role in ("claim", "abstract", "alt")]
    origin = F.coalesce(*(F.when(c.isNotNull(), F.lit(role)) for role, c in texts), F.lit("none"))
    year = F.regexp_extract(F.coalesce(get("date"), F.lit("")), "^([0-9]{4})", 1).try_cast("int")
    fields = {"id": get("id"), "title": get("title"), "applicant": get("applicant"), "fi": F.coalesce(get("fi"), get("ipc")), "year": year, "url": get("url")}
    rows = df.select(*(c.alias(n) for n, c in fields.items()), F.coalesce(*(c for _, c in texts)).alias("text"), origin.alias("text_source"))
    return rows.limit(limit) if limit else rows


def pasted(df: DataFrame, column: str, mark: str = "-----") -> DataFrame:
    """Rows for the non-empty trimmed blocks of a text."""
    blocks = F.split(F.col(column), re.escape(mark))
    return df.select(*(c for c in df.columns if c != column), F.posexplode(blocks).alias("n", "block")).withColumn("block", F.trim("block")).where("block <> ''")


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """The items of a saved collection, a JSON object with a list `patents`; analyzed defaults to true."""
    df = spark.read.json(path, multiLine=True)
    if "patents" not in df.columns:
        raise ValueError("a saved collection holds a list named patents")
    rows = df.select(F.explode("patents").alias("p")).select("p.*")
    return rows.withColumn("analyzed", F.coalesce("analyzed", F.lit(True)) if "analyzed" in rows.columns else F.lit(True))


def write_collection(df: DataFrame, path: str) -> None:
    """Items as JSON lines, a file for each task."""
    df.write.mode("overwrite").json(path)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="id string, source string, relation string, target string, keep boolean")


def write_list(df: DataFrame, path: str) -> None:
    """CSV with a header. The first header starts with a byte-order mark, so that spreadsheet programs take it as UTF-8."""
    first, *rest = df.columns
    df.select(F.col(first).alias("﻿" + first), *rest).write.mode("overwrite").csv(path, header=True, escape='"', encoding="UTF-8")


def known_reviews(reviews: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews of ids of the collection, and how many others were dropped."""
    names = ids.select("id").distinct()
    return reviews.join(names, "id", "left_semi"), reviews.join(names, "id", "left_anti").agg(F.count("*").alias("dropped"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation runs, the newest first."""
    runs = spark.read.json(path, multiLine=True, schema="time string, disabled array<string>, n long, exact_f1 double, struct_f1 double, note string")
    return runs.orderBy(F.desc("time"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder: path, length and content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def claim_texts(df: DataFrame, id_col: str, text_col: str, *, abstract: bool = False) -> DataFrame:
    """key and text of a supplement of claims, or of abstracts cut to their solution; the longest text of a key stays."""
    from factloom.functions import text

    body = text.solution_part(F.col(text_col)) if abstract else F.trim(F.col(text_col))
    rows = df.select(text.doc_key(F.col(id_col)).alias("key"), body.alias("text")).where("key <> '' AND text <> ''")
    return rows.groupBy("key").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
