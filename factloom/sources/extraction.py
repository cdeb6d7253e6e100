"""Statement extraction with any extractor, its failures kept as values, and resumed where it stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROWS = "array<struct<source:string,relation:string,target:string,prob:double,selected:boolean,origin:string>>"
_ITEM = pa.struct([("source", pa.string()), ("relation", pa.string()), ("target", pa.string()), ("prob", pa.float64()), ("selected", pa.bool_()), ("origin", pa.string())])

#: Text to statements: dicts with source, relation, target, prob, selected, origin.
Extractor = Callable[[str], list[dict]]


def _running(extract: Extractor, most: int):
    schema = pa.schema([("id", pa.string()), ("candidates", pa.list_(_ITEM)), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out.append({"id": key, "candidates": extract(text), "error": None})
                except Exception as e:  # one text's failure is its result
                    out.append({"id": key, "candidates": None, "error": f"{type(e).__name__}: {e}"[:most]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def pending(docs: DataFrame, done: DataFrame | None) -> DataFrame:
    """Documents with a text that are not among the done ones (id, error null)."""
    rows = docs.where(F.coalesce(F.trim("text"), F.lit("")) != "")
    return rows if done is None else rows.join(done.where("error IS NULL").select("id"), "id", "left_anti")


def extracted(docs: DataFrame, extract: Extractor, *, most_error: int = 200) -> DataFrame:
    """id, candidates and error of each document (id, text)."""
    rows = docs.select(F.col("id").cast("string").alias("id"), "text")
    return rows.mapInArrow(_running(extract, most_error), f"id string, candidates {_ROWS}, error string")


class ExtractionFailed(RuntimeError):
    """The first documents all failed; the others were not tried."""


def probed(docs: DataFrame, extract: Extractor, *, first: int = 3, most_error: int = 200) -> DataFrame:
    """As `extracted`, but the first documents by id run before the rest starts: if all of them fail, nothing else is tried and their
    error is raised, so that a broken extractor costs three calls and not one for each document. What they gave is kept."""
    head = docs.orderBy("id").limit(first)
    tried = extracted(head.coalesce(1), extract, most_error=most_error).checkpoint()
    errors = [r.error for r in tried.select("error").collect()]  # at most `first` rows
    if len(errors) >= first and all(e is not None for e in errors):
        raise ExtractionFailed(errors[-1])
    rest = docs.withColumn("id", F.col("id").cast("string")).join(tried.select("id"), "id", "left_anti")
    return tried.unionByName(extracted(rest, extract, most_error=most_error))


def candidates(found: DataFrame) -> DataFrame:
    """One row for each statement, by descending probability within its document."""
    return found.select("id", F.posexplode(F.array_sort("candidates", lambda a, b: F.when(a["prob"] > b["prob"], -1).when(a["prob"] < b["prob"], 1).otherwise(0))).alias("ord", "c")).select("id", "ord", "c.*")
