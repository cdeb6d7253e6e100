"""Benchmark decontamination with an FM-index for each training shard.

Words are maximal runs of ASCII digits, letters (A-Z lower-cased) and
characters beyond ASCII. A test item's windows are its runs of `window`
consecutive words; a shorter item is one window. Every task indexes the texts
of its shard (only runs of words that occur in some window, since any other
word breaks a match), searches all windows backward through wavelet ranks,
locates the occurrences by sampled suffix positions and merges their spans.
Documents are never shuffled. Test items are collected in blocks of a bounded
number of bytes, each a broadcast; more blocks mean more passes, not more
memory.

Defined cases: a null or empty text has no words and no hits; repeated rows
and repeated ids each get their own output row; a null item id counts as the
empty string; items without words have no windows; an empty benchmark hits
nothing; other columns of the input are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.fm_index import FMIndex
from factloom.llm.shared import arrow_batches, read
from factloom.llm.textnp import chunks, column, covered, fold_table, prefix, span_hash, utf8, word_spans, word_table

WINDOW = 13
#: Text of the test items in one block; bounds the broadcast.
BLOCK_BYTES = 16 << 20
#: Indexed symbols of one shard; bounds a task's memory.
SHARD_SYMBOLS = 1 << 20
#: Rows of a shard, and bytes of its rows that wait for the search.
SHARD_ROWS, SHARD_BYTES = 50_000, 32 << 20

_SPANS = "array<struct<start:int,end:int>>"


def words_of(arr: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For bounded ranges of rows: first row, end row, hash of each word, offsets of the rows' words."""
    buf, off = utf8(arr)
    for a, b in chunks(off):
        part = fold_table(True)[buf[off[a] : off[b]]]
        s, e, rows = word_spans(part, off[a : b + 1] - off[a], word_table(True))
        yield a, b, span_hash(prefix(part), s, e), rows


class Windows:
    """The distinct windows of a block of test items, as ranks in their own alphabet."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.alphabet = np.zeros(0, np.uint64)
        owners: dict[bytes, set[str]] = defaultdict(set)
        texts = pa.array([t for _, t in items], pa.string())
        hashes = [h[rows[i] : rows[i + 1]] for a, b, h, rows in words_of(texts) for i in range(b - a)]
        for (name, _), h in zip(items, hashes, strict=True):
            n = min(window, len(h))
            for i in range(len(h) - n + 1 if n else 0):
                owners[h[i : i + n].tobytes()].add(name)
        if owners:
            self.alphabet = np.unique(np.frombuffer(b"".join(owners), np.uint64))
        self.groups: list[tuple[np.ndarray, list[tuple[str, ...]]]] = []
        by_length: dict[int, list[bytes]] = defaultdict(list)
        for w in owners:
            by_length[len(w) // 8].append(w)
        for n, ws in sorted(by_length.items()):
            matrix = np.frombuffer(b"".join(ws), np.uint64).reshape(-1, n)
            self.groups.append((np.searchsorted(self.alphabet, matrix) + 1, [tuple(sorted(owners[w])) for w in ws]))
        self.shortest = min(by_length, default=0)


class Shard:
    """Symbols of a shard's documents and where each stands."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.clear()

    def clear(self) -> None:
        self.ids: list = []
        self.n_words: list[int] = []
        self.extra: list = []
        self.symbols, self.words, self.docs, self.size = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.full(1, -1)], 1

    def add(self, arr: pa.Array) -> None:
        w = self.windows
        for a, b, h, rows in words_of(arr):
            first = len(self.n_words)
            self.n_words += np.diff(rows).tolist()
            if not len(w.alphabet) or not len(h):
                continue
            at = np.minimum(np.searchsorted(w.alphabet, h), len(w.alphabet) - 1)
            sym = np.where(w.alphabet[at] == h, at + 1, 0)
            # Runs of the alphabet's words within a document that are long enough for the shortest window.
            doc = np.repeat(np.arange(b - a), np.diff(rows))
            known = sym > 0
            cut = np.ones(len(sym), bool)
            cut[1:] = (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])
            start = np.flatnonzero(cut)
            length = np.diff(np.append(start, len(sym)))
            keep = np.repeat(known[start] & (length >= w.shortest), length)
            if not keep.any():
                continue
            index = np.flatnonzero(keep)
            last = np.flatnonzero(np.append(np.diff(index) != 1, True) | np.append(doc[index[1:]] != doc[index[:-1]], True))
            put = last + 1
            self.symbols.append(np.insert(sym[index], put, 0))
            self.words.append(np.insert(index - rows[doc[index]], put, -1))
            self.docs.append(np.insert(doc[index] + first, put, -1))
            self.size += len(index) + len(put)

    def hits(self) -> tuple[list[list[dict]], list[list[str]]]:
        """Merged spans of words and the sorted test items of each document of the shard."""
        spans: list[list[dict]] = [[] for _ in self.n_words]
        items: list[list[str]] = [[] for _ in self.n_words]
        if self.size == 1:
            return spans, items
        symbols, words, docs = map(np.concatenate, (self.symbols, self.words, self.docs))
        index = FMIndex(symbols, len(self.windows.alphabet) + 1)
        at_doc, at_start, at_end, owned = [], [], [], set()
        for phrases, owners in self.windows.groups:
            lo, hi = index.search(phrases)
            found = np.flatnonzero(hi > lo)
            if not len(found):
                continue
            which = np.repeat(found, (hi - lo)[found])
            rows = np.concatenate([np.arange(x, y) for x, y in zip(lo[found].tolist(), hi[found].tolist(), strict=True)])
            at = index.locate(rows)
            at_doc.append(docs[at])
            at_start.append(words[at])
            at_end.append(words[at] + phrases.shape[1])
            pairs = np.unique(docs[at] * len(owners) + which)
            owned.update((p // len(owners), name) for p in pairs.tolist() for name in owners[p % len(owners)])
        if at_doc:
            doc, start, end = map(np.concatenate, (at_doc, at_start, at_end))
            shift = int(end.max()) + 1
            s, e = covered(doc * shift + start, doc * shift + end)
            for d, x, y in zip((s // shift).tolist(), (s % shift).tolist(), (e - s).tolist(), strict=True):
                spans[d].append({"start": x, "end": x + y})
        for d, name in owned:
            items[d].append(name)
        return spans, [sorted(x) for x in items]


def _pass(broadcast, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = Shard(broadcast.value), []

        def flush() -> Iterator[pa.RecordBatch]:
            spans, items = shard.hits()
            at = 0
            for b in held:
                part_s, part_i = spans[at : at + b.num_rows], items[at : at + b.num_rows]
                n = pa.array(shard.n_words[at : at + b.num_rows], pa.int64())
                at += b.num_rows
                old_s, old_i = column(b, "spans").to_pylist(), column(b, "item_ids").to_pylist()
                got_s = [merged(x + y) if x and y else x or y for x, y in zip(old_s, part_s, strict=True)]
                got_i = [sorted({*x, *y}) if x and y else x or y for x, y in zip(old_i, part_i, strict=True)]
                cols = {"id": column(b, "id"), "text": column(b, "text"), "n_words": n, "spans": got_s, "item_ids": got_i}
                yield pa.RecordBatch.from_arrays([cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], f.type) for f in schema], schema=schema)
            shard.clear()
            held.clear()

        for batch in batches:
            shard.add(column(batch, "text"))
            held.append(batch if "text" in schema.names else batch.drop_columns(["text"]).append_column("text", pa.nulls(batch.num_rows)))
            if shard.size >= SHARD_SYMBOLS or len(shard.n_words) >= SHARD_ROWS or sum(b.nbytes for b in held) >= SHARD_BYTES:
                yield from flush()
        if held:
            yield from flush()

    return run


def merged(spans: list[dict]) -> list[dict]:
    s, e = covered(np.array([x["start"] for x in spans]), np.array([x["end"] for x in spans]))
    return [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row for each row of docs: id[, text], n_words, merged hit spans (word positions, end exclusive), item_ids."""
    spark = docs.sparkSession
    arrow_batches(spark)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    blocks = int(size // BLOCK_BYTES) + 1
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("long").alias("n_words"), F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("item_ids"))
    id_type = out.schema["id"].dataType
    for k in range(blocks):
        some = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        held = spark.sparkContext.broadcast(Windows([tuple(r) for r in some.collect()], window))
        names = ["id", *(["text"] if with_text or k < blocks - 1 else []), "n_words", "spans", "item_ids"]
        kinds = {"text": "string", "n_words": "bigint", "spans": _SPANS, "item_ids": "array<string>"}
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        arrow = {"id": _arrow_type(id_type), "text": pa.string(), "n_words": pa.int64(), "spans": pa.list_(span), "item_ids": pa.list_(pa.string())}
        schema = pa.schema([(n, arrow[n]) for n in names])
        out = out.mapInArrow(_pass(held, schema), ", ".join(f"{n} {kinds.get(n, id_type.simpleString())}" for n in names))
    return out.withColumnRenamed("id", id_col)


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and the verdict: at least a twentieth of the words hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]).cast("long"))
    return found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("item_ids").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(decontaminate(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text")))
    digest = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")
