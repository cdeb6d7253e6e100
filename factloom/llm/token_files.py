"""Token files: Arrow streams of fixed-size-list batches.

Documents are dealt by ranges of their id, encoded, and packed one after the
other, each closed by an end id, into sequences of equal length. Each range is
one file or several, each an Arrow IPC stream whose batches hold, for every
sequence,

  input_ids  fixed_size_list<uint16 or uint32>[length]
  mask       fixed_size_list<bool>[length]   false where the last sequence is padded
  last       fixed_size_list<bool>[length]   true at the last id of a document
  doc_ids    list<int64>                     the documents that end in it

so that a reader maps a file into memory and takes sequence k as a slice of the
child array, without a copy. Files have names of their own for each attempt of a
task, and a manifest, written by Spark once all tasks are done, lists those that
count: a task that runs again or twice changes nothing. The folder must be one
that all executors reach, given as a path or a URI of a scheme that
pyarrow.fs.FileSystem.from_uri knows (file, hdfs, s3, gs).

Defined cases: null and empty texts are the end id alone; null ids come first;
rows with equal ids follow each other by text; an empty table gives no files and
no rows; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.pretokens import Encoder
from factloom.llm.bpe import byte_letters
from factloom.llm.shared import arrow_batches, fresh_path, read, stored
from factloom.llm.textnp import column

VOCABULARY = "byte_bpe_50k.json"
SEQUENCE = 2048
#: Sequences in one record batch.
BATCH_SEQUENCES = 64
#: Bytes of text for one file.
FILE_BYTES = 24 << 20
#: Most ranges of ids that are dealt out, and ranges whose starts are summed in one task.
RANGES, GROUP = 50_000, 1000


#: Most pieces that a worker keeps with their ids.
KEPT_PIECES = 1_000_000


class LibraryEncoder(Encoder):
    """Encodes with the tokenizers library; each distinct piece once in a worker, up to KEPT_PIECES."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.model = self.tokenizer.model
        shown = byte_letters()
        self.shown = np.array([ord(shown[b]) for b in range(256)], np.uint16)
        super().__init__(self.pieces, {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}, KEPT_PIECES)

    def pieces(self, texts: list[str]) -> list[list[int]]:
        tokenize = self.model.tokenize
        data = list(map(str.encode, texts))
        letters = self.shown[np.frombuffer(b"".join(data), np.uint8)].tobytes().decode("utf-16-le")  # one a byte
        ends = list(accumulate(map(len, data), initial=0))
        return [[t.id for t in tokenize(letters[a:b])] for a, b in zip(ends, ends[1:], strict=False)]


_made: dict[tuple[int, str], LibraryEncoder] = {}


def library_encoder(file: str, run: str) -> LibraryEncoder:
    """One for each worker and run: what one task encoded serves the worker's later tasks of that run, and no other run."""
    key = hash(file), run
    if key not in _made:
        _made.clear()
        _made[key] = LibraryEncoder(file)
    return _made[key]


def file_schema(length: int, wide: bool) -> pa.Schema:
    flags = pa.list_(pa.bool_(), length)
    return pa.schema([("input_ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", flags), ("last", flags), ("doc_ids", pa.list_(pa.int64()))])


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class SequenceWriter:
    """Packs documents into sequences and writes them batch by batch."""

    def __init__(self, sink, length: int, wide: bool):
        self.schema, self.length = file_schema(length, wide), length
        self.kind = np.uint32 if wide else np.uint16
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.ids, self.last, self.docs, self.held, self.total = [], [], [], 0, 0

    def add(self, tokens: np.ndarray, last: np.ndarray, docs: list) -> None:
        self.ids.append(tokens.astype(self.kind))
        self.last.append(last)
        self.docs += docs
        self.held += len(tokens)
        self.total += len(tokens)
        if self.held >= self.length * BATCH_SEQUENCES:
            self.flush(False)

    def flush(self, close: bool) -> None:
        ids, last = np.concatenate([*self.ids, np.zeros(0, self.kind)]), np.concatenate([*self.last, np.zeros(0, bool)])
        n = len(ids) // self.length * self.length
        if close and n < len(ids):
            n += self.length
        real = min(n, len(ids))
        for a in range(0, n, self.length * BATCH_SEQUENCES):
            b = min(n, a + self.length * BATCH_SEQUENCES)
            self.write(ids[a:b], last[a:b], b - a)
        self.ids, self.last, self.held = [ids[real:]], [last[real:]], len(ids) - real

    def write(self, ids: np.ndarray, last: np.ndarray, size: int) -> None:
        pad = size - len(ids)
        mask = np.ones(size, bool)
        mask[size - pad :] = False
        ids, last = np.pad(ids, (0, pad)), np.pad(last, (0, pad))
        ends = last.reshape(-1, self.length).sum(axis=1)
        some, self.docs = self.docs[: int(ends.sum())], self.docs[int(ends.sum()) :]
        docs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ends)]).astype(np.int32)), pa.array(some, pa.int64()))
        fixed = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask, last)]
        self.writer.write_batch(pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([*fixed, docs], self.schema, strict=True)], schema=self.schema))

    def close(self) -> None:
        self.flush(True)
        self.writer.close()


def documents_in(reader: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, int, int]]:
    """doc id, start in the file, ids, crc32 of the ids as little-endian unsigned 32-bit integers."""
    at = start = crc = 0
    for batch in reader:
        ids = batch.column(0).flatten().to_numpy().astype("<u4")
        n = int(np.count_nonzero(batch.column(1).flatten().to_numpy(zero_copy_only=False)))
        ends = np.flatnonzero(batch.column(2).flatten().to_numpy(zero_copy_only=False)) + 1
        a = 0
        for doc, b in zip(batch.column(3).flatten().to_pylist(), ends.tolist(), strict=True):
            yield doc, start, at + b - start, zlib.crc32(ids[a:b], crc)
            a, start, crc = b, at + b, 0
        crc = zlib.crc32(ids[a:n], crc)
        at += n


def _writing(broadcast, folder: str, length: int, end_id: int, wide: bool, file_bytes: int):
    schema = pa.schema([("range", pa.int64()), ("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = filesystem(folder)
        encoder, part, writer, sink, n_docs, n_bytes = None, 0, None, None, 0, 0

        def closed() -> pa.RecordBatch:
            writer.close()
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (context.partitionId(), part, f"{folder}/{name}", n_docs, writer.total)], schema=schema)

        for batch in batches:
            encoder = encoder or library_encoder(broadcast.value, folder)
            docs, texts = column(batch, "id").to_pylist(), column(batch, "text")
            for a, b, tokens, rows in encoder(texts):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    name = f"range-{context.partitionId():06d}-{part:05d}-{context.taskAttemptId()}.arrows"
                    sink = fs.open_output_stream(f"{root}/{name}")
                    writer, n_docs, n_bytes = SequenceWriter(sink, length, wide), 0, 0
                n = np.diff(rows)
                ends = np.cumsum(n + 1) - 1
                out = np.full(len(tokens) + b - a, end_id, np.uint32)
                last = np.zeros(len(out), bool)
                last[ends] = True
                out[~last] = tokens
                writer.add(out, last, docs[a:b])
                n_docs += b - a
                n_bytes += texts[a:b].nbytes
                if n_bytes >= file_bytes:
                    yield closed()
                    part, writer = part + 1, None
        if writer is not None:
            yield closed()

    return run


def write_sequences(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """Writes the files and returns the manifest: path, n_docs, n_tokens and start, the ids before the file, and its place by range
    and part. Only files in the manifest count: a task that ran twice or was lost may leave others, with names of their own."""
    spark = docs.sparkSession
    arrow_batches(spark)
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        file = f.read()
    from tokenizers import Tokenizer

    wide = Tokenizer.from_str(file).get_vocab_size(with_added_tokens=True) > 1 << 16 or end_id >= 1 << 16
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = int(rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0)
    # A range is one task. The driver samples ids for every range, so beyond RANGES of them ranges grow and hold several files each.
    ranges = size // max(FILE_BYTES, size // RANGES, 1) + 1
    ranged = rows.repartitionByRange(ranges, "id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    made = ranged.mapInArrow(_writing(spark.sparkContext.broadcast(file), folder, length, end_id, wide, FILE_BYTES), "range long, part long, path string, n_docs long, n_tokens long")
    made = stored(made, "manifest")
    # Starts in two steps: over groups of ranges in one task, a row for each group, then within each group.
    group = F.floor(F.col("range") / GROUP)
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = made.groupBy(group.alias("group")).agg(F.sum("n_tokens").alias("tokens"))
    sums = sums.select("group", F.coalesce(F.sum("tokens").over(before(["group"])), F.lit(0)).alias("ahead"))
    within = made.withColumn("group", group).withColumn("inner", F.coalesce(F.sum("n_tokens").over(before("group", ["range", "part"])), F.lit(0)))
    return within.join(sums, "group").select("range", "part", "path", "n_docs", "n_tokens", (F.col("ahead") + F.col("inner")).alias("start"))


def read_documents(manifest: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Reads the files back: doc id, start over all files, n_tokens, ids_crc32."""
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(column(batch, "path").to_pylist(), column(batch, "start").to_pylist(), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_stream(name) as source, pa.ipc.open_stream(source) as reader:
                    rows: list[tuple] = []
                    for doc, start, n, crc in documents_in(reader):
                        rows.append((doc, base + start, n, crc))
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=schema)

    files = manifest.count()
    dealt = manifest.select("path", "start").repartition(max(1, min(files, RANGES)), "path")
    return dealt.select("path", "start").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_sequences(read(spark, sf_dir, "documents", "doc_id", "text"), fresh_path(spark, "tokens"))
    return read_documents(manifest)
