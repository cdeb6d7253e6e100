"""Byte-level BPE: a backtracking encoder and a decoder by offset table.

Texts are split into pieces over arrays (`pretokens`); each distinct piece is
encoded once in a task. An Aho-Corasick automaton finds the longest token at
each position of a piece. The encoder takes it if it is compatible with the
token before, that is if merging by rank could have left the two side by side;
else it tries shorter prefixes, and steps back where none fits. This gives
exactly the ids of merging by rank, in time linear in the text. Decoding copies
bytes from one table of all tokens' bytes by their offsets.

Defined cases: null and empty texts give no ids, no ids give the empty text; a
null list decodes to the empty text; ids outside the vocabulary are skipped;
repeated rows and ids each keep their own row; other columns of the input are
not read. Strings of added tokens in a text become their single id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm.pretokens import Encoder
from factloom.llm.shared import arrow_batches, read, spread
from factloom.llm.textnp import column, gather

VOCABULARY = "byte_bpe_50k.json"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(0x100) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class Vocabulary:
    """Tokens of a byte-level BPE file, and which pairs of them can stand side by side."""

    def __init__(self, file: str):
        data = json.loads(file)
        back = {c: b for b, c in byte_letters().items()}
        vocab = data["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.tokens[i] = word.encode() if word in self.added else bytes(map(back.__getitem__, word))
        for word, i in self.added.items():
            self.tokens[i] = word.encode()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        # Ranks order tokens: single bytes first, then merged tokens in the order of the merges.
        self.merged, self.split, self.rank = {}, {}, {}
        base = len(vocab)
        for k, (x, y) in enumerate(merges):
            a, b, c = vocab[x], vocab[y], vocab[x + y]
            self.merged[a, b] = base + k
            if c not in self.split:
                self.split[c], self.rank[c] = (a, b), base + k
        self.ids = {t.decode("latin-1"): i for i, t in enumerate(self.tokens) if t and (i in self.split or len(t) == 1)}
        self.automaton = ahocorasick.Automaton()
        for word, i in self.ids.items():
            self.automaton.add_word(word, (len(word), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        lengths = np.fromiter(map(len, self.tokens), np.int64, size)
        self.table, self.offsets, self.lengths = np.frombuffer(b"".join(self.tokens), np.uint8), np.cumsum(lengths) - lengths, lengths

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves tokens a and b apart where they meet."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 200_000:
                self.pairs.clear()
            found = self.pairs[a, b] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the latest merge on either side until both are single bytes. The inner pair must never
        # be a merge that comes before the merges that build what stands on its two sides.
        left, right, rank, split = a, b, self.rank, self.split
        limit = 1 << 60
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            x, y = rank.get(left, -1), rank.get(right, -1)
            if x < 0 and y < 0:
                return True
            if x > y:
                limit, left = x, split[left][1]
            else:  # of equal merges the left one comes first
                limit, right = y + 1, split[right][0]

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix, or -1."""
        found = self.shorter.get(token)
        if found is None:
            word = self.tokens[token].decode("latin-1")
            found = self.shorter[token] = next((i for n in range(len(word) - 1, 0, -1) if (i := self.ids.get(word[:n])) is not None), -1)
        return found

    def encode_piece(self, piece: str) -> list[int]:
        text = piece.encode().decode("latin-1")
        whole = self.ids.get(text)
        n = len(text)
        longest, size = [-1] * n, [0] * n
        for end, (length, i) in self.automaton.iter(text):
            at = end + 1 - length
            if length > size[at]:
                size[at], longest[at] = length, i
        if whole is not None and n == 1:
            return [whole]
        out: list[int] = []
        ends: list[int] = []  # where each token of out ends
        dead = bytearray(n + 1)
        pos, token = 0, longest[0]
        while True:
            while token >= 0:
                end = pos + len(self.tokens[token])
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.prefix(token)
            if token >= 0:
                out.append(token)
                ends.append(end)
                if end == n:
                    return out
                pos, token = end, longest[end]
            else:
                dead[pos] = 1
                token = out.pop()
                ends.pop()
                pos = ends[-1] if ends else 0
        return out

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        return [self.encode_piece(p) for p in pieces]

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> pa.Array:
        """Texts of rows of ids; malformed UTF-8 becomes replacement characters."""
        at = np.where(ids < len(self.lengths), ids, 0)
        n = np.where(ids < len(self.lengths), self.lengths[at], 0)
        data = self.table[gather(self.offsets[at], n)]
        off = np.concatenate([[0], np.cumsum(n)])[rows]
        got = pa.Array.from_buffers(pa.large_binary(), len(rows) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data.tobytes())])
        try:
            data.tobytes().decode()
            got = got.cast(pa.large_string())
        except (UnicodeDecodeError, pa.ArrowInvalid):
            got = pa.array([x.decode(errors="replace") for x in got.to_pylist()], pa.large_string())
        return got.cast(pa.string())


_made: dict[int, Vocabulary] = {}


def vocabulary(file: str) -> Vocabulary:
    """One for each worker and file."""
    key = hash(file)
    if key not in _made:
        _made[key] = Vocabulary(file)
    return _made[key]


def _encoding(broadcast, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(broadcast.value)
        encoder = Encoder(v.encode_pieces, v.added)
        for batch in batches:
            ids = column(batch, "id")
            for a, b, tokens, rows in encoder(column(batch, "text")):
                got = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(tokens.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids[a:b], got.cast(schema.field(1).type)], schema=schema)

    return run


def _decoding(broadcast, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(broadcast.value)
        for batch in batches:
            lists = column(batch, "ids")
            if lists.null_count:
                lists = pa.array([x or [] for x in lists.to_pylist()], lists.type)
            rows = np.asarray(lists.offsets).astype(np.int64)
            tokens = np.asarray(lists.values)[rows[0] : rows[-1]] if len(lists) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([v.decode(tokens.astype(np.int64), rows - rows[0]) if f.name == "decoded" else column(batch, f.name) for f in schema], schema=schema)

    return run


def _round_trip(broadcast, schema: pa.Schema):
    encoding, decoding = _encoding(broadcast, pa.schema([schema.field("id"), schema.field("ids")])), _decoding(broadcast, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from decoding(encoding(batches))

    return run


def vocabulary_file(spark: SparkSession, path: str | None):
    """The file's text as a broadcast: its size is that of a vocabulary, whatever the corpus."""
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row (id, ids array<int>) for each row of docs, in one pass without a shuffle."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("ids", pa.list_(pa.int32()))])
    return rows.mapInArrow(_encoding(vocabulary_file(spark, path), schema), f"id {kind.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, *, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """One row (id, ids, decoded string) for each row of ids."""
    spark = encoded.sparkSession
    arrow_batches(spark)
    rows = encoded.select(F.col(id_col).alias("id"), F.col("ids").cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    return rows.mapInArrow(_decoding(vocabulary_file(spark, path), schema), f"id {kind.simpleString()}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row (id, ids, decoded string) for each row of docs: what decode(encode(docs)) gives, but a task holds one Python worker and
    one vocabulary, where the two as stages of one plan hold two."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    return rows.mapInArrow(_round_trip(vocabulary_file(spark, path), schema), f"id {kind.simpleString()}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = round_trip(spread(read(spark, sf_dir, "documents", "doc_id", "text")))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
