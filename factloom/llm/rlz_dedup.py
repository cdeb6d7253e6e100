"""Substring dedup over words by relative Lempel-Ziv parsing.

A word is removed if it lies in a window of `size` consecutive words that also
starts in a document with a smaller id; windows are judged on the input.
Texts are cut into segments around anchors (`repeats`), and all segments of some
anchors form a reference block with a suffix array over its words. Each segment
is factored greedily against its block, that is against the only block that can
hold its windows: where the index holds `size` of its words in a document with a
smaller id, the longest such factor becomes a duplicate span; where it ends, the
windows over its boundary are looked up next, since another part of the block
may hold them. Words in between are literals.

Words are maximal runs of anything but space, tab, line feed, vertical tab, form
feed and carriage return. Defined cases: a null or empty text has no words; a
document shorter than `size` words keeps all; a null id counts as the smallest
and is not smaller than itself; rows of one id do not remove each other's words;
other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.repeats import Block, Repeats, binary
from factloom.llm.shared import arrow_batches, read, spread
from factloom.llm.suffix_dedup import keyed, shown
from factloom.llm.textnp import SPACES, chunks, column, covered, gather, prefix, span_hash, utf8, word_spans, word_table

SIZE = 50
GRAM = 10
_BLANKS = bytes.maketrans(SPACES, b" " * len(SPACES))


def word_units(arr: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    buf, off = utf8(arr)
    for a, b in chunks(off):
        part = buf[off[a] : off[b]]
        s, e, rows = word_spans(part, off[a : b + 1] - off[a], word_table(False))
        yield a, b, *(prefix(span_hash(prefix(part, k), s, e, k), k) for k in (0, 1)), rows


def split(text: bytes) -> list[bytes]:
    return text.translate(_BLANKS).split()


def word_cut(arr: pa.Array):
    """Words of texts, joined by one blank."""
    buf, off = utf8(arr)
    s, e, rows = word_spans(buf, off, word_table(False))
    at = np.append(0, np.cumsum(e - s + 1))
    joined = np.full(at[-1], 0x20, np.uint8)
    joined[gather(at[:-1], e - s)] = buf[gather(s, e - s)]

    def take(row: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = at[rows[row] + lo], at[rows[row] + end] - 1
        return joined[gather(x, y - x)], np.append(0, np.cumsum(y - x))

    return take


def word_part(text: bytes, x: int, y: int) -> bytes:
    return b" ".join(text.split(b" ")[x:y])


class Reference:
    """A suffix array over the words of a block of segments, with ranks of all runs of 2**k words from which it was built."""

    def __init__(self, symbols: np.ndarray, owner: np.ndarray):
        """symbols: the words' numbers from 1; a 0 closes each segment. owner: the id of the document that holds each word."""
        n, zeros = len(symbols), symbols == 0
        ends = int(zeros.sum())
        rank = symbols.astype(np.int64) + ends
        rank[zeros] = np.arange(ends)  # each end differs from all others, so no match goes over it
        self.ranks, step = [rank.astype(np.int32)], 1
        while True:
            key = rank * (n + ends + 2)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key)
            new = np.append(0, key[order][1:] != key[order][:-1])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            if rank[order[-1]] == n - 1 or step >= n:
                break
            self.ranks.append(rank.astype(np.int32))
            step *= 2
        self.order, self.place, self.owner = order, rank, owner[order]
        self.lcp = np.append(0, self.common(order[:-1], order[1:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of words that the suffixes at i and j share."""
        i, j, n = i.copy(), j.copy(), len(self.order)
        out = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.ranks))):
            same = (i < n) & (j < n)
            same &= self.ranks[k][np.where(same, i, 0)] == self.ranks[k][np.where(same, j, 0)]
            step = np.where(same, 1 << k, 0)
            out, i, j = out + step, i + step, j + step
        return out

    def known(self, below: np.ndarray, size: int) -> np.ndarray:
        """Positions at which a factor of at least `size` words can start: some document with an id under below holds such words."""
        starts = np.flatnonzero(self.lcp < size)  # runs of the suffix array that agree in so many words
        least = np.minimum.reduceat(self.owner, starts)
        run = np.cumsum(self.lcp < size) - 1
        return least[run[self.place]] < below

    def longest(self, at: np.ndarray, below: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Longest factor at each of some positions among documents with an id under below, and an id that holds it:
        the nearer ones in the suffix array share more, so the next such id on either side decides."""
        length, witness = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for side in (-1, 1):
            live = np.arange(len(at))
            r = self.place[at]
            shared = np.full(len(at), np.iinfo(np.int64).max)
            while len(live):
                edge = r if side < 0 else r + 1
                inside = edge < len(self.lcp)
                shared = np.minimum(shared, np.where(inside, self.lcp[np.where(inside, edge, 0)], 0))
                r = r + side
                on = shared >= size
                live, r, shared = live[on], r[on], shared[on]
                got = self.owner[r] < below[live]
                better = got & (shared > length[live])
                length[live[better]], witness[live[better]] = shared[better], self.owner[r[better]]
                live, r, shared = live[~got], r[~got], shared[~got]
        return length, witness


def parse(block: Block, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of each member that a document with a smaller id holds: greedy factors of all members at once against the block."""
    m = len(block.key)
    closed = np.insert(block.data, block.off[1:], 0x20)  # each word is followed by a blank
    off = block.off + np.arange(m + 1)
    start, _, rows = word_spans(closed, off, word_table(False))
    words = binary(closed, np.append(start, len(closed))).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    symbols = np.insert(words.astype(np.int64) + 1, rows[1:], 0)
    first = rows + np.arange(m + 1)  # of each member among the symbols; the last end closes
    member = np.repeat(np.arange(m), np.diff(first))
    index = Reference(symbols, block.id[member])
    below = block.below[member]
    # The next place at or after each one at which a factor can start.
    known = np.flatnonzero(index.known(below, size))
    out: list[tuple] = []
    live, at = np.arange(m), first[:-1]
    while len(live):
        k = np.searchsorted(known, at)
        some = k < len(known)
        live, at = live[some], known[k[some]]
        inside = at < first[live + 1]
        live, at = live[inside], at[inside]
        length, witness = index.longest(at, below[at], size)
        x = at - first[live]
        # Windows start at x .. x + length - size; ahead of the anchor by anchor - start.
        out.append((live, block.anchor[live] - (x + length - size), block.anchor[live] - x, witness))
        at = at + length - size + 1  # windows over the factor's end are looked up next
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _removing(size: int):
    names = ["id", "n_words", "spans", "kept"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, kept = [], [], []
            for text, windows in zip(column(batch, "text").cast(pa.binary()).to_pylist(), column(batch, "windows").to_pylist(), strict=True):
                words = split(text)
                counts.append(len(words))
                found: list[dict] = []
                if windows:
                    s, e = covered(np.array([w["lo"] for w in windows]), np.array([w["hi"] + size for w in windows]))
                    found = [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                    edges = [0, *(v for f in found for v in (f["start"], f["end"])), len(words)]
                    words = [w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in words[x:y]]
                spans.append(found)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string())], names=names)

    return run


def remove_copied(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """One row for each row of docs: id, n_words, removed spans (word positions, end exclusive), kept words joined by a blank."""
    arrow_batches(docs.sparkSession)
    texts = keyed(docs, id_col, text_col)
    find = Repeats(size=size, gram=gram, units=word_units, cut=word_cut, compare=lambda b: parse(b, size), part=word_part, earlier=True)
    rows = texts.join(find.find(texts).hint("shuffle_hash"), ["id", "text_key"], "left").select("id", "text", "windows")
    out = rows.mapInArrow(_removing(size), "id long, n_words long, spans array<struct<start:int,end:int>>, kept string")
    return out.select(shown(F.col("id")).alias(id_col), "n_words", "spans", "kept")


def op5_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_copied(spread(read(spark, sf_dir, "documents", "doc_id", "text")))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]).cast("long"))
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
