"""Exact substring dedup over bytes by suffix sorting.

Every byte that lies in a string of `size` bytes that also starts anywhere else,
in the same text or another, is removed; all strings are judged on the input.
Candidates meet as segments around shared anchors (`repeats`). Within a group the
suffixes from the anchor on, and the reversed prefixes before it, are sorted by
deep-shallow sorting: three-way multikey quicksort on eight bytes at a time over
SHALLOW bytes, to the right of the anchor those behind its GRAM bytes, which all
members share; then a blind trie orders each part that is still equal. A window
repeats if some other one agrees with it both ways, which common prefix lengths
of neighbours in the two orders tell for all windows at once.

Defined cases: a null or empty text has no bytes and keeps none; a text shorter
than `size` keeps all; a null id counts as the smallest; repeated rows repeat
each other; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.repeats import Block, Repeats
from factloom.llm.shared import arrow_batches, read, spread
from factloom.llm.textnp import chunks, column, covered, gather, prefix, utf8

SIZE = 400
GRAM = 64
#: Bytes, beyond those known to be equal, over which multikey quicksort goes before blind tries take over.
SHALLOW = 32
_STEP = 8
NULL_ID = -(1 << 63)


def common(x: bytes, y: bytes, start: int = 0) -> int:
    """Length of the longest common prefix, known to be at least start."""
    n = min(len(x), len(y))
    if x[start:n] == y[start:n]:
        return n
    lo, hi = start, n
    while hi - lo > 8:
        mid = (lo + hi) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    while x[lo] == y[lo]:
        lo += 1
    return lo


class _Node:
    """Inner node of a blind trie: texts below it agree up to `at`, where they branch by their byte (-1 at an end)."""

    __slots__ = ("at", "below")

    def __init__(self, at: int):
        self.at = at
        self.below: dict[int, _Node | list[int]] = {}


def _byte(x: bytes, at: int) -> int:
    return x[at] if at < len(x) else -1


def blind_order(texts: list[bytes], some: list[int], depth: int) -> list[int]:
    """Order of texts that agree to depth, by inserting them into a blind trie."""
    root: _Node | list[int] = [some[0]]
    for i in some[1:]:
        x = texts[i]
        node = root
        while isinstance(node, _Node):  # blind: follow the branches without comparing what they skip
            node = node.below.get(_byte(x, node.at)) or next(iter(node.below.values()))
        y = texts[node[0]]
        n = common(x, y, depth)
        if n == len(x) == len(y):
            node.append(i)
            continue
        above, key, node = None, 0, root
        while isinstance(node, _Node) and node.at < n:
            above, key = node, _byte(x, node.at)
            node = node.below[key]
        if isinstance(node, _Node) and node.at == n:
            node.below[_byte(x, n)] = [i]
            continue
        fresh = _Node(n)
        fresh.below[_byte(y, n)] = node
        fresh.below[_byte(x, n)] = [i]
        if above is None:
            root = fresh
        else:
            above.below[key] = fresh
    out: list[int] = []
    stack: list[_Node | list[int]] = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Node):
            stack += [node.below[k] for k in sorted(node.below, reverse=True)]
        else:
            out += node
    return out


class Suffixes:
    """Texts within a buffer of bytes: where each starts and how long it is."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.data, self.start, self.length = np.append(data, np.zeros(_STEP, np.uint8)), start, length
        raw = data.tobytes()
        self.texts = [raw[a : a + n] for a, n in zip(start.tolist(), length.tolist(), strict=True)]

    def word(self, some: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of some texts that follow a depth in each as one number, and how many they are."""
        rest = np.clip(self.length[some] - depth, 0, _STEP)
        at = np.where(rest > 0, self.start[some] + depth, 0)
        out = np.zeros(len(some), np.uint64)
        for k in range(_STEP):
            out = (out << np.uint64(8)) | np.where(k < rest, self.data[at + k], 0).astype(np.uint64)
        return out, rest


def multikey(suffixes: Suffixes, group: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The shallow half: texts of each group, which agree on `known` bytes, by three-way multikey quicksort over SHALLOW bytes more.

    Returns their order and where a new part starts in it; texts of one part agree to the full depth. In each round every part is
    split by the word of its middle text in smaller, equal and larger ones, and equal ones go on a word deeper: parts of all
    groups at once, each at its own depth."""
    order = np.argsort(group, kind="stable")
    cut = np.ones(len(order), bool)
    cut[1:] = group[order[1:]] != group[order[:-1]]
    depth = np.full(len(order), known, np.int64)
    word, rest = suffixes.word(order, depth)
    while True:
        part = np.cumsum(cut) - 1
        size = np.bincount(part, minlength=1)
        open_ = np.flatnonzero((size[part] > 1) & (depth < known + SHALLOW))
        if not len(open_):
            return order, cut
        part = part[open_]
        pivot = (np.flatnonzero(cut) + size // 2)[part]
        w, r = word[open_], rest[open_]
        side = np.where(w == word[pivot], np.sign(r - rest[pivot]) + 1, np.where(w > word[pivot], 2, 0))
        by = np.argsort(part * 3 + side, kind="stable")
        for x in (order, word, rest):
            x[open_] = x[open_[by]]
        side = side[by]
        cut[open_[1:]] |= (part[1:] == part[:-1]) & (side[1:] != side[:-1])
        equal = open_[side == 1]
        depth[equal] += _STEP
        word[equal], rest[equal] = suffixes.word(order[equal], depth[equal])


def deep_shallow(suffixes: Suffixes, group: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the texts of each group, which agree on `known` bytes, and the common prefix length of each with the one
    before (-1 for a group's first): multikey quicksort first, then a blind trie for each part that is left with several texts."""
    order, cut = multikey(suffixes, group, known)
    heads = np.ones(len(order), bool)
    heads[1:] = group[order[1:]] != group[order[:-1]]
    texts = suffixes.texts
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(order))
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        order[a:b] = blind_order(texts, order[a:b].tolist(), known + SHALLOW)
    lcp = np.full(len(order), -1, np.int64)
    where = np.flatnonzero(~heads)
    lcp[where] = [common(texts[x], texts[y], known) for x, y in zip(order[where - 1].tolist(), order[where].tolist(), strict=True)]
    return order, lcp


def same_anchors(block: Block, gram: int) -> bool:
    """Whether the members of each key do share their anchor's bytes, and not only its hash."""
    at = block.off[:-1] + block.anchor
    if not len(at) or int((block.off[1:] - at).min()) < gram:
        return False
    head = np.flatnonzero(np.append(True, np.diff(block.group) != 0))[block.group]  # groups are numbered in the order of the members
    bytes_ = np.lib.stride_tricks.sliding_window_view(block.data, gram)
    return bool((bytes_[at] == bytes_[at[head]]).all())


def compare(block: Block, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the block's members that another member of their key holds too."""
    start, length = block.off[:-1], np.diff(block.off)
    known = gram if same_anchors(block, gram) else 0
    order_r, lcp_r = deep_shallow(Suffixes(block.data, start + block.anchor, length - block.anchor), block.group, known)
    order_l, lcp_l = deep_shallow(Suffixes(block.data[::-1], len(block.data) - start - block.anchor, block.anchor), block.group)
    many = np.bincount(block.group)[block.group] > 2
    out = [_of_pairs(block, size, order_r, lcp_r, order_l, lcp_l, many)] + ([_of_groups(block, size, order_r, lcp_r, order_l, lcp_l, many)] if many.any() else [])
    row, before, after = (np.concatenate(x) for x in zip(*out, strict=True))
    return row, before, after, np.zeros(len(row), np.int64)


def _of_pairs(block: Block, size: int, order_r, lcp_r, order_l, lcp_l, many) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of two members: what both prefix lengths leave is one range."""
    right, left = np.empty(len(many), np.int64), np.empty(len(many), np.int64)
    right[order_r], left[order_l] = lcp_r, lcp_l
    first = np.flatnonzero(~many)[::2]  # members of a key stand together
    second = first + 1
    n_r, n_l = np.maximum(right[first], right[second]), np.maximum(left[first], left[second])
    lo = np.maximum(size - n_r, np.maximum(block.before[first], block.before[second]))
    hi = np.minimum(n_l, np.minimum(block.after[first], block.after[second]))
    some = lo <= hi
    return np.concatenate([first[some], second[some]]), np.tile(lo[some], 2), np.tile(hi[some], 2)


def _of_groups(block: Block, size: int, order_r, lcp_r, order_l, lcp_l, many) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of more: at each offset, members that neighbours' prefix lengths join in both orders are alike."""
    rows = np.flatnonzero(many)
    place = np.cumsum(many) - 1
    keep_r, keep_l = many[order_r], many[order_l]
    right, left, lcp_r, lcp_l = place[order_r[keep_r]], place[order_l[keep_l]], lcp_r[keep_r], lcp_l[keep_l]
    low, high = block.before[rows], block.after[rows]
    first, last = int(low.min()), int(high.max())
    hit = np.zeros((len(rows), last - first + 3), np.int8)  # an empty column at each end
    r, le = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for o in range(first, last + 1):
        some = np.flatnonzero((low <= o) & (o <= high))
        if len(some) < 2:
            continue
        r[right], le[left] = np.cumsum(lcp_r < size - o), np.cumsum(lcp_l < o)
        pair = (r * (len(rows) + 1) + le)[some]
        by = np.argsort(pair)
        same = np.diff(pair[by]) == 0
        alike = np.append(same, False) | np.append(False, same)
        hit[some[by[alike]], o - first + 1] = 1
    edge = np.diff(hit, axis=1)
    row, x = np.nonzero(edge == 1)
    return rows[row], first + x, first + np.nonzero(edge == -1)[1] - 1


def byte_units(arr: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    buf, off = utf8(arr)
    for a, b in chunks(off):
        part = buf[off[a] : off[b]]
        yield a, b, prefix(part), prefix(part, 1), off[a : b + 1] - off[a]


def byte_cut(arr: pa.Array):
    buf, off = utf8(arr)

    def take(row: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return buf[gather(off[row] + lo, end - lo)], np.append(0, np.cumsum(end - lo))

    return take


def _removing(size: int):
    names = ["id", "n_bytes", "spans", "kept"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(column(batch, "text"))
            spans, kept = [], []
            for i, windows in enumerate(column(batch, "windows").to_pylist()):
                text = buf[off[i] : off[i + 1]]
                if not windows:
                    spans.append([])
                    kept.append(text.tobytes())
                    continue
                s, e = covered(np.array([w["lo"] for w in windows]), np.array([w["hi"] + size for w in windows]))
                keep = np.ones(len(text), bool)
                for x, y in zip(s.tolist(), e.tolist(), strict=True):
                    keep[x:y] = False
                spans.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)])
                kept.append(text[keep].tobytes())
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(np.diff(off)), pa.array(spans, span), pa.array(kept, pa.binary())], names=names)

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of texts by id and a hash of the text, which tells rows of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def shown(id_col: F.Column) -> F.Column:
    return F.when(id_col != NULL_ID, id_col)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """One row for each row of docs: id, n_bytes, removed spans (byte positions, end exclusive), kept bytes."""
    arrow_batches(docs.sparkSession)
    texts = keyed(docs, id_col, text_col)
    found = Repeats(size=size, gram=gram, units=byte_units, cut=byte_cut, compare=lambda b: compare(b, size, gram), part=lambda t, x, y: t[x:y], earlier=False).find(texts)
    rows = texts.join(found.hint("shuffle_hash"), ["id", "text_key"], "left").select("id", "text", "windows")
    out = rows.mapInArrow(_removing(size), "id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    return out.select(shown(F.col("id")).alias(id_col), "n_bytes", "spans", "kept")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spread(read(spark, sf_dir, "documents", "doc_id", "text")))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]).cast("long"))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
