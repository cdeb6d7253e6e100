"""Repeated windows over a whole corpus, found through anchors and shuffled hashes.

A window is a run of `size` units (bytes or words) of one text. Each window has
an anchor: the `gram` of units in it whose hash is smallest, the first of equal
ones. Equal windows have equal anchors at equal offsets, so whatever repeats
meets under its anchor's key. Neighbouring windows with one anchor are a
segment, a few rows for each thousand units of text.

  anchors   every text, in one scan: key and segment hash of each segment
  repeated  segments whose anchor key occurs twice or more (counted map-side)
  members   for each distinct segment under such a key one row that holds it, and
            a second one if there are more; their text is cut out and compared,
            many keys at a time. What holds for them holds for all further copies,
            which are equal in both 61-bit hashes and so the same string.
  split     a key with over `GROUP` members is not one group: its windows are
            dealt to halves by how far ahead of the anchor they start, and each
            half is keyed by the units that all its windows share, until groups
            are small. A half of one window is itself its key, and two rows stand
            for it, so this ends, with nothing dropped.

Groups never hold more than GROUP members; hot keys are counted by partial
aggregation and joined where Spark can split them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import arrow_batches, stored
from factloom.llm.textnp import column, span_hash, utf8

#: Most members under one key that are compared with each other.
GROUP = 2000
#: Bytes of members that a task compares at once, whole keys at a time; bytes of text that it cuts out at once.
BLOCK_BYTES = 3 << 20
_POSITION = np.uint64((1 << 28) - 1)


def segments(sums: np.ndarray, other: np.ndarray, off: np.ndarray, size: int, gram: int) -> dict[str, np.ndarray]:
    """Segments of some texts given prefix sums of two hashes of their units.

    Returns row, lo and hi (first and last window), at (the anchor), all in units of the text, and the two keys."""
    n = len(sums) - 1
    wide = size - gram + 1
    starts = n - size + 1
    empty = np.zeros(0, np.int64)
    if starts <= 0:
        return dict(row=empty, lo=empty, hi=empty, at=empty, key=empty.view(np.uint64), hull=empty.view(np.uint64))
    i = np.arange(n - gram + 1)
    keys = span_hash(sums, i, i + gram)
    best = (keys & ~_POSITION) | i.astype(np.uint64)
    span = 1
    while span * 2 <= wide:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if wide > span:
        best = np.minimum(best[: len(best) - (wide - span)], best[wide - span :])
    chosen = (best[:starts] & _POSITION).astype(np.int64)
    length = np.diff(off)
    valid = np.zeros(starts + 1, np.int32)  # windows within one text
    ok = length >= size
    np.add.at(valid, off[:-1][ok], 1)
    np.add.at(valid, (off[1:] - size + 1)[ok], -1)
    inside = np.cumsum(valid)[:starts] > 0
    cut = np.ones(starts, bool)
    cut[1:] = (chosen[1:] != chosen[:-1]) | (inside[1:] != inside[:-1])
    heads = off[:-1][ok]
    cut[heads] = True
    first = np.flatnonzero(cut)
    last = np.append(first[1:], starts) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    row = np.searchsorted(off, first, "right") - 1
    zero, at = off[row], chosen[first]
    return dict(row=row, lo=first - zero, hi=last - zero, at=at - zero, key=keys[at], hull=span_hash(other, first, last + size, 1))


#: Prepares some rows of text: prefix sums in both bases of hashes of units, and the unit offsets of the rows.
Units = Callable[[pa.Array], Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]]
#: Cuts units out of some texts: (texts) to a function of (row, from, to), arrays, that gives bytes and their offsets.
Cut = Callable[[pa.Array], Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]

_ANCHORS = "id long, text_key long, key long, hull long, lo int, hi int, at int"


def _anchoring(units: Units, size: int, gram: int):
    names = ["id", "text_key", "key", "hull", "lo", "hi", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text_keys = column(batch, "id").to_numpy(), column(batch, "text_key").to_numpy()
            for a, _, sums, other, off in units(column(batch, "text")):
                s = segments(sums, other, off, size, gram)
                if len(s["row"]):
                    row = s["row"] + a
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(text_keys[row]), pa.array(s["key"].view(np.int64)), pa.array(s["hull"].view(np.int64)), *(pa.array(s[c].astype(np.int32)) for c in ("lo", "hi", "at"))], names=names)

    return run


#: A row that holds a segment under a key. Its windows start `before` to `after` units ahead of the anchor (the least and the
#: most); `content` is its units, the anchor at unit `anchor`. Only rows with an id under `below` count as
#: earlier: the row's own, or, for the second row of a segment that has several, just over the first one's, so that what is found
#: holds for all rows between the two.
_MEMBERS = "key long, hull long, id long, below long, before int, after int, content binary, anchor int"
_MEMBER_FIELDS = [("key", pa.int64()), ("hull", pa.int64()), ("id", pa.int64()), ("below", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("content", pa.binary()), ("anchor", pa.int32())]
#: Windows of a segment that repeat, by how far ahead of the anchor they start, and an id of a row that holds them.
_FOUND = "key long, hull long, before int, after int, witness long"


def binary(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _cutting(cut: Cut, size: int):
    schema = pa.schema(_MEMBER_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "members")
            rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            m = {f.name: flat.field(k) for k, f in enumerate(flat.type)}
            lo, hi, at = (m[c].to_numpy().astype(np.int64) for c in ("lo", "hi", "at"))
            take = cut(column(batch, "text"))
            held = np.cumsum(hi - lo + size)
            a = 0
            while a < len(rows):  # of a very long text a part at a time
                b = max(a + 1, int(np.searchsorted(held, (held[a - 1] if a else 0) + BLOCK_BYTES // 8, "right")))
                content = binary(*take(rows[a:b], lo[a:b], hi[a:b] + size))
                ends = [pa.array((at - hi)[a:b].astype(np.int32)), pa.array((at - lo)[a:b].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(m[c][a:b] for c in ("key", "hull", "id", "below")), *ends, content, ends[1]], schema=schema)
                a = b

    return run


class Block:
    """Members of some keys, whole keys at a time and sorted by key: columns as arrays, contents as bytes and offsets."""

    def __init__(self, batch: pa.RecordBatch):
        number = lambda name: column(batch, name).to_numpy(zero_copy_only=False).astype(np.int64)
        self.key, self.id, self.below, self.before, self.after, self.anchor = (number(c) for c in ("key", "id", "below", "before", "after", "anchor"))
        self.data, self.off = utf8(column(batch, "content"))
        self.group = np.cumsum(np.append(False, self.key[1:] != self.key[:-1])) if len(self.key) else self.key


#: Compares the members of a block: row, before, after and witness of windows that repeat, as arrays.
Compare = Callable[[Block], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _comparing(compare: Compare):
    kinds = {"before": pa.int32(), "after": pa.int32(), "witness": pa.int64()}

    def out(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = column(batch, "key").to_numpy()
        alone = np.ones(len(keys), bool)  # nothing to compare with
        same = keys[1:] == keys[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        batch = batch.filter(pa.array(~alone))
        if batch.num_rows:
            row, *found = compare(Block(batch))
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(row)) for k in (0, 1)] + [pa.array(x, k) for x, k in zip(found, kinds.values(), strict=True)], names=["key", "hull", *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # sorted by key; a key may go on in the next batch
            held.append(batch)
            if sum(b.nbytes for b in held) >= BLOCK_BYTES:
                whole = pa.concat_batches(held)
                keys = column(whole, "key").to_numpy()
                end = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
                if end:
                    yield from out(whole.slice(0, end))
                held = [whole.slice(end)]
        if held:
            yield from out(pa.concat_batches(held))

    return run


#: A part of the units of a segment's content: (content, from, to).
Part = Callable[[bytes, int, int], bytes]


def _halving(part: Part, size: int, width: int):
    """Deals each segment's windows to cells of `width` offsets from the anchor."""
    schema = pa.schema([*_MEMBER_FIELDS, ("parent_key", pa.int64()), ("parent_hull", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for cell in range(r["before"] // width, r["after"] // width + 1):
                    x, y, anchor = cell * width, cell * width + width - 1, r["anchor"]
                    before, after = max(x, r["before"]), min(y, r["after"])
                    content = part(r["content"], anchor - after, anchor - before + size)
                    key = hash_bytes(part(r["content"], anchor - x, anchor - y + size), r["key"] ^ cell)
                    rows.append((key, hash_bytes(content, before), r["id"], r["id"], before, after, content, after, r["key"], r["hull"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def hash_bytes(x: bytes, seed: int) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(x, seed & (1 << 64) - 1)
    return h - (1 << 64) if h >= 1 << 63 else h


class Repeats:
    """Finds repeated windows: `earlier` keeps only those that also start in a row with a smaller id."""

    def __init__(self, *, size: int, gram: int, units: Units, cut: Cut, compare: Compare, part: Part, earlier: bool, group: int = GROUP):
        self.size, self.gram, self.units, self.cut, self.compare, self.part = size, gram, units, cut, compare, part
        self.earlier, self.group = earlier, group

    def find(self, texts: DataFrame) -> DataFrame:
        """texts: id long, text string, text_key long. Returns id, text_key and windows array<struct<lo,hi>> (first and last start)."""
        arrow_batches(texts.sparkSession)
        anchors = stored(texts.select("id", "text_key", "text").mapInArrow(_anchoring(self.units, self.size, self.gram), _ANCHORS), "anchors")
        counted = anchors.groupBy("key").agg(F.count("*").alias("rows"), F.min("id").alias("x"), F.max("id").alias("y"))
        twice = counted.where(self._several(F.col("rows"), F.col("x"), F.col("y"))).select("key")
        # Written before the join: a join right above its aggregation cannot have hot keys split.
        repeated = stored(anchors.join(stored(twice, "twice"), "key"), "repeated")
        place = F.struct("id", "text_key", "lo", "hi", "at")
        distinct = repeated.groupBy("key", "hull").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
        several = self._several(F.col("n"), F.col("first.id"), F.col("last.id"))
        rows = distinct.select("key", "hull", "first", F.posexplode(F.when(several, F.array("first", "last")).otherwise(F.array("first"))).alias("k", "row"))
        member = F.struct("key", "hull", F.col("row.id").alias("id"), self._below().alias("below"), F.col("row.lo").alias("lo"), F.col("row.hi").alias("hi"), F.col("row.at").alias("at"))
        wanted = rows.groupBy(F.col("row.id").alias("id"), F.col("row.text_key").alias("text_key")).agg(F.collect_list(member).alias("members"))
        held = texts.join(wanted.hint("shuffle_hash"), ["id", "text_key"]).dropDuplicates(["id", "text_key"])  # by the join's own keys
        members = stored(held.select("text", "members").mapInArrow(_cutting(self.cut, self.size), _MEMBERS), "members")
        found = stored(self._resolve(members), "found")
        there = (F.col("id") > F.col("witness")) if self.earlier else F.lit(True)
        lo = F.greatest(F.col("lo"), F.col("at") - F.col("after"))
        hi = F.least(F.col("hi"), F.col("at") - F.col("before"))
        spans = repeated.select("id", "text_key", "key", "hull", "lo", "hi", "at").join(found, ["key", "hull"]).where(there).select("id", "text_key", lo.alias("lo"), hi.alias("hi"))
        return spans.groupBy("id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("windows"))

    def _several(self, n: Column, min_id: Column, max_id: Column) -> Column:
        return min_id < max_id if self.earlier else n > 1

    def _below(self) -> Column:
        return F.col("first.id") + F.col("k") if self.earlier else F.col("row.id")

    def _resolve(self, members: DataFrame, width: int | None = None) -> DataFrame:
        """Found windows among members of the same key; hot keys are halved first. width: of the cells to halve."""
        width = width or 1 << (self.size - self.gram).bit_length()
        sizes = members.groupBy("key").agg(F.count("*").alias("size"))
        hot = stored(sizes.where(F.col("size") > self.group).select("key"), "hot")
        if width == 1 or hot.isEmpty():
            return self._compare(members)
        calm = self._compare(members.join(hot, "key", "left_anti"))
        schema = _MEMBERS + ", parent_key long, parent_hull long"
        halves = stored(members.join(hot, "key").select(*members.columns).mapInArrow(_halving(self.part, self.size, width // 2), schema), "halves")
        row = F.struct("id", "content")
        distinct = halves.groupBy("key", "hull", "before", "after", "anchor").agg(F.count("*").alias("n"), F.min(row).alias("first"), F.max(row).alias("last"))
        several = self._several(F.col("n"), F.col("first.id"), F.col("last.id"))
        rows = distinct.select("key", "hull", "before", "after", "anchor", "first", F.posexplode(F.when(several, F.array("first", "last")).otherwise(F.array("first"))).alias("k", "row"))
        rows = stored(rows.select("key", "hull", F.col("row.id").alias("id"), self._below().alias("below"), "before", "after", F.col("row.content").alias("content"), "anchor"), "distinct")
        met = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
        found = self._resolve(stored(rows.join(met, "key").select(*members.columns), "members"), width // 2)
        back = halves.select("key", "hull", "parent_key", "parent_hull").join(found, ["key", "hull"])
        return calm.unionByName(back.select(F.col("parent_key").alias("key"), F.col("parent_hull").alias("hull"), "before", "after", "witness").distinct())

    def _compare(self, members: DataFrame) -> DataFrame:
        return members.repartition("key").sortWithinPartitions("key").mapInArrow(_comparing(self.compare), _FOUND)
