"""Near-duplicate documents by min-max hashing, with every link confirmed on full sets.

A document's set holds its distinct shingles of `words` lower-cased words.
Documents with equal sets are one class. Each permutation of a class's shingles
gives two signature values, its minimum and its maximum, so BANDS bands of four
values take two permutations each. Two sets of similarity 0.8 share no band with
probability (1 - 0.8**4)**24, about 3 in a million.

  first   each class is compared with the smallest class that shares a band
          with it; texts meet in groups that are dealt by salt where they are hot
  second  bands whose classes still lie in several components are compared
          without exception: the smaller components' classes, in blocks,
          against all of the band. Distances to a common class rule out most pairs.
  then    components of the confirmed links

Defined cases: a null or empty text, or one without words, has an empty set and
links with nothing; a text of fewer words than a shingle is one shingle; a null
id counts as the smallest; rows that share an id count as one document wherever
that id is a class's smallest; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.graph import components
from factloom.llm.shared import arrow_batches, read, spread, stored
from factloom.llm.suffix_dedup import keyed, shown
from factloom.llm.textnp import chunks, column, fold_table, mix, prefix, set_hash, span_hash, utf8, word_spans, word_table

WORDS = 5
PERCENT = 80
BANDS = 24
#: Texts that one task holds against others at a time.
BLOCK = 500


def sets(arr: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For bounded ranges of rows: first row, end row, the sorted shingle hashes of each row, their offsets."""
    buf, off = utf8(arr)
    for a, b in chunks(off):
        part = fold_table(True)[buf[off[a] : off[b]]]
        s, e, rows = word_spans(part, off[a : b + 1] - off[a], word_table(False))
        sums = prefix(span_hash(prefix(part), s, e))
        n = np.diff(rows)
        count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
        doc = np.repeat(np.arange(b - a), count)
        start = rows[doc] + np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
        h = span_hash(sums, start, start + np.minimum(words, n)[doc])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        yield a, b, h, np.searchsorted(doc, np.arange(b - a + 1))


def bands(h: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """Band keys of non-empty sets: each from the minimum and the maximum under two permutations."""
    seeds = np.random.default_rng(71).integers(1, 1 << 63, (2 * count, 2), dtype=np.int64).astype(np.uint64) | np.uint64(1)
    out = np.empty((len(starts), count), np.uint64)
    for band in range(count):
        key = np.full(len(starts), band, np.uint64)
        for flip, odd in seeds[2 * band : 2 * band + 2]:
            v = (h ^ flip) * odd
            for extreme in (np.minimum, np.maximum):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + extreme.reduceat(v, starts))
        out[:, band] = key
    return out


def _signing(words: int, count: int):
    names = ["id", "text_key", "n", "set_a", "set_b", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = column(batch, "id"), column(batch, "text_key")
            for a, b, h, rows in sets(column(batch, "text"), words):
                n = np.diff(rows)
                some = np.flatnonzero(n)
                starts = rows[:-1][some]
                digest = np.zeros((2, b - a), np.uint64)
                table = np.zeros((b - a, count), np.uint64)
                if len(some):
                    for k in range(2):
                        digest[k][some] = set_hash(h, starts, k)
                    table[some] = bands(h, starts, count)
                lists = pa.ListArray.from_arrays(pa.array((np.arange(b - a + 1) * count).astype(np.int32)), pa.array(table.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids[a:b], keys[a:b], pa.array(n), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), lists], names=names)

    return run


def shared_size(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


def _groups(batches: Iterator[pa.RecordBatch], words: int, keys: list[str]) -> Iterator[tuple[tuple, list[tuple[dict, np.ndarray]]]]:
    """Rows of equal keys that stand together, one at a time with their sets."""
    for batch in batches:
        plain = batch.select([c for c in batch.schema.names if c != "text"]).to_pylist()
        for a, b, h, rows in sets(column(batch, "text"), words):
            for i in range(a, b):
                yield tuple(plain[i][k] for k in keys), (plain[i], h[rows[i - a] : rows[i - a + 1]].copy())


def _against_first(words: int):
    """Each row of a group against the group's first, which is its pivot."""
    names = ["node", "pivot", "both", "either"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivot, out = None, None, []
        for key, (row, h) in _groups(batches, words, ["pivot", "salt"]):
            if key != now:
                now, pivot = key, h
            else:
                both = shared_size(pivot, h)
                out.append((row["node"], row["pivot"], both, len(h) + len(pivot) - both))
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return run


def _against_block(words: int, percent: int):
    """In each group the few against the block: one link for each pair of components that has one."""
    names = ["a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, few, parent, out = None, [], {}, []

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for key, (row, h) in _groups(batches, words, ["bucket", "part", "block"]):
            if key != now:
                now, few, parent = key, [], {}
            if row["few"]:
                few.append((row, h))
                continue
            for other, g in few:
                x, y = root(row["label"]), root(other["label"])
                if x == y or 100 * min(len(h), len(g)) < percent * max(len(h), len(g)):
                    continue
                # Distances obey the triangle inequality.
                if row["pivot"] is not None and row["pivot"] == other["pivot"] and abs(row["distance"] - other["distance"]) > 1 - percent / 100 + 1e-9:
                    continue
                both = shared_size(g, h)
                if 100 * both >= percent * (len(h) + len(g) - both):
                    parent[max(x, y)] = min(x, y)
                    out.append((row["node"], other["node"]))
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, with_key: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (the smallest id reachable), kept[, text_key]."""
    arrow_batches(docs.sparkSession)
    texts = keyed(docs, id_col, text_col)
    signed = stored(texts.mapInArrow(_signing(words, bands), "id long, text_key long, n long, set_a long, set_b long, bands array<long>"), "signatures")
    first = signed.where("n > 0").groupBy("set_a", "set_b").agg(F.min(F.struct("id", "text_key", "n", "bands")).alias("r"))
    classes = stored(first.select("set_a", "set_b", F.col("r.id").alias("node"), "r.text_key", "r.n", "r.bands"), "classes")

    rows = classes.select("node", "n", F.explode("bands").alias("bucket"))
    size = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("least"))
    size = size.where("size > 1").select("bucket", F.col("least.node").alias("least"), F.col("least.n").alias("least_n"))
    # Aggregates are written before a join uses them: right above its aggregation a join cannot have hot keys split.
    buckets = stored(rows.join(stored(size, "sizes"), "bucket"), "buckets")
    possible = (100 * F.least("n", "least_n") >= percent * F.greatest("n", "least_n")) & (F.col("node") != F.col("least"))
    pairs = buckets.where(possible).groupBy("node").agg(F.min("least").alias("pivot"))
    pairs = stored(pairs, "pairs")

    salts = stored(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts")), "salts")
    met = pairs.join(salts, "pivot").select("node", "pivot", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    heads = salts.select(F.col("pivot").alias("node"), "pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = buckets.select("node").distinct().join(classes.select("node", "text_key"), "node")
    held = texts.join(wanted.hint("shuffle_hash"), (F.col("id") == F.col("node")) & (texts.text_key == wanted.text_key)).select("id", texts.text_key, "text")
    held = stored(held.dropDuplicates(["id", "text_key"]).select(F.col("id").alias("node"), "text"), "texts")  # by the join's own keys
    dealt = held.join(met.unionByName(heads).hint("shuffle_hash"), "node").repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role", "node")
    tested = stored(dealt.select("pivot", "salt", "node", "text").mapInArrow(_against_first(words), "node long, pivot long, both long, either long"), "tested")
    links = tested.where(100 * F.col("both") >= percent * F.col("either")).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    labels = components(links)

    # Bands with classes of several components; bands of the same classes count once.
    marked = buckets.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    spread = marked.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("sum"), F.min("node").alias("least"))
    one = spread.where("x < y").groupBy("size", "sum", "least").agg(F.min("bucket").alias("bucket"))
    open_rows = stored(marked.join(one.select("bucket", "size"), "bucket"), "open")
    if not open_rows.isEmpty():
        parts = open_rows.groupBy("bucket", "size", "label").agg(F.count("*").alias("c")).groupBy("bucket", "size").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.max("c").alias("c"))
        parts = parts.select("bucket", "major", F.ceil((F.col("size") - F.col("c")) / BLOCK).cast("int").alias("parts"), F.ceil(F.col("size") / (4 * BLOCK)).cast("int").alias("blocks"))
        far = tested.select("node", "pivot", (1 - F.col("both") / F.col("either")).alias("distance"))
        known = open_rows.drop("size").join(stored(parts, "parts"), "bucket").join(far, "node", "left")
        key = F.xxhash64("node")
        few = known.where("label <> major").select("bucket", F.pmod(key, F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("few"), "node", "label", "pivot", "distance")
        every = known.select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(key, F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("few"), "node", "label", "pivot", "distance")
        both = held.join(few.unionByName(every), "node").repartition("bucket", "part", "block").sortWithinPartitions("bucket", "part", "block", F.desc("few"), "node")
        more = both.select("bucket", "part", "block", "few", "node", "label", "pivot", "distance", "text").mapInArrow(_against_block(words, percent), "a long, b long")
        labels = components(links.unionByName(more))

    named = classes.select("set_a", "set_b", "node").join(labels, "node", "left").select("set_a", "set_b", F.coalesce("label", "node").alias("component"))
    out = signed.select("id", "text_key", "n", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(shown(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), shown(component).alias("component_id"), (F.col("id") == component).alias("kept"), *(["text_key"] if with_key else []))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(read(spark, sf_dir, "documents", "doc_id", "text")), words=4)
