"""Importance resampling towards a target: a streaming ring of CRC-32 states gives hashed word runs.

Features of a text are all runs of 1 to `n` consecutive words, joined by one
space, repeats counted; a feature's bucket is its CRC-32 modulo `buckets`. One
scan of a text keeps the running zlib states of the last `n` starts, extends each
by a space and the next word, opens one more, and emits their buckets; no run is
ever put together as a string.

  counts   each task sums the buckets of its texts; `buckets` sums in all, which
           bounds what the driver gets and sends out, whatever the corpus
  gains    of each bucket, the scaled logarithm of target over corpus frequency
  weights  a second scan adds up the gains of each text's features
  draw     the best scores, weight plus Gumbel noise from the id's hash: rows are
           dealt by ranges of (score, id) and sorted there, a row's rank is its
           place in its range after the sizes of the ranges before it

Defined cases: a null, empty or wordless text has no features, weight 0, and is
never drawn; an empty corpus or target counts as zero in every bucket; a null id is
hashed as the empty string and ranks first among ties; rows that share an id are
rows of their own with the same noise; rows with equal score and id rank by weight,
then in the order in which they were read; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm.shared import arrow_batches, read, spread, stored
from factloom.llm.textnp import column, fold_table, utf8, word_table

RUN, BUCKETS, PERCENT, LEAST_WORDS, SEED = 3, 10_000, 5, 20, 42
#: Bytes of a text whose words are held at once.
PIECE = 1 << 18

_BLANKED = np.where(word_table(True)[fold_table(True)], fold_table(True), 0x20).astype(np.uint8).tobytes()


def words(data: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text's bytes, in lists from pieces of about PIECE bytes."""
    at = 0
    while at < len(data):
        part = data[at : at + PIECE].translate(_BLANKED)
        if at + PIECE < len(data):  # end the piece at a gap between words, or go on to the next one
            cut = part.rfind(b" ")
            if cut < 0:
                more = PIECE
                while cut < 0 and at + more < len(data):
                    more *= 2
                    part = data[at : at + more].translate(_BLANKED)
                    cut = part.rfind(b" ")
            if cut >= 0:
                part = part[: cut + 1]
        at += len(part)
        yield part.split()


def features(data: bytes, n: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Words read and the buckets of the runs that end in them, piece by piece."""
    ring: list[int] = []  # running states of the last starts, the oldest first
    for piece in words(data):
        out: list[int] = []
        for word in piece:
            if len(ring) == n:
                del ring[0]
            spaced = b" " + word
            ring = [crc32(spaced, state) for state in ring]
            ring.append(crc32(word))
            out += ring
        yield len(piece), np.array(out, np.int64) % buckets


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    buf, off = utf8(column(batch, "text"))
    raw = memoryview(buf)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield bytes(raw[a:b])


def _counting(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            held, size = [], 0
            for data in _texts(batch):
                for _, found in features(data, n, buckets):
                    held.append(found)
                    size += len(found)
                    if size > 1 << 20:
                        total += np.bincount(np.concatenate(held), minlength=buckets)
                        held, size = [], 0
            if size:
                total += np.bincount(np.concatenate(held), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, *, text_col: str = "text", n: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n: how many features of all texts fall in it; buckets without any are absent."""
    arrow_batches(texts.sparkSession)
    found = texts.select(F.col(text_col).alias("text")).mapInArrow(_counting(n, buckets), "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, *, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket from the counts of corpus and target; one row for each bucket comes to the driver."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    both = corpus.select("bucket", "n", F.lit(0).alias("side")).unionByName(target.select("bucket", "n", F.lit(1).alias("side")))
    for row in both.collect():
        (s, t)[row.side][row.bucket] = row.n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weighing(gain, n: int, buckets: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = gain.value
        for batch in batches:
            rows = []
            for data in _texts(batch):
                n_words = n_features = weight = 0
                for more, found in features(data, n, buckets):
                    n_words += more
                    n_features += len(found)
                    weight += int(value[found].sum())
                rows.append((n_words, n_features, weight))
            numbers = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), *(pa.array(numbers[:, k]) for k in range(3))], schema=schema)

    return run


def weighed(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", n: int = RUN) -> DataFrame:
    """id, n_words, n_features and weight of each row of docs."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), *((c, pa.int64()) for c in ("n_words", "n_features", "weight"))])
    run = _weighing(spark.sparkContext.broadcast(gain), n, len(gain), schema)
    return rows.mapInArrow(run, f"id {kind.simpleString()}, n_words long, n_features long, weight long")


def noise(key: F.Column, seed: int) -> F.Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, *, most: int) -> DataFrame:
    """Rows (id, score, weight, row) with their rank by score and id, null beyond `most`. No task gets more than its range, and
    equal rows are told apart by where they were read, so that ranges can part them too."""
    spark = rows.sparkSession
    order = [F.desc("score"), F.asc("id"), F.desc("weight"), F.asc("row")]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    dealt = stored(dealt.select("*", F.shiftright(place, 33).alias("range"), (place.bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place")), "ranked")
    sizes = dealt.groupBy("range").agg(F.count("*").alias("size"))  # a row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ahead"))
    rank = F.col("ahead") + F.col("place")
    return dealt.join(F.broadcast(ahead), "range").withColumn("rank", F.when(rank <= most, rank)).drop("range", "place", "ahead")


def resampled(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: id, n_words, n_features, weight, score, rank. rank numbers the rows drawn, null for the others:
    of those with at least `least` words, `percent` of a hundred (rounded down) with the highest scores."""
    options = {"n": n, "buckets": buckets}
    gain = gains(bucket_counts(docs, text_col=text_col, **options), bucket_counts(target, text_col=target_col, **options), buckets=buckets)
    scored = weighed(docs, gain, id_col=id_col, text_col=text_col, n=n)
    scored = stored(scored.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("row", F.monotonically_increasing_id()), "scored")
    enough = F.col("n_words") >= least
    best = ranked(scored.where(enough), most=percent * scored.where(enough).count() // 100)
    return best.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))).drop("row").withColumnRenamed("id", id_col)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents", "doc_id", "text"))
    found = resampled(docs, read(spark, sf_dir, "benchmark", "text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
