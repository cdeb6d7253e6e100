"""Spelling variants: words one edit apart, found by rolling-hash deletions.

Words that differ by one replaced code point agree once it is deleted from both at
the same place; words that differ by one inserted code point agree once it is
deleted from the longer. So each word gives one integer key for every deletion,
and one for itself.

  keys     prefix and suffix polynomial hashes modulo 2**61-1 give all deletion
           keys of a batch at once in NumPy; rows are (key, place, word's number),
           never the word itself, so that a word of n letters costs n numbers
  match    keys are dealt by their top bits in buckets of about BUCKET rows, each
           bucket is sorted, and rows that meet no other are dropped
  verify   matched rows get their words back; what counts is equality of the
           strings that are left, so keys that only collide link nothing
  forms    each word's most frequent near word, if it is `ratio` times as frequent;
           forms are followed to their end by pointer doubling (counts grow by
           `ratio` with each link, so chains are short and have no loops)

Defined cases: null words are dropped; rows of one word are added up; the empty
word is near to every word of one letter; ties in frequency go to the smaller word
in code-point order; an empty table gives no rows; other columns are not read.
For `perturbed_words`: a null text has no words, a null id is written as nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.pretokens import code_points
from factloom.llm.shared import arrow_batches, read, spread, stored
from factloom.llm.textnp import PRIME, column, mix, powers, prefix, times, utf8

LETTERS, LENGTH, COUNT, RATIO, RARE = "a-zÀ-ÿ", 7, 2, 10, 31
#: Key rows in one bucket, words that a task counts before it sends them on, characters read at once.
BUCKET, HELD, PIECE = 1 << 16, 200_000, 1 << 20
#: What a matched row is: one of several with a deletion at the same place, a deletion that equals a word, that word.
PLACE, SHORTER, WHOLE = 0, 1, 2

_U, _P = np.uint64, np.uint64(PRIME)


def deletion_keys(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of each word without its letter at each place, and key of each word: off are the starts of the words in cp."""
    power, inverse = powers(len(cp) + 1)
    sums = prefix(cp)

    def span(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = sums[y] + _P - sums[x]
        return times(np.minimum(d, d - _P), inverse[x])

    start, end = off[:-1], off[1:]
    n = end - start
    first, last, place = np.repeat(start, n), np.repeat(end, n), np.arange(len(cp))
    left = span(first, place) + times(span(place + 1, last), power[place - first])
    sized = lambda h, size: mix(h + size.astype(_U) * _U(0xA24BAED4963EE407))
    return sized(np.minimum(left, left - _P), np.repeat(n - 1, n)), sized(span(start, end), n)


def _keying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, cp, off = code_points(*utf8(column(batch, "word")))
        ids = column(batch, "id").to_numpy()
        without, whole = deletion_keys(cp, off)
        n = np.diff(off)
        at = np.arange(len(cp)) - np.repeat(off[:-1], n)
        # Deletions within a run of one letter leave the same: the first stands for them where a longer word meets a shorter.
        fresh = np.ones(len(cp), bool)
        fresh[1:] = (cp[1:] != cp[:-1]) | (at[1:] == 0)
        owner = np.repeat(ids, n)
        step = 1 << 16
        for a in range(0, len(cp), step):
            part = slice(a, a + step)
            yield pa.RecordBatch.from_arrays([pa.array(without[part].view(np.int64)), pa.array(at[part].astype(np.int32)), pa.array(fresh[part]), pa.array(owner[part])], names=["key", "at", "fresh", "id"])
        yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(np.full(len(ids), -1, np.int32)), pa.array(np.zeros(len(ids), bool)), pa.array(ids)], names=["key", "at", "fresh", "id"])


def _matching(table: pa.Table) -> pa.Table:
    """The rows of one bucket that meet others: (id, at, role)."""
    key, at, fresh, ids = (table.column(c).to_numpy() for c in ("key", "at", "fresh", "id"))
    order = np.lexsort((at, key))
    key, at, fresh, ids = key[order], at[order], fresh[order], ids[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    new = first.copy()
    new[1:] |= at[1:] != at[:-1]
    alone = new & np.append(new[1:], True)
    group = np.cumsum(first) - 1
    has_whole, has_longer = np.zeros(group[-1] + 1, bool), np.zeros(group[-1] + 1, bool)
    has_whole[group[at < 0]] = True
    has_longer[group[fresh]] = True
    met = has_whole & has_longer
    rows = [(PLACE, np.flatnonzero(~alone & (at >= 0))), (SHORTER, np.flatnonzero(fresh & met[group])), (WHOLE, np.flatnonzero((at < 0) & met[group]))]
    role = np.concatenate([np.full(len(k), r, np.int32) for r, k in rows])
    take = np.concatenate([k for _, k in rows])
    return pa.table({"id": ids[take], "at": at[take], "role": role})


def near(words: DataFrame) -> DataFrame:
    """word, n_near, form_n and form of words (id, word, n) with a near word: how many there are, the most frequent and its count."""
    arrow_batches(words.sparkSession)
    rows = words.agg(F.sum(F.length("word").cast("long") + 1)).first()[0] or 0
    bits = max(1, math.ceil(math.log2(rows / BUCKET + 1)))
    keys = words.select("id", "word").mapInArrow(_keying, "key long, at int, fresh boolean, id long")
    matched = keys.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("radix")).applyInArrow(_matching, "id long, at int, role int")
    return verified(stored(matched.join(words, "id").select("role", "at", "word", "n"), "matched"))


def verified(found: DataFrame) -> DataFrame:
    """word, n_near, form_n and form from rows (role, at, word, n) whose keys met: those whose strings agree as well."""
    rest = F.concat(F.substring(F.col("word"), F.lit(1), F.col("at")), F.substring(F.col("word"), F.col("at") + 2, F.length("word")))
    same = Window.partitionBy("at", "rest").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = lambda k: F.nth_value(F.struct("n", "word"), k).over(same)
    placed = found.where(F.col("role") == PLACE).withColumn("rest", rest).select("word", one(1).alias("best"), one(2).alias("next"), (F.count("*").over(same) - 1).alias("others"))
    replaced = placed.where("others > 0").select("word", "others", F.when(F.col("best.word") == F.col("word"), F.col("next")).otherwise(F.col("best")).alias("other"))

    longer = found.where(F.col("role") == SHORTER).select(rest.alias("rest"), F.struct("n", "word").alias("long"))
    shorter = found.where(F.col("role") == WHOLE).select(F.col("word").alias("rest"), F.struct("n", "word").alias("short"))
    pairs = longer.join(shorter, "rest")
    inserted = pairs.select(F.explode(F.array(F.struct("long.word", F.col("short").alias("other")), F.struct("short.word", F.col("long").alias("other")))).alias("x"))
    every = replaced.unionByName(inserted.select("x.word", F.lit(1).cast("long").alias("others"), "x.other"))
    best = F.min(F.struct((-F.col("other.n")).alias("n"), F.col("other.word").alias("word")))
    return every.groupBy("word").agg(F.sum("others").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("form_n"), F.col("b.word").alias("form"))


def ends(links: DataFrame) -> DataFrame:
    """word and root of links (word, form) without loops: the last word that forms lead to. Each round doubles the steps taken."""
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("via"), F.col("root").alias("further"))
        after = stored(now.join(ahead, now.root == ahead.via, "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def variants(words: DataFrame, *, word_col: str = "word", n_col: str = "n", ratio: int = RATIO) -> DataFrame:
    """One row for each distinct word: word, form (its most frequent near word, where `ratio` times as frequent), root (the word that
    forms lead to), n, n_near, form_n."""
    counted = words.where(F.col(word_col).isNotNull()).groupBy(F.col(word_col).alias("word")).agg(F.sum(n_col).alias("n"))
    counted = stored(counted.withColumn("id", F.monotonically_increasing_id()), "words")
    related = counted.select("word", "n").join(near(counted), "word", "left")
    strong = F.col("form_n") >= ratio * F.col("n")
    kept = lambda c: F.when(strong, F.col(c)).alias(c)
    formed = stored(related.select("word", kept("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), kept("form_n")), "forms")
    roots = ends(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def pieces(text: str, outside: re.Pattern, size: int) -> Iterator[str]:
    """The text in parts of about `size` that end outside a word."""
    at = 0
    while at < len(text):
        gap = outside.search(text, at + size)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def _perturbing(letters: str, length: int, rare: int):
    run_of, outside = re.compile(f"[{letters}]{{{length},}}"), re.compile(f"[^A-Z{letters}]")
    upper = {c: c + 32 for c in range(0x41, 0x5B)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        held = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for key, text in zip(column(batch, "id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                state = crc32(f"{'' if key is None else key}:".encode())
                for part in pieces(text or "", outside, PIECE):
                    for word, n in Counter(run_of.findall(part.translate(upper))).items():
                        h = crc32(word.encode(), state)
                        if h % rare == 0:
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                            if len(word) < length:
                                continue
                        total[word] += n
                    if len(total) > HELD:
                        yield held()
                        total.clear()
        yield held()

    return run


def perturbed_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS, length: int = LENGTH, count: int = COUNT, rare: int = RARE) -> DataFrame:
    """word and n of the words of whole texts with at least `length` letters and `count` occurrences. Misspellings are put in by rule:
    where the CRC-32 of id and word is divisible by `rare`, the word loses one letter all over that text."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_perturbing(letters, length, rare), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(perturbed_words(spread(read(spark, sf_dir, "documents", "doc_id", "text"))))
