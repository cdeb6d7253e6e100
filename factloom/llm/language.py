"""Language identification by word-first backoff.

Words are runs of letters, lower-cased. A known word scores its smoothed log
frequency in each language. An unseen word backs off to its character n-grams,
marks of its two ends included, from the longest kept length down to single
letters; the first length with a known n-gram gives the mean of their log
frequencies. A text's language has the highest sum; its score is that language's
share by softmax. The model is fitted to a hash sample of at most TRAIN_DOCS
labelled texts and keeps the most frequent WORDS words and NGRAMS n-grams of
each length, which bounds the broadcast.

Defined cases: a null text, or one without a letter, is `und` with score 0, as
is every text when nothing is labelled; ties go to the language first by name;
rows of null id are not held out and never trained on; repeated rows and ids
each keep their own row; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm.pretokens import LETTER, classes, code_points
from factloom.llm.shared import arrow_batches, read, sampled, spread, stored
from factloom.llm.textnp import chunks, column, gather, prefix, span_hash, utf8

TRAIN_DOCS = 20_000
WORDS, NGRAMS = 100_000, 30_000
LENGTHS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
_SMOOTH = 0.5

_lower: list[np.ndarray] = []


def lowered(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters with everything else a blank, and which are letters."""
    if not _lower:
        table = np.full(0x110000, 0x20, np.uint32)
        is_letter = np.flatnonzero(classes() == LETTER)
        table[is_letter] = [ord(x[0]) if (x := chr(c).lower()) else c for c in is_letter.tolist()]
        _lower.append(table)
    return _lower[0][cp], classes()[cp] == LETTER


class Words:
    """The words of some rows, by distinct word."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        _, cp, rows = code_points(buf, off)
        low, is_letter = lowered(np.concatenate([cp, [0x20]]).astype(np.uint32))
        start, end = is_letter.copy(), is_letter.copy()
        start[1:] &= ~is_letter[:-1]
        end[:-1] &= ~is_letter[1:]
        inner = rows[1:-1]
        inner = inner[(inner > 0) & (inner < len(cp))]
        start[inner], end[inner - 1] = is_letter[inner], is_letter[inner - 1]
        # A blank at each end of every word, also where two rows touch.
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.rows = np.searchsorted(s, rows)
        self.letters = np.diff(self.rows)
        keys = span_hash(prefix(low), s, e)
        self.keys, first, self.inverse, self.counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        self.low, self.s, self.e = low, s[first], e[first]

    def ngrams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of some distinct words, and how many each has."""
        s, size = self.s[which], self.e[which] - self.s[which]
        flat = np.full(int((size + 2).sum()), 0x20, np.uint32)
        at = np.cumsum(size + 2) - (size + 2)
        flat[gather(at + 1, size)] = self.low[gather(s, size)]
        count = np.maximum(size + 3 - n, 0)
        if n == 1:
            at, count = at + 1, size
        i = gather(at, count)
        return span_hash(prefix(flat), i, i + n), count


def _counting():
    names = ["n", "hash", "lang", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in set(column(batch, "lang").to_pylist()):
                mask = pa.compute.equal(column(batch, "lang"), lang)
                buf, off = utf8(column(batch.filter(mask), "text"))
                for a, b in chunks(off):
                    w = Words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                    every = np.arange(len(w.keys))
                    out = [(0, w.keys, w.counts)]
                    for n in LENGTHS:
                        h, count = w.ngrams(every, n)
                        keys, inverse = np.unique(h, return_inverse=True)
                        out.append((n, keys, np.bincount(inverse, np.repeat(w.counts, count)).astype(np.int64) if len(h) else np.zeros(0, np.int64)))
                    for n, keys, counts in out:
                        m = len(keys)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, n, np.int32)), pa.array(keys.view(np.int64)), pa.array([lang] * m, pa.string()), pa.array(counts.astype(np.int64))], names=names)

    return run


class Model:
    """Log frequencies of the kept words and n-grams in each language."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """tables: by length (0 for words), sorted hashes, counts by language, and totals by language."""
        self.langs, self.tables = langs, {}
        for n, (keys, counts, totals) in tables.items():
            logs = np.log((counts + _SMOOTH) / (totals + _SMOOTH * (len(keys) + 1)))
            self.tables[n] = keys, logs.astype(np.float32)

    def find(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have, _ = self.tables[n]
        if not len(have):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return at, have[at] == keys

    def scores(self, words: Words) -> np.ndarray:
        """Log score of each distinct word in each language; 0 for words of letters never seen."""
        out = np.zeros((len(words.keys), len(self.langs)), np.float32)
        at, known = self.find(0, words.keys)
        out[known] = self.tables[0][1][at[known]]
        left = np.flatnonzero(~known)
        for n in LENGTHS:
            if not len(left):
                break
            h, count = words.ngrams(left, n)
            at, known = self.find(n, h)
            owner = np.repeat(np.arange(len(left)), count)[known]
            hits = np.bincount(owner, minlength=len(left))
            logs = self.tables[n][1][at[known]] if known.any() else np.zeros((0, len(self.langs)))
            sums = np.stack([np.bincount(owner, logs[:, k], len(left)) for k in range(len(self.langs))], axis=1)
            some = hits > 0
            out[left[some]] = sums[some] / hits[some, None]
            left = left[~some]
        return out


def train(docs: DataFrame, *, id_col: str | None = None, text_col: str = "text", lang_col: str = "lang", sample: int = TRAIN_DOCS, words: int = WORDS, ngrams: int = NGRAMS) -> Model:
    """Fits a model to at most `sample` labelled rows of docs, chosen by hash of text, language and the id, if there is one; equal rows count once."""
    arrow_batches(docs.sparkSession)
    rows = sampled(docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()), sample, *([id_col] if id_col else []), text_col, lang_col)
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(_counting(), "n int, hash long, lang string, count long").groupBy("n", "hash", "lang").agg(F.sum("count").alias("count"))
    per_key = counts.groupBy("n", "hash").agg(F.sum("count").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "count"))).alias("by"))
    per_key = stored(per_key, "ngrams")
    langs = sorted(r.lang for r in per_key.select(F.explode(F.map_keys("by")).alias("lang")).distinct().collect())
    shares = F.transform(F.array(*map(F.lit, langs)).cast("array<string>"), lambda x: F.coalesce(F.try_element_at("by", x), F.lit(0)).cast("double"))
    tables = {}
    for n in (0, *LENGTHS):
        top = per_key.where(F.col("n") == n).orderBy(F.desc("total"), "hash").limit(ngrams if n else words).select("hash", shares.alias("by")).toArrow()
        keys = top["hash"].to_numpy().astype(np.int64).view(np.uint64)
        matrix = top["by"].combine_chunks().flatten().to_numpy().reshape(len(keys), len(langs)) if len(keys) else np.zeros((0, len(langs)))
        order = np.argsort(keys)
        tables[n] = keys[order], matrix[order], matrix.sum(axis=0)
    return Model(langs, tables)


def _predicting(broadcast, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        k = len(model.langs)
        for batch in batches:
            buf, off = utf8(column(batch, "text"))
            langs, scores = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for a, b in chunks(off):
                if not k:
                    continue
                w = Words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                if not len(w.keys):
                    continue
                owner = np.repeat(np.arange(b - a), w.letters)
                by = model.scores(w)[w.inverse]
                sums = np.stack([np.bincount(owner, by[:, j], b - a) for j in range(k)], axis=1)
                p = np.exp(sums - sums.max(axis=1, keepdims=True))
                some = w.letters > 0
                langs[a:b] = np.where(some, sums.argmax(axis=1), -1)
                scores[a:b] = np.where(some, p.max(axis=1) / p.sum(axis=1), 0)
            named = pa.array([model.langs[i] if i >= 0 else UNKNOWN for i in langs.tolist()], pa.string())
            made = {"lang_pred": named, "score": pa.array(scores)}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else column(batch, f.name) for f in schema], schema=schema)

    return run


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row (id[, text], lang_pred, score) for each row of docs, in one pass without a shuffle."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), *([("text", pa.string())] if with_text else []), ("lang_pred", pa.string()), ("score", pa.float64())])
    found = rows.mapInArrow(_predicting(spark.sparkContext.broadcast(model), schema), f"id {kind.simpleString()}, {'text string, ' * with_text}lang_pred string, score double")
    return found.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the id's text leaves 1 modulo 3; null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out()), id_col="doc_id")
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
