"""Language-model scoring by cross-entropy difference.

Two bigram models over one vocabulary are counted from the whole corpus: the
background model from every text, the target model from the target texts. A
text's score is the mean over its words of the target loss less the background
loss; the lower, the more it reads like the target texts. Both models smooth
alike: a bigram backs off to its word, a word to a uniform share, each
with a fixed prior weight. The context of a text's first word is its start; a
context's mass that no word takes is that of texts that end there. A word that
the corpus does not hold has the uniform share alone.

The vocabulary is every word of the corpus, and nothing that grows is dropped,
broadcast or collected:

  blocks    documents in blocks of a bounded number of words, each word numbered
            among the block's distinct words; texts are read once
  marks     ids meet the target ids by a shuffle of ids and come back by block
  asked     each block sends its counts of its distinct words and bigrams, dealt
            by 64-bit key into buckets; this is its share of both models' counts
            and what it asks for at once, so a key comes at most once from a block
  answers   a bucket sums what came for each key and sends the sums back
  scored    a block turns the sums into its texts' losses

Words are maximal runs of anything but the six ASCII spaces, A-Z lower-cased.
Defined cases: a null or empty text has no words, losses and score 0; without
target texts the target model is the uniform prior; a null id is no target;
repeated rows and ids each count and keep their own row; other columns of the
inputs are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm.shared import arrow_batches, read, spread, stored
from factloom.llm.textnp import chunks, column, fold_table, mix, prefix, span_hash, utf8, word_spans, word_table

#: Prior weights of a word's share among all words, and of the uniform share.
PRIOR_BIGRAM, PRIOR_WORD = 20.0, 1000.0
#: Words and texts in a block; a longer text stands alone.
_BLOCK, _BLOCK_ROWS = 1_000_000, 100_000
#: Keys that blocks send to a bucket.
_BUCKET = 2_000_000
#: The key of a text's start; the keys of words are even, those of bigrams odd.
_START = 0


def word_hashes(arr: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, off = utf8(arr)
    for a, b in chunks(off):
        part = fold_table(True)[buf[off[a] : off[b]]]
        s, e, rows = word_spans(part, off[a : b + 1] - off[a], word_table(False))
        yield a, b, span_hash(prefix(part), s, e), rows


def word_keys(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(2)) << np.uint64(1)).view(np.int64)


def bigram_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = mix(v.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.view(np.uint64))
    return ((mix(h ^ v.view(np.uint64)) >> np.uint64(2)) << np.uint64(1) | np.uint64(1)).view(np.int64)


def contexts(words: np.ndarray, rows: np.ndarray, start: int) -> np.ndarray:
    """The word before each word, or the start of its text; rows are the texts' n+1 offsets."""
    before = np.concatenate([words[:1], words[:-1]])
    before[rows[:-1][np.diff(rows) > 0]] = start
    return before


class Totals:
    """What is known of both models besides the table: words of the vocabulary, and words of all texts and of target texts."""

    def __init__(self, vocabulary: int, words: tuple[int, int]):
        self.uniform, self.words = 1.0 / (vocabulary + 1), np.array(words, float)

    def losses(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """(n, 2): background and target loss in nats of words, given counts of the bigram, its context and its word."""
        share = (word + PRIOR_WORD * self.uniform) / (self.words + PRIOR_WORD)
        return -np.log((pair + PRIOR_BIGRAM * share) / (context + PRIOR_BIGRAM))


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes, those of one weight together."""
    flat = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return pa.compress(flat, codec="zstd", asbytes=True) if len(x) else b""


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, n * size, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(kind)


def _numbering(schema: pa.Schema):
    """Documents to blocks: their ids, numbers of words, the block's distinct words, and which of them each word is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n_rows = [], 0, 0

        def block() -> pa.RecordBatch:
            ids = pa.concat_arrays([x for x, _, _ in held])
            lengths, words = (np.concatenate([x[k] for x in held]) for k in (1, 2))
            known, words = np.unique(words, return_inverse=True)
            made = {"block": [uuid.uuid4().hex], "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "lengths": [_packed(lengths)], "known": [_packed(np.diff(known, prepend=0))], "words": [_packed(words.astype(np.int32))]}
            made |= {"n_known": [len(known)], "n_words": [len(words)]}
            return pa.RecordBatch.from_arrays([v if isinstance(v := made[f.name], pa.Array) else pa.array(v, f.type) for f in schema], schema=schema)

        for batch in batches:
            ids = column(batch, "id")
            for a, b, h, rows in word_hashes(column(batch, "text")):
                if held and (size + len(h) > _BLOCK or n_rows + b - a > _BLOCK_ROWS):
                    yield block()
                    held, size, n_rows = [], 0, 0
                held.append((ids[a:b], np.diff(rows), word_keys(h)))
                size, n_rows = size + len(h), n_rows + b - a
        if held:
            yield block()

    return run


def _keys(known: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """What a block asks for: the start, its words and its distinct bigrams, in this order."""
    return np.concatenate([[_START], known, bigrams])


def _bigrams(known: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bigram that each word ends, and the place of its context among what a block asks for."""
    before = contexts(words.astype(np.int64) + 1, np.append(0, np.cumsum(lengths)), 0)
    return bigram_keys(np.append(_START, known)[before], known[words]), before


def _of_block(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, words and lengths of a block."""
    return np.cumsum(_unpacked(r["known"], r["n_known"], np.int64)), _unpacked(r["words"], r["n_words"], np.int32), _unpacked(r["lengths"], r["n_rows"], np.int64)


def _bucket(keys, buckets: int):
    """The bucket of each key, of an array or a column alike."""
    return keys % 2_147_483_647 * 1_000_003 % 2_147_483_629 % buckets


def _dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its keys, in order."""
    of = _bucket(keys, buckets)
    order = np.argsort(of.astype(np.uint16) if buckets < 1 << 16 else of, kind="stable")
    found, first = np.unique(of[order], return_index=True)
    return zip(found.tolist(), np.split(order, first[1:]), strict=True)


def _asking(buckets: int):
    schema = pa.schema([("block", pa.string()), ("bucket", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("every", pa.binary()), ("target", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                known, words, lengths = _of_block(r)
                marked = np.zeros(len(lengths))
                marked[r["marked"] or []] = 1
                marks = np.repeat(marked, lengths)
                bigrams, which = np.unique(_bigrams(known, words, lengths)[0], return_inverse=True)
                keys, n = _keys(known, bigrams), len(known)
                some = lengths > 0
                # The start is counted by texts, words and bigrams by their places.
                every = np.concatenate([[some.sum()], np.bincount(words, minlength=n), np.bincount(which, minlength=len(bigrams))])
                target = np.concatenate([[(some * marked).sum()], np.bincount(words, marks, n), np.bincount(which, marks, len(bigrams))])
                rows: list[list] = [[] for _ in schema]
                for k, at in _dealt(keys, buckets):
                    for values, x in zip(rows, (r["block"], k, len(at), _packed(np.diff(keys[at], prepend=0)), *(_packed(c[at].astype(np.int32)) for c in (every, target))), strict=True):
                        values.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, schema, strict=True)], schema=schema)

    return run


_ANSWER = pa.schema([("block", pa.string()), ("bucket", pa.int64()), ("every", pa.binary()), ("target", pa.binary()), ("words", pa.list_(pa.int64()))])


def _answering(asked: pa.Table) -> pa.Table:
    """The sums over all blocks of the keys that each block sent to one bucket, and a row of this bucket's distinct words and their sums."""
    blocks, buckets, sizes = (asked[c].to_pylist() for c in ("block", "bucket", "n"))
    keys = np.concatenate([np.cumsum(_unpacked(x, n, np.int64)) for x, n in zip(asked["keys"].to_pylist(), sizes, strict=True)])
    distinct, which = np.unique(keys, return_inverse=True)
    sums = [np.bincount(which, np.concatenate([_unpacked(x, n, np.int32) for x, n in zip(asked[c].to_pylist(), sizes, strict=True)]), len(distinct)).astype(np.int64) for c in ("every", "target")]
    ends = np.cumsum(sizes)[:-1]
    answers = [[_packed(x) for x in np.split(c[which], ends)] for c in sums]
    words = (distinct % 2 == 0) & (distinct != _START)
    totals = [int(words.sum()), *(int(c[words].sum()) for c in sums)]
    columns = [[*blocks, None], [*buckets, None], *([*x, None] for x in answers), [*(None for _ in blocks), totals]]
    return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _ANSWER, strict=True)], schema=_ANSWER)


_BLOCK_COLUMNS = ("known", "words", "lengths", "n_known", "n_words", "n_rows")


def _scoring(totals: Totals, buckets: int, schema: pa.Schema):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        parts = [schema.empty_table()]
        got = {k: (x, y) for k, x, y in zip(*(answers[c].to_pylist() for c in ("bucket", "every", "target")), strict=True)} if answers.num_rows else {}
        for i in range(blocks.num_rows):
            r = {c: blocks[c][i].as_py() for c in _BLOCK_COLUMNS}
            known, words, n = _of_block(r)
            bigrams, context = _bigrams(known, words, n)
            bigrams, pair = np.unique(bigrams, return_inverse=True)
            keys = _keys(known, bigrams)
            found = np.zeros((len(keys), 2))
            for k, at in _dealt(keys, buckets):
                found[at] = np.stack([_unpacked(x, len(at), np.int64) for x in got[k]], axis=1)
            loss = totals.losses(found[len(known) + 1 + pair], found[context], found[words + 1])
            rows = np.repeat(np.arange(len(n)), n)
            back, target = (np.bincount(rows, loss[:, k], len(n)) / np.maximum(n, 1) for k in (0, 1))
            columns = [blocks["ids"][i].values, pa.array(n), pa.array(target), pa.array(back), pa.array(target - back)]
            parts.append(pa.Table.from_arrays(columns, schema=schema))
        return pa.concat_tables(parts)

    return run


def score(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_words, target_loss, background_loss, score) for each row of docs; losses are means over the words, in nats.
    The background model is that of docs, the target model that of the docs whose id is in target."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("n_words", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])
    packed = pa.schema([("block", pa.string()), ("ids", pa.list_(to_arrow_type(kind))), *((c, pa.binary()) for c in ("lengths", "known", "words")), *((c, pa.int64()) for c in ("n_known", "n_words"))])
    # Block names are made up by the tasks: they hold once the blocks are written.
    blocks = stored(rows.mapInArrow(_numbering(packed), f"block string, ids array<{kind.simpleString()}>, lengths binary, known binary, words binary, n_known long, n_words long"), "blocks")
    blocks = blocks.withColumn("n_rows", F.size("ids").cast("long"))
    buckets = int(blocks.agg(F.sum(F.col("n_known") + F.col("n_words"))).first()[0] or 0) // _BUCKET + 1
    wanted = target.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    marks = blocks.select("block", F.posexplode("ids").alias("at", "id")).join(wanted.hint("shuffle_hash"), "id", "left_semi").groupBy("block").agg(F.collect_list("at").alias("marked"))
    asked = blocks.select("block", *_BLOCK_COLUMNS).join(marks.hint("shuffle_hash"), "block", "left").mapInArrow(_asking(buckets), "block string, bucket long, n long, keys binary, every binary, target binary")
    answers = stored(asked.groupBy("bucket").applyInArrow(_answering, "block string, bucket long, every binary, target binary, words array<bigint>"), "answers")
    words = [x or 0 for x in answers.where("words IS NOT NULL").agg(*(F.sum(F.col("words")[k]) for k in range(3))).first()]
    answers = answers.where("block IS NOT NULL").drop("words")
    found = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scoring(Totals(words[0], (words[1], words[2])), buckets, schema), f"id {kind.simpleString()}, n_words long, target_loss double, background_loss double, score double")
    return found.withColumnRenamed("id", id_col)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target texts are those labelled of good quality."""
    found = score(spread(read(spark, sf_dir, "documents", "doc_id", "text")), read(spark, sf_dir, "labels", "doc_id", "quality").where("quality = 1"))
    return found.select("doc_id", "n_words", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


#: Words and bigrams of all texts, and of those labelled good, by plain joins.
SQL = f"""
WITH RECURSIVE tokens AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good FROM documents),
events AS MATERIALIZED (SELECT r, good, unnest(ws) AS w, unnest(list_prepend(NULL, ws[:-2])) AS v FROM tokens WHERE len(ws) > 0),
word AS MATERIALIZED (SELECT w, count(*) AS every, count(*) FILTER (WHERE good) AS target FROM events GROUP BY w),
pair AS MATERIALIZED (SELECT v, w, count(*) AS every, count(*) FILTER (WHERE good) AS target FROM events GROUP BY v, w),
starts AS (SELECT count(*) FILTER (WHERE len(ws) > 0) AS every, count(*) FILTER (WHERE len(ws) > 0 AND good) AS target FROM tokens),
total AS (SELECT count(*) AS v, sum(every) AS every, sum(target) AS target FROM word),
loss AS MATERIALIZED (SELECT p.v, p.w,
    -ln((p.every + {PRIOR_BIGRAM} * (w.every + {PRIOR_WORD} / (t.v + 1)) / (t.every + {PRIOR_WORD})) / (CASE WHEN p.v IS NULL THEN s.every ELSE c.every END + {PRIOR_BIGRAM})) AS back,
    -ln((p.target + {PRIOR_BIGRAM} * (w.target + {PRIOR_WORD} / (t.v + 1)) / (t.target + {PRIOR_WORD})) / (CASE WHEN p.v IS NULL THEN s.target ELSE c.target END + {PRIOR_BIGRAM})) AS target
  FROM pair p JOIN word w ON p.w = w.w LEFT JOIN word c ON p.v = c.w CROSS JOIN total t CROSS JOIN starts s),
summed AS (SELECT e.r, sum(l.back) AS back, sum(l.target) AS target FROM events e JOIN loss l ON e.w = l.w AND e.v IS NOT DISTINCT FROM l.v GROUP BY e.r)
SELECT t.doc_id, CAST(len(t.ws) AS BIGINT) AS n_words, round(coalesce(s.target / len(t.ws), 0), 6) AS target_loss, round(coalesce(s.back / len(t.ws), 0), 6) AS background_loss,
  round(coalesce((s.target - s.back) / len(t.ws), 0), 6) AS score
FROM tokens t LEFT JOIN summed s ON t.r = s.r
"""
