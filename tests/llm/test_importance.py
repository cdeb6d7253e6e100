import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from factloom.llm import importance
from tests.llm import brute


def features_of(text, n=3):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", brute.lower(text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, buckets, percent=5, least=20, seed=42):
    """The whole result, from strings."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features_of(x)[1]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, text in docs:
        words, found = features_of(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        rows.append((i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], (r[0] is not None, r[0]), -r[3]))
    drawn = [(*r, k + 1 if k < percent * len(order) // 100 else None) for k, r in enumerate(order)]
    return drawn + [(*r, None) for r in rows if r[1] < least]


def rows_of(df):
    return [(r[0], r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()]


@pytest.mark.parametrize("buckets", [10_000, 7])
def test_rows_of_the_plain_definition(spark, buckets):
    """Nulls, empties, a long text, repeated rows, clashing names; with few buckets most scores come from collisions."""
    rows = brute.corpus(seed=3, n=120)
    target = [t for _, t in brute.corpus(seed=4, n=20)]
    goal = spark.createDataFrame([(t, "x") for t in target], "text string, id string")
    got = rows_of(importance.resampled(brute.frame(spark, rows), goal, buckets=buckets, percent=30))
    assert brute.counted(got) == brute.counted(plain(rows, target, buckets, percent=30))


def test_ties_and_one_hot_id(spark):
    """A third of the rows has one id and one text, so one score; ranks still run from 1 without a gap."""
    rows = [(7, "a b c d e")] * 50 + [(i, f"word{i % 5} b c d e f") for i in range(100)]
    df = importance.resampled(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([("a b",)], "text string"), percent=60, least=5)
    got = rows_of(df)
    assert sorted(r[5] for r in got if r[5]) == list(range(1, 91))
    assert brute.counted(got) == brute.counted(plain(rows, ["a b"], 10_000, percent=60, least=5))


def test_empty_tables_and_string_ids(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a", "one two"), (None, None)], "doc_id string, text string")
    assert importance.resampled(none, none).count() == 0
    assert importance.resampled(none, some).count() == 0
    got = {r.doc_id: r for r in importance.resampled(some, none).collect()}
    assert got["a"].n_features == 3 and got[None].weight == 0 and got[None]["rank"] is None


def test_ring_goes_over_pieces(monkeypatch):
    """Words and runs that lie across the pieces in which a long text is read, and one word longer than many pieces."""
    monkeypatch.setattr(importance, "PIECE", 16)
    text = "Ab  c" * 40 + " " + "x" * 500 + " é日-y, z " + "!" * 60 + " end" * 9
    for n in (1, 2, 3, 5):
        words, found = features_of(text, n)
        pieces = list(importance.features(text.encode(), n, 1 << 32))
        assert sum(k for k, _ in pieces) == len(words)
        assert Counter(int(b) for _, x in pieces for b in x) == Counter(zlib.crc32(f.encode()) for f in found)
