import random
import re
from collections import defaultdict

import numpy as np

from factloom.llm import decontaminate, fm_index
from tests.llm import brute

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_SYMBOLS", 300)
    rows = brute.corpus(seed=9, n=40)
    items = [(1, rows[3][1][10:900]), (10, "Ab, changed"), (2, None), (3, "--- !"), (4, rows[4][1]), (None, rows[0][1]), (4, "changed")]
    df = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "1 AS id", "2 AS spans")
    found = decontaminate.judged(decontaminate.decontaminate(brute.frame(spark, rows), df)).collect()
    windows = defaultdict(set)
    for name, t in items:
        w = WORD.findall(brute.lower(t or ""))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add("" if name is None else str(name))
    expected = []
    for i, t in rows:
        w, hit, names = WORD.findall(brute.lower(t or "")), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    names |= windows[tuple(w[a : a + n])]
        expected.append((i, len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
    assert brute.counted((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in found) == brute.counted(expected)


def test_blocks_give_the_same_rows(spark, monkeypatch):
    rows = brute.corpus(seed=9, n=24)
    items = spark.createDataFrame([(k, rows[k][1]) for k in range(20)], "item_id long, text string")
    read = lambda: brute.counted(map(tuple, decontaminate.decontaminate(brute.frame(spark, rows), items).collect()))
    whole = read()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4000)
    assert read() == whole


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.decontaminate(brute.frame(spark, [(1, "a b"), (2, None)]), none).collect()
    assert sorted((r.doc_id, r.n_words, r.item_ids) for r in found) == [(1, 2, []), (2, 0, [])]
    assert decontaminate.decontaminate(brute.frame(spark, []), none).count() == 0


def test_index_finds_every_occurrence():
    rng = random.Random(2)
    symbols = [0]
    for _ in range(30):
        symbols += [rng.randint(1, 4) for _ in range(rng.randint(1, 60))] + [0]
    index = fm_index.FMIndex(np.array(symbols), 5)
    for n in (1, 2, 5):
        phrases = np.array([[rng.randint(1, 4) for _ in range(n)] for _ in range(50)])
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases.tolist(), lo, hi, strict=True):
            at = sorted(index.locate(np.arange(a, b)).tolist())
            assert at == [i for i in range(len(symbols) - n + 1) if symbols[i : i + n] == p]
