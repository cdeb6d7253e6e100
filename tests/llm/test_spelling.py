import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import spelling
from tests.llm import brute


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain(n: dict[str, int], ratio: int) -> list[tuple]:
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return [(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] is not None else None) for w in n]


def small_words(seed: int, size: int) -> dict[str, int]:
    """Words over few letters, so that runs of one letter and crowded neighbourhoods are common; counts from 1 to a million."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé😀") for _ in range(rng.randint(0, 7))) for _ in range(size)}
    return {w: 10 ** rng.randint(0, 6) for w in words} | {"abababab" * 40: 5, "abababab" * 40 + "b": 70}


def rows_of(spark, n: dict, parts: int = 3, **options):
    df = spark.createDataFrame([(w, k, 1, "x") for w, k in n.items()], "word string, n long, id int, form string")
    return [tuple(r) for r in spelling.variants(df.repartition(parts), **options).collect()]


def check(got, expected):
    assert brute.counted(got) == brute.counted(expected)


@pytest.mark.parametrize("ratio", [10, 2])
def test_forms_of_the_plain_definition(spark, ratio):
    n = small_words(ratio, 700)
    expected = plain(n, ratio)
    assert max(sum(1 for _ in iter(lambda w=[r[0]], m={x[0]: x[1] for x in expected}: w.__setitem__(0, m[w[0]]) or w[0], None)) for r in expected) >= 3  # chains of several links
    check(rows_of(spark, n, ratio=ratio), expected)


def test_keys_that_collide_link_nothing(spark, monkeypatch):
    """With keys of six bits nearly all rows meet; the strings decide."""
    keys = spelling.deletion_keys
    monkeypatch.setattr(spelling, "deletion_keys", lambda cp, off: tuple(x & np.uint64(63) for x in keys(cp, off)))
    n = small_words(5, 150)
    words = sorted(n)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(words)), pa.int64()), pa.array(words)], names=["id", "word"])
    rows = pa.Table.from_batches(list(spelling._keying(iter([batch]))))
    found = spelling._matching(rows).to_pylist()
    assert len(found) > rows.num_rows / 2
    met = spark.createDataFrame([(x["role"], x["at"], words[x["id"]], n[words[x["id"]]]) for x in found], "role int, at int, word string, n long")
    got = {r.word: (r.n_near, r.form, r.form_n) for r in spelling.verified(met).collect()}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    assert got == {w: (len(near[w]), b, n[b]) for w, b in best.items()}


def test_keys_tell_deletions():
    words = ["", "a", "aab", "ab", "é日😀", "x" * 300]
    cp = np.array([ord(c) for w in words for c in w], np.uint32)
    off = np.cumsum([0, *map(len, words)])
    without, whole = spelling.deletion_keys(cp, off)
    again = [w[:i] + w[i + 1 :] for w in words for i in range(len(w))]
    _, expected = spelling.deletion_keys(np.array([ord(c) for w in again for c in w], np.uint32), np.cumsum([0, *map(len, again)]))
    assert (without == expected).all() and len(set(whole.tolist())) == len(words)


def test_defined_cases(spark):
    rows = [("same", 3), ("same", 4), (None, 9), ("sane", 70), ("", 2), ("x", 20), ("y", 20)]
    got = spelling.variants(spark.createDataFrame(rows, "word string, n long"))
    check([tuple(r) for r in got.collect()], plain({"same": 7, "sane": 70, "": 2, "x": 20, "y": 20}, 10))
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    a, b = "acgt" * 30_000, "acgt" * 30_000 + "a"  # very long words: a key for each letter, never a copy of the word
    check(rows_of(spark, {a: 1, b: 10, "acgt": 5}), [(a, b, b, 1, 1, 10), (b, None, b, 10, 1, None), ("acgt", None, "acgt", 5, 0, None)])


def plain_words(docs, length=7, count=2, rare=31):
    total = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = brute.lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % rare == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= length and n >= count}


@pytest.mark.parametrize("piece", [1 << 20, 8])
def test_words_of_texts(spark, monkeypatch, piece):
    rows = [*brute.corpus(seed=9, n=60), (900, "Ünder×÷stand " * 5 + "abcdefgh-ABCDEFGH_abcdefgh1abcdefgh"), (901, "x" * 300)]
    run = spelling._perturbing(spelling.LETTERS, 7, 31)
    if piece > 8:
        got = {r.word: r.n for r in spelling.perturbed_words(brute.frame(spark, rows)).collect()}
        assert got == plain_words(rows)
    monkeypatch.setattr(spelling, "PIECE", piece)
    batch = pa.RecordBatch.from_arrays([pa.array([None if i is None else str(i) for i, _ in rows]), pa.array([t for _, t in rows])], names=["id", "text"])
    total = Counter()
    for part in run(iter([batch])):
        for w, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
            total[w] += n
    assert {w: n for w, n in total.items() if n >= 2} == plain_words(rows)
