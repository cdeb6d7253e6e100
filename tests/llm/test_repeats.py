import os
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest

from factloom.llm import rlz_dedup, suffix_dedup
from factloom.llm.repeats import Repeats
from tests.llm import brute


@pytest.mark.parametrize("group", [2000, 2])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, group):
    """With groups of two almost every key is hot and goes through the halving."""
    monkeypatch.setitem(Repeats.__init__.__kwdefaults__, "group", group)
    rows, size = brute.corpus(n=40), 40
    found = suffix_dedup.remove_repeats(brute.frame(spark, rows), size=size, gram=8).collect()
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[i : i + size] for _, t in texts for i in range(len(t) - size + 1))
    units = {k: t for k, (_, t) in enumerate(texts)}
    hit = brute.removed_by_windows(units, size, lambda w, _: seen[bytes(w)] > 1)
    expected = brute.counted((texts[k][0], len(t), bytes(b for b, h in zip(t, hit[k], strict=True) if not h)) for k, t in units.items())
    assert brute.counted((r.doc_id, r.n_bytes, bytes(r.kept)) for r in found) == expected


@pytest.mark.parametrize("group", [2000, 2])
def test_rlz_dedup_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setitem(Repeats.__init__.__kwdefaults__, "group", group)
    rows, size = brute.corpus(n=40), 12
    found = rlz_dedup.remove_copied(brute.frame(spark, rows), size=size, gram=4).collect()
    texts = [(i, brute.words(t)) for i, t in rows]
    least = -1
    first = defaultdict(lambda: 1 << 60)
    for i, w in texts:
        for a in range(len(w) - size + 1):
            k = tuple(w[a : a + size])
            first[k] = min(first[k], least if i is None else i)
    units = dict(enumerate(w for _, w in texts))
    hit = brute.removed_by_windows(units, size, lambda w, k: first[w] < (least if texts[k][0] is None else texts[k][0]))
    expected = brute.counted((texts[k][0], len(w), " ".join(x for x, h in zip(w, hit[k], strict=True) if not h)) for k, w in units.items())
    assert brute.counted((r.doc_id, r.n_words, r.kept) for r in found) == expected


@pytest.mark.parametrize("remove", [suffix_dedup.remove_repeats, rlz_dedup.remove_copied])
def test_empty_table(spark, remove):
    assert remove(brute.frame(spark, [])).count() == 0


def test_deep_shallow_sorts_like_sorted():
    rng = random.Random(3)
    base = bytes(rng.choice(b"ab") for _ in range(300))
    texts = [base[: rng.randint(0, 300)] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 5))) for _ in range(300)] + [base] * 4 + [b""] * 3
    length = np.array(list(map(len, texts)))
    suffixes = suffix_dedup.Suffixes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(length) - length, length)
    order, lcp = suffix_dedup.deep_shallow(suffixes, np.zeros(len(texts), np.int64))
    assert [texts[i] for i in order] == sorted(texts)
    assert sorted(order) == list(range(len(texts)))
    for k in range(1, len(order)):
        a, b = texts[order[k - 1]], texts[order[k]]
        n = lcp[k]
        assert a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1] or a == b


def test_both_halves_of_the_sort_order_members(monkeypatch):
    """Members of two keys around one shared anchor each: multikey quicksort splits parts on both sides, blind tries order the rest."""
    rng = random.Random(7)
    letters = lambda n: bytes(rng.choice(b"abcd") for _ in range(n))
    anchors, left, right = [letters(64), letters(64)], letters(500), letters(500)
    texts = []
    for k in range(60):
        a, b = bytearray(left), bytearray(right)
        a[-1 - rng.randrange(200)] ^= 1
        b[rng.randrange(200)] ^= 1
        texts.append(bytes(a) + anchors[k // 30] + bytes(b))
    length = np.array(list(map(len, texts)))
    block = SimpleNamespace(data=np.frombuffer(b"".join(texts), np.uint8), off=np.append(0, np.cumsum(length)), anchor=np.full(60, 500), group=np.arange(60) // 30)
    assert suffix_dedup.same_anchors(block, 64)
    tries = []
    blind = suffix_dedup.blind_order
    monkeypatch.setattr(suffix_dedup, "blind_order", lambda x, some, depth: tries.append(depth) or blind(x, some, depth))
    start = block.off[:-1]
    for data, at, n, known in ((block.data, start + 500, length - 500, 64), (block.data[::-1], len(block.data) - start - 500, np.full(60, 500), 0)):
        suffixes = suffix_dedup.Suffixes(data, at, n)
        order, cut = suffix_dedup.multikey(suffixes, block.group, known)
        assert 2 < cut.sum() < 60
        tries.clear()
        order, lcp = suffix_dedup.deep_shallow(suffixes, block.group, known)
        assert tries and set(tries) == {known + suffix_dedup.SHALLOW}
        for g in range(2):
            mine = [suffixes.texts[i] for i in order[g * 30 : g * 30 + 30]]
            assert mine == sorted(mine) and set(order[g * 30 : g * 30 + 30].tolist()) == set(range(g * 30, g * 30 + 30))
            assert [len(os.path.commonprefix(mine[k - 1 : k + 1])) for k in range(1, 30)] == lcp[g * 30 + 1 : g * 30 + 30].tolist()


def test_anchors_that_share_only_a_hash_are_told_apart():
    """Two different anchors under one key: nothing is taken as known, and what follows them does not count as shared."""
    texts = [b"x" * 64 + b"same" * 100, b"y" * 64 + b"same" * 100]
    length = np.array(list(map(len, texts)))
    ends = dict(before=np.zeros(2, np.int64), after=np.zeros(2, np.int64))
    block = SimpleNamespace(data=np.frombuffer(b"".join(texts), np.uint8), off=np.append(0, np.cumsum(length)), anchor=np.zeros(2, np.int64), group=np.zeros(2, np.int64), **ends)
    assert not suffix_dedup.same_anchors(block, 64)
    assert not len(suffix_dedup.compare(block)[0])
