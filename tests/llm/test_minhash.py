import pytest

from factloom.llm import graph, minhash
from tests.llm import brute


def shingles(text, k):
    w = brute.words(brute.lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("percent", "block"), [(80, 500), (40, 2)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, percent, block):
    """At 40 percent many bands hold classes of several components; blocks of two split every group."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = [(i, t) for i, t in brute.corpus(seed=5, n=64, vocabulary=60) if i is not None]
    rows = list({i: (i, t) for i, t in rows}.values())
    found = minhash.near_duplicates(brute.frame(spark, rows), words=4, percent=percent, bands=24 if percent == 80 else 200).collect()
    sets = {i: shingles(t, 4) for i, t in rows}
    expected = brute.components(sets, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == {i: (len(s), expected[i], expected[i] == i) for i, s in sets.items()}


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "A b c d e f"), (2, None), (3, ""), (4, "one two"), (5, "one two"), (5, "one two"), (6, "two one")]
    found = minhash.near_duplicates(brute.frame(spark, rows)).collect()
    got = brute.counted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found)
    assert got == brute.counted([(None, 2, None, True), (1, 2, None, False), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (6, 1, 6, True)])
    assert minhash.near_duplicates(brute.frame(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, n)] + [(100, 101), (7, 7)], "a long, b long")
    labels = {r.node: r.label for r in graph.components(edges).collect()}
    assert labels == {i: 1 for i in range(1, n + 1)} | {100: 100, 101: 100}
