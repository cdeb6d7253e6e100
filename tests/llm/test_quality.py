import random
from collections import Counter

from pyspark.sql import functions as F

from factloom.llm import quality
from tests.llm import brute


def repeated(words: list[str], size: int = 8) -> int:
    seen = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    hit = {i + k for i in range(len(words) - size + 1) if seen[tuple(words[i : i + size])] > 1 for k in range(size)}
    return len(hit)


def corpus() -> list[str]:
    rng = random.Random(5)
    own = iter(range(10**6))
    fresh = lambda n: [f"w{next(own)}" for _ in range(n)]
    texts = [[], ["a"], ["a"] * 8, ["a"] * 9, ["a"] * 40, list("ab") * 9, fresh(300)]
    for n in range(6, 11):  # one passage of n words twice, apart, touching, and at both ends
        run = fresh(n)
        texts += [[*fresh(20), *run, *fresh(9), *run, *fresh(20)], run + run, [*run, *fresh(3), *run]]
    texts += [[rng.choice("abcd") for _ in range(rng.randint(0, 400))] for _ in range(60)]
    texts += [[rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 900))] for _ in range(20)]
    return [" ".join(x) for x in texts]


def test_repeated_windows_are_found_by_doubling(spark):
    rows = list(enumerate(corpus()))
    found = quality.statistics(brute.frame(spark, rows)).collect()
    expected = {i: repeated(t.split()) for i, t in rows}
    assert {r.doc_id: r.n_repeat_words for r in found} == expected
    assert sum(x > 0 for x in expected.values()) > 20 < sum(x == 0 for x in expected.values())


def test_texts_without_repeats_get_no_windows(spark):
    """Only where a window does repeat are windows sorted and compared."""
    rows = list(enumerate(corpus()))
    hashes = brute.frame(spark, rows).select("doc_id", F.expr("transform(array_remove(split(text, ' '), ''), w -> xxhash64(w))").alias("hashes"))
    sizes = {r.doc_id: r.n for r in quality._windows(hashes).select("doc_id", F.size("windows").alias("n")).collect()}
    assert sizes == {i: max(0, len(t.split()) - 7) if repeated(t.split()) else 0 for i, t in rows}
