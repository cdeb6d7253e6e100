"""Plain definitions that the operators are held against, and a small corpus with every odd case."""

from __future__ import annotations

import random
import re
from collections import Counter

LONG = 1 << 17


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus(seed: int = 1, n: int = 60, vocabulary: int = 400) -> list[tuple[int | None, str | None]]:
    """Random texts with exact and near copies, shared passages, repeats within, nulls, empties and a long text."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefghijklé日") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    text = lambda k: " ".join(rng.choice(pool) for _ in range(k))
    passage, line = text(90), text(12)
    out: list[tuple[int | None, str | None]] = []
    for i in range(n):
        kind = i % 8
        if kind == 0 or not out:
            t = text(rng.randint(1, 150))
        elif kind == 1:
            t = out[-1][1]
        elif kind == 2:
            w = words(out[-1][1])
            if w:
                w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 3:
            t = f"{text(20)}\t{passage}\n{text(rng.randint(0, 30))}"
        elif kind == 4:
            t = f"{line}\n{text(5)}\n{line}\n  \n{passage[:200]}"
        elif kind == 5:
            t = " ".join([text(3)] * 30)
        elif kind == 6:
            t = text(3)
        else:
            t = f"{text(10)} {passage} {text(10)} {passage}"
        out.append((i, t))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "x"), (None, text(60)), (n + 4, text(20_000)), out[3], out[3]]
    return out


def frame(spark, rows, extra: bool = True):
    """The corpus over several partitions, with columns whose names clash with those inside the operators."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.selectExpr("doc_id", "text", "'x' AS id", "'y' AS label", "1 AS key", "array(1) AS spans", "'z' AS kept", "cast(null AS string) AS n_words", "2 AS node", "'w' AS text_key")
    return df.repartition(3)


def removed_by_windows(units: dict, size: int, repeated) -> dict:
    """Which units of each text lie in a window for which repeated(window, key of the text) holds."""
    out = {}
    for key, u in units.items():
        hit = [False] * len(u)
        for i in range(len(u) - size + 1):
            if repeated(tuple(u[i : i + size]), key):
                hit[i : i + size] = [True] * size
        out[key] = hit
    return out


def components(sets: dict, percent: int) -> dict:
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in sets}


def counted(rows) -> Counter:
    return Counter(map(repr, rows))
