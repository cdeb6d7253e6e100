"""Secret scans: fixed patterns plus a linear-chain conditional random field.

Tokens are maximal runs of ASCII letters, digits and _ + / . -. The field tags
each as begin, inside or outside of a secret from its shape, the words and
marks around it and features of the whole text. Every token may be tagged;
those whose score for outside beats all that their neighbours could add are
outside on each best path, so Viterbi decoding falls apart exactly into the
runs of the others.
Training takes a bounded sample of texts (TRAIN_DOCS, by hash) tagged by the
fixed patterns, each secret once more without what stands around it, and
generated lines with secrets and harmless strings in other common formats. It
takes them in pieces cut between any two outside tokens, each given that its
neighbours are outside; equal pieces count together.
Scanning is one pass over the texts without a shuffle.

Defined cases: a null or empty text has no spans; spans are code points, end
exclusive; spans of the field that touch one of a pattern are left out; repeated
rows and ids each keep their own row; with no texts to train on the generated
lines alone are used; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm.shared import arrow_batches, read, sampled, spread
from factloom.llm.textnp import chunks, column, fold_table, prefix, span_hash, utf8, word_spans

#: Most texts that the field is trained on.
TRAIN_DOCS = 4000
#: How much a generated line counts beside a line of the corpus, which has few secrets.
GENERATED_WEIGHT = 10
#: Bytes of text whose tokens are described at once: some 200 bytes of arrays are held for each.
PART_BYTES = 1 << 17

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MASK = "[SECRET]"
KINDS = ("assign", "access", "hex", "crf")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words whose presence before a token is a feature.
CUES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "authorization", "credential", "access", "private", "client", "api", "id", "commit", "sha", "md5", "version", "phone", "call", "http", "https", "www", "isbn", "uuid")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        out += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in ACCESS.finditer(text)]
    out += [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


# Classes of bytes: bit masks summed over a token give its shape.
_DIGIT, _UPPER, _LOWER, _HEX, _EQUALS, _COLON, _QUOTE, _SPACE = range(8)
_SETS = [b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789abcdef", b"=", b":", b"\"'`", b" \t"]
_MARKS = b"_+/.-"


def _token_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(_SETS[0] + _SETS[1] + _SETS[2] + _MARKS)] = True
    return t


def _sums(buf: np.ndarray, members: bytes) -> np.ndarray:
    t = np.zeros(256, np.int32)
    t[list(members)] = 1
    return np.concatenate([[0], np.cumsum(t[buf], dtype=np.int32)])


_CUE_HASHES = None


def _cues() -> tuple[np.ndarray, np.ndarray]:
    global _CUE_HASHES
    if _CUE_HASHES is None:
        buf = np.frombuffer("".join(CUES).encode(), np.uint8)
        end = np.cumsum([len(c) for c in CUES])
        h = span_hash(prefix(buf), np.append(0, end[:-1]), end)
        order = np.argsort(h)
        _CUE_HASHES = h[order], order
    return _CUE_HASHES


#: Sizes of the feature groups, in the order of features().
GROUPS = (1, 11, 5, 5, 5, 2, 2, 6, 6, len(CUES) + 2, len(CUES) + 2, 5, 4, 4, 4, 6, 88)
N_FEATURES = sum(GROUPS)
_STARTS = np.cumsum([0, *GROUPS[:-1]])
#: The groups that tell what stands around a token, and their values where nothing telling does.
_AROUND = {9: len(CUES), 10: len(CUES), 11: 0, 12: 0}


class Tokens:
    """The tokens of some rows; those of a row are a run."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        s, e, rows = word_spans(buf, off, _token_table())
        digits = _sums(buf, _SETS[_DIGIT])
        self.n = len(s)
        self.start, self.end = s, e
        self.row = np.searchsorted(off, s, "right") - 1
        self.runs = rows[:-1][np.diff(rows) > 0]
        at = np.arange(self.n)
        self.features = self._features(buf, off, s, e, rows, at, digits) if self.n else np.zeros((0, len(GROUPS)), np.int32)

    def _features(self, buf, off, s, e, rows, at, digits) -> np.ndarray:
        a, b = s[at], e[at]
        n = b - a
        count = lambda k, x, y: (sums := _sums(buf, _SETS[k]))[y] - sums[x]
        d, up, lo, hexes = digits[b] - digits[a], count(_UPPER, a, b), count(_LOWER, a, b), count(_HEX, a, b)
        share = lambda x: np.minimum(4, (5 * x) // np.maximum(n, 1))
        kind = np.zeros(256, np.int8)
        for k, members in enumerate((_SETS[_DIGIT], _SETS[_UPPER], _SETS[_LOWER])):
            kind[list(members)] = k + 1
        kinds = kind[buf]
        changes = np.concatenate([[0], np.cumsum(np.append(0, kinds[1:] != kinds[:-1]))])
        turns = changes[b] - changes[a + 1]
        marks = sum((((m := _sums(buf, bytes([c])))[b] - m[a]) > 0).astype(np.int32) << k for k, c in enumerate(b"-/"))
        first, last = off[self.row], off[self.row + 1]
        before = np.where(at - 1 >= rows[self.row], e[at - 1], first)
        after = np.minimum(np.where(at + 1 < rows[self.row + 1], s[np.minimum(at + 1, len(s) - 1)], last), last)
        gap = lambda k: count(k, before, a) > 0
        mark = np.select([gap(_EQUALS), gap(_COLON), gap(_QUOTE), a - before > 2], [4, 3, 2, 1], 0)
        quoted = (count(_QUOTE, b, np.minimum(after, b + 1)) > 0) + 2 * gap(_QUOTE)
        low = fold_table(True)[buf]
        hashes = span_hash(prefix(low), s, e)
        keys, order = _cues()

        def cue(back: int) -> np.ndarray:
            j = at - back
            inside = j >= rows[self.row]
            h = hashes[np.maximum(j, 0)]
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            return np.where(inside, np.where(keys[k] == h, order[k], len(CUES)), len(CUES) + 1)

        size = np.maximum(last - first, 1)
        long = np.searchsorted([4, 6, 8, 12, 16, 20, 24, 32, 40, 64], n, "right")
        vowels = (m := _sums(low, b"aeiou"))[b] - m[a]
        vowel_share = np.where(up + lo > 0, share(vowels * n // np.maximum(up + lo, 1)), 5)
        density = lambda k, unit: np.minimum(3, (count(k, first, last) * unit) // size)
        columns = [
            np.zeros(len(at), np.int64), long, share(d), share(up), share(lo), (hexes == n).astype(int), (d == n).astype(int),
            np.minimum(5, turns * 8 // np.maximum(n, 1)), np.minimum(5, marks + 4 * ((digits[b] == digits[a]))), cue(1), cue(2), mark, quoted, density(_EQUALS, 1000), density(_DIGIT, 50), vowel_share, long * 8 + (d > 0) + 2 * (up > 0) + 4 * (lo > 0),
        ]
        return np.stack([np.minimum(np.maximum(c, 0), g - 1) + z for c, g, z in zip(columns, GROUPS, _STARTS, strict=True)], axis=1).astype(np.int32)


OUTSIDE, BEGIN, INSIDE = range(3)
_FORBIDDEN = -1e4


class Field:
    """Weights of features for each tag, and of transitions."""

    def __init__(self):
        self.weights, self.moves = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3))
        for c in range(features.shape[1]):
            out += self.weights[features[:, c]]
        return out

    def transitions(self) -> np.ndarray:
        m = self.moves.copy()
        m[OUTSIDE, INSIDE] = _FORBIDDEN
        return m

    def outside(self, e: np.ndarray, m: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """Tokens that are outside on every best path: on any path, making one outside (and a next inside token a beginning) gains."""
        gap = np.zeros(len(e))  # what inside gains over beginning at the next token
        gap[:-1] = e[1:, INSIDE] - e[1:, BEGIN]
        gap[runs[1:] - 1] = _FORBIDDEN
        gap[-1:] = _FORBIDDEN
        sure = np.ones(len(e), bool)
        longer = max(m[INSIDE, q] - m[BEGIN, q] for q in (OUTSIDE, BEGIN, INSIDE))
        for t in (BEGIN, INSIDE):
            enter = max(m[p, t] - m[p, OUTSIDE] for p in (OUTSIDE, BEGIN, INSIDE) if (p, t) != (OUTSIDE, INSIDE))
            leave = max(m[t, q] - m[OUTSIDE, q] for q in (OUTSIDE, BEGIN))
            go_on = m[t, INSIDE] - m[OUTSIDE, BEGIN] + longer
            sure &= e[:, OUTSIDE] - e[:, t] > enter + np.maximum(leave, go_on + gap) + 1e-9
        return sure

    def viterbi(self, features: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """Best tags of all runs; each starts and ends beside an outside token."""
        e, m = self.scores(features), self.transitions()
        first = np.zeros(len(e), bool)
        first[runs] = True
        sure = self.outside(e, m, runs)
        tags, at = np.zeros(len(e), np.int8), np.flatnonzero(~sure)
        if len(at):
            tags[at] = self._paths(e[at], m, np.flatnonzero(first[at] | (np.diff(at, prepend=-2) != 1)))
        return tags

    def _paths(self, e: np.ndarray, m: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """Best tags of tokens with scores e. Steps go over all runs at once."""
        n = len(e)
        length = np.diff(np.append(runs, n))
        order = np.argsort(-length, kind="stable")
        starts, length = runs[order], length[order]
        best = e[starts] + m[OUTSIDE]
        back = np.zeros((n, 3), np.int8)
        final = np.zeros((len(starts), 3))
        live = len(starts)
        for t in range(1, int(length[0]) + 1 if len(length) else 0):
            now = int(np.searchsorted(-length, -t, "left"))  # runs longer than t
            final[now:live] = best[now:live]
            live = now
            if not live:
                break
            at = starts[:live] + t
            options = best[:live, :, None] + m[None]
            back[at] = options.argmax(axis=1)
            best[:live] = options.max(axis=1) + e[at]
        tags = np.zeros(n, np.int8)
        now = (final + m[:, OUTSIDE]).argmax(axis=1).astype(np.int8)
        for t in reversed(range(int(length[0]) if len(length) else 0)):
            live = int(np.searchsorted(-length, -t, "left"))
            at = starts[:live] + t
            tags[at] = now[:live]
            now[:live] = back[at, now[:live]]
        return tags

    def fit(self, features: np.ndarray, runs: np.ndarray, tags: np.ndarray, counts: np.ndarray, rounds: int = 200, rate: float = 0.15, decay: float = 1e-4) -> None:
        """Maximum likelihood by Adam on all runs, each seen so often as counts says, with exact marginals by forward-backward."""
        n = len(features)
        length = np.diff(np.append(runs, n))
        state = [[np.zeros_like(x), np.zeros_like(x)] for x in (self.weights, self.moves)]
        by = [(k, runs[length == k][:, None] + np.arange(k), counts[length == k].astype(float)) for k in np.unique(length).tolist()]
        for i in range(1, rounds + 1):
            e, m = self.scores(features), self.transitions()
            g_e, g_m = np.zeros_like(e), decay * self.moves
            for k, at, times in by:
                x, y = e[at], tags[at]
                alpha, beta = np.empty_like(x), np.empty_like(x)
                alpha[:, 0] = x[:, 0] + m[OUTSIDE]
                for t in range(1, k):
                    alpha[:, t] = x[:, t] + np.logaddexp.reduce(alpha[:, t - 1, :, None] + m[None], axis=1)
                beta[:, -1] = m[:, OUTSIDE]
                for t in reversed(range(k - 1)):
                    beta[:, t] = np.logaddexp.reduce(m[None] + (x[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
                z = np.logaddexp.reduce(alpha[:, -1] + beta[:, -1], axis=1)
                p = np.exp(alpha + beta - z[:, None, None])
                g_e[at] = (p - np.eye(3)[y]) * times[:, None, None]
                g_m[OUTSIDE] += g_e[at][:, 0].sum(axis=0)
                g_m[:, OUTSIDE] += g_e[at][:, -1].sum(axis=0)
                for t in range(1, k):
                    both = np.exp(alpha[:, t - 1, :, None] + m[None] + (x[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
                    g_m += (both * times[:, None, None]).sum(axis=0)
                    np.subtract.at(g_m, (y[:, t - 1], y[:, t]), times)
            g_w = decay * n * self.weights
            for c in range(features.shape[1]):
                for tag in range(3):
                    g_w[:, tag] += np.bincount(features[:, c], g_e[:, tag], N_FEATURES)
            for value, grad, (first, second) in zip((self.weights, self.moves), (g_w, g_m), state, strict=True):
                first += 0.1 * (grad - first)
                second += 0.01 * (grad * grad - second)
                value -= rate * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)


def points(buf: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    return np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = column(batch, "text")
        buf, off = utf8(texts)
        for a, b in chunks(off, PART_BYTES):
            f, runs, tags = tagged(texts[a:b].to_pylist(), buf[off[a] : off[b]], off[a : b + 1] - off[a])
            f, runs, tags = with_masked(f, runs, tags)
            starts, counts = pieces(f, runs, tags)
            length = np.diff(np.append(starts, len(f)))
            kept = counts > 0
            rows = np.repeat(kept, length)
            ends = np.append(0, np.cumsum(length[kept])).astype(np.int32)
            features = pa.ListArray.from_arrays(pa.array(ends * len(GROUPS)), pa.array(f[rows].reshape(-1)))
            yield pa.RecordBatch.from_arrays([features, pa.ListArray.from_arrays(pa.array(ends), pa.array(tags[rows].astype(np.int32))), pa.array(counts[kept])], names=["features", "tags", "n"])


def with_masked(features: np.ndarray, runs: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adds each token that is a secret alone once more, as a run of its own with nothing telling around it: the field is to know
    secrets by their shape too, not only by the words that the fixed patterns know them by."""
    alone = np.flatnonzero((tags == BEGIN) & (np.append(tags[1:], OUTSIDE) != INSIDE))
    bare = features[alone].copy()
    for k, value in _AROUND.items():
        bare[:, k] = _STARTS[k] + value
    return np.concatenate([features, bare]), np.concatenate([runs, len(tags) + np.arange(len(alone))]), np.concatenate([tags, tags[alone]])


def pieces(features: np.ndarray, runs: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces of runs, and how often each is seen: equal outside tokens that stand alone count at the first, 0 at the others."""
    at = np.arange(len(tags))
    new = np.zeros(len(tags), bool)
    new[runs] = True
    new[1:] |= (tags[1:] == OUTSIDE) & (tags[:-1] == OUTSIDE)
    # Pieces are cut at 32 tokens, which bounds the groups of equal length.
    since = at - np.maximum.accumulate(np.where(new, at, 0))
    new |= (since % 32 == 0) & (tags != INSIDE)
    starts = np.flatnonzero(new)
    counts = np.ones(len(starts), np.int64)
    alone = np.flatnonzero((np.diff(np.append(starts, len(tags))) == 1) & (tags[starts] == OUTSIDE))
    if len(alone):
        _, first, inverse = np.unique(features[starts[alone]], axis=0, return_index=True, return_inverse=True)
        counts[alone] = 0
        counts[alone[first]] = np.bincount(inverse.reshape(-1))
    return starts, counts


def values(text: str) -> list[tuple[int, int]]:
    """The secrets themselves in the spans of the fixed patterns: of an assignment, what is assigned."""
    return [(ASSIGN.match(text, x).start(2) if kind == 0 else x, y) for kind, x, y in base_spans(text)]


def tagged(texts: list[str | None], buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, runs and tags of texts; a token that a pattern finds secret is part of a secret."""
    tokens, at = Tokens(buf, off), points(buf)
    spans = [(at[off[i]] + x, at[off[i]] + y) for i, t in enumerate(texts) if t for x, y in values(t)]
    tags = np.zeros(tokens.n, np.int64)
    for x, y in spans:
        inside = np.flatnonzero((at[tokens.start] < y) & (at[tokens.end] > x))
        if len(inside):
            tags[inside] = INSIDE
            tags[inside[0]] = BEGIN
    prev = np.concatenate([[OUTSIDE], tags[:-1]])
    first = np.zeros(len(tags), bool)
    first[tokens.runs] = True
    tags[(tags == INSIDE) & (first | (prev == OUTSIDE))] = BEGIN
    return tokens.features, tokens.runs, tags


def generated(seed: int = 7, n: int = 60) -> tuple[list[str], list[tuple[int, int]]]:
    """Lines with secrets in common formats and lines with harmless long tokens; (start, end) of the secret, or (0, 0)."""
    rng = np.random.default_rng(seed)
    pick = lambda alphabet, k: "".join(rng.choice(list(alphabet), k))
    word = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    lines, spans = [], []
    for _ in range(n):
        low = "abcdefghijklmnopqrstuvwxyz"
        some = lambda alphabet, a, b: pick(alphabet, int(rng.integers(a, b)))
        for before, secret in (
            ("Authorization: Bearer ", pick(word, 40)), ("client secret ", pick(word, 32)), ("auth = '", pick(word, 24)), ("access key: ", pick(word + "+/", 40)), ("pwd=", pick(word, 12)), ("private key ", pick("0123456789ABCDEF", 40)),
            ("pwd=", some(low, 5, 16)), ("pwd: ", some(low + "0123456789", 5, 10)), ("Authorization: Bearer ", some(low, 10, 24)), ("client secret ", some(word[:52], 10, 24)), ("auth = '", some(low, 6, 20)), ("bearer ", some(word, 10, 30)), ("access key: ", some(word, 6, 20)),
        ):
            lead, after = ("set ", "", "then\n")[rng.integers(3)], ("' for it", " for it", "", "\nthen")[rng.integers(4)]
            lines.append(f"{lead}{before}{secret}{after}")
            spans.append((len(lead + before), len(lead + before + secret)))
        # Secrets with nothing telling around them.
        for secret in (
            some(word, 20, 64), some(word + "._-", 40, 160), f"{some(low, 2, 5)}_{some(word, 18, 40)}", f"{some(low, 2, 6)}_{some(low, 3, 6)}_{some(word, 16, 40)}", some(word + "+/", 30, 64), some("0123456789ABCDEF", 24, 64), f"{some(word, 12, 30)}-{some(word, 12, 30)}", f"{some(word, 16, 40)}.{some(word, 16, 60)}",
        ):
            lead = " ".join(some(low, 2, 10) for _ in range(int(rng.integers(1, 4)))) + (" ", ": ", " '", "=")[rng.integers(4)]
            lines.append(f"{lead}{secret} {some(low, 2, 10)}")
            spans.append((len(lead), len(lead + secret)))
        number = lambda a, b: some("0123456789", a, b)
        name = lambda a, b: some(low, a, b).capitalize()
        for plain in (
            f"call {number(3, 4)}-{number(3, 4)}-{number(4, 5)} now", f"on 20{number(2, 3)}-01-02T10.00 it", f"see www.site{number(2, 3)}.org/page for more", f"version {number(2, 3)}.{number(3, 4)}.{number(4, 5)} of it", f"number {number(9, 20)} is", f"{some(low, 2, 9)} {number(9, 20)} {some(low, 2, 9)}", f"key {number(6, 20)}, token {some(low, 3, 9)} {number(9, 20)}", f"at {number(2, 4)}.{number(2, 3)}.{number(3, 4)}.{number(2, 3)} there",
            f"the {some(low, 2, 14)} of {some(low, 2, 14)} {some(low, 2, 24)} and {some(low, 2, 14)}.", f"note: {some(low, 3, 12)} = {some(low, 2, 12)}, '{some(low, 3, 12)}'", f"The client {some(low, 3, 12)} had access {some(low, 2, 12)} to a private {some(low, 3, 12)}", f"a secret {some(low, 3, 12)}, the key {some(low, 3, 12)} and a token {some(low, 3, 12)}", f"id: {number(5, 6)} at https://{some(low, 3, 12)}.org/{some(low, 3, 9)}",
            f"in {some(low, 3, 9)}_{some(low, 3, 9)}_{some(low, 3, 9)} of {name(3, 9)}{name(3, 9)}{name(3, 9)}", f"see /{some(low, 3, 9)}/{some(low, 3, 9)}/{some(low, 3, 9)}-{number(1, 5)}/{some(low, 3, 9)}.html", f"mail {some(low, 3, 9)}.{some(low, 3, 9)}{number(1, 4)}@{some(low, 3, 9)}.{some(low, 2, 9)} today", f"file IMG_20{number(6, 7)}_{number(6, 7)}.jpg and {some(low, 3, 9)}-{some(low, 3, 9)}-{some(low, 3, 9)}-{some(low, 3, 9)}",
            f"{some(low, 4, 20).upper()} {some(low, 3, 9)}{number(1, 5)} {name(2, 20)}-{name(2, 20)} {name(10, 30)}", f"isbn 978-{number(1, 2)}-{number(4, 5)}-{number(4, 5)}-{number(1, 2)} or {number(1, 4)}/{number(1, 4)}/{number(4, 5)}", f"part {some(low, 1, 4).upper()}-{number(2, 7)}-{some(low, 1, 3).upper()} of {some(low, 2, 9)}.{some(low, 2, 9)}.{some(low, 2, 9)}({number(1, 5)})",
        ):
            lines.append(plain)
            spans.append((0, 0))
    return lines, spans


def train(docs: DataFrame, *, id_col: str | None = None, text_col: str = "text", sample: int = TRAIN_DOCS) -> Field:
    """Fits a field to at most `sample` texts, chosen by hash of the text and the id, if there is one, and to the generated lines;
    equal rows count once."""
    arrow_batches(docs.sparkSession)
    some = sampled(docs.where(F.col(text_col).isNotNull()), sample, *([id_col] if id_col else []), text_col)
    texts = some.select(F.col(text_col).alias("text"))
    found = texts.mapInArrow(_training, "features array<int>, tags array<int>, n long").groupBy("features", "tags").agg(F.sum("n").alias("n")).orderBy(F.xxhash64("features", "tags")).toArrow()
    flat = lambda name: np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy() for c in found[name].chunks)])
    lengths = np.concatenate([np.zeros(0, np.int32), *(c.value_lengths().to_numpy() for c in found["tags"].chunks)]).astype(np.int64)
    lines, spans = generated()
    buf, off = utf8(pa.array(lines, pa.string()))
    tokens = Tokens(buf, off)
    begin = np.array([spans[r][0] <= s - off[r] < spans[r][1] for r, s in zip(tokens.row.tolist(), tokens.start.tolist(), strict=True)])
    made = np.where(begin, BEGIN, OUTSIDE)
    starts, counts = pieces(tokens.features, tokens.runs, made)
    features = np.concatenate([flat("features").reshape(-1, len(GROUPS)), tokens.features]).astype(np.int32)
    runs = np.concatenate([np.cumsum(lengths) - lengths, lengths.sum() + starts])
    field = Field()
    field.fit(features, runs, np.concatenate([flat("tags"), made]).astype(np.int64), np.concatenate([found["n"].to_numpy(), GENERATED_WEIGHT * counts]))
    return field


def _scanning(broadcast, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = broadcast.value
        for batch in batches:
            texts = column(batch, "text")
            buf, off = utf8(texts)
            plain = texts.to_pylist()
            spans: list[list[tuple[int, int, int]]] = [base_spans(t) if t else [] for t in plain]
            for a, b in chunks(off, PART_BYTES):
                part, rows = buf[off[a] : off[b]], off[a : b + 1] - off[a]
                tokens = Tokens(part, rows)
                if not tokens.n:
                    continue
                tags = field.viterbi(tokens.features, tokens.runs)
                begin = np.flatnonzero(tags == BEGIN)
                if not len(begin):
                    continue
                at = points(part)
                for i in begin.tolist():
                    j = i
                    while j + 1 < tokens.n and tags[j + 1] == INSIDE:
                        j += 1
                    row = int(tokens.row[i])
                    zero = at[rows[row]]
                    x, y = int(at[tokens.start[i]] - zero), int(at[tokens.end[j]] - zero)
                    spans[a + row].append((3, x, y))
            out = []
            for found in spans:
                base = [f for f in found if f[0] < 3]
                out.append(sorted([*base, *(f for f in found if f[0] == 3 and not any(x < f[2] and f[1] < y for _, x, y in base))], key=lambda x: (x[1], x[0])))
            made = pa.array([[{"kind": KINDS[k], "start": x, "end": y} for k, x, y in found] for found in out], schema.field("spans").type)
            made_of = {"spans": made}
            if "redacted" in schema.names:
                made_of["redacted"] = pa.array(map(masked, plain, out), pa.string())
            yield pa.RecordBatch.from_arrays([made_of[f.name] if f.name in made_of else column(batch, f.name) for f in schema], schema=schema)

    return run


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """One row (id[, redacted], spans by start and kind) for each row of docs; redacted is the text with its secrets masked."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("id", to_arrow_type(kind)), *([("redacted", pa.string())] if redact else []), ("spans", pa.list_(span))])
    found = rows.mapInArrow(_scanning(spark.sparkContext.broadcast(field), schema), f"id {kind.simpleString()}, {'redacted string, ' * redact}spans {SPANS}")
    return found.withColumnRenamed("id", id_col)


def masked(text: str | None, spans: list[tuple[int, int, int]], mask: str = MASK) -> str | None:
    """The text with each union of overlapping spans (kind, start, end; by start) replaced by the mask."""
    if not text or not spans:
        return text
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _listed(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents", "doc_id", "text"))
    found = scan(docs, train(docs, id_col="doc_id"))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
