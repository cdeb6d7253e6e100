"""Splits text into the pieces within which byte-level BPE merges, over arrays of code points.

The pieces are those of the pattern
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
and the strings of added tokens, which stand alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from factloom.llm.textnp import chunks, gather, prefix, span_hash, utf8

OTHER, LETTER, NUMBER, SPACE = range(4)
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point."""
    if not _classes:
        table = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                a, b = (x + 0x800 * (x >= 0xD800) for x in m.span())
                table[a:b] = kind
        _classes.append(table)
    return _classes[0]


def boundaries(cp: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """True where a piece starts; cuts are the starts of texts, between which no piece reaches."""
    n = len(cp)
    cls = classes()[cp]
    is_cut = np.zeros(n + 3, bool)
    is_cut[cuts] = True
    is_cut[n:] = True
    start = is_cut[:n].copy()
    start[1:] |= cls[1:] != cls[:-1]
    # A run of spaces before something else: its last one stands apart, and a blank joins what follows.
    p = np.flatnonzero((cls[:-1] == SPACE) & (cls[1:] != SPACE) & ~is_cut[1:n])
    start[p] = True
    start[p[cp[p] == 0x20] + 1] = False
    # Contractions, where an apostrophe starts a piece and a letter follows.
    q = np.flatnonzero((cp == 0x27) & start & ~is_cut[1 : n + 1])
    q = q[cls[q + 1] == LETTER]
    if len(q):
        a = cp[q + 1]
        b = np.where(is_cut[q + 2], 0, cp[np.minimum(q + 2, n - 1)])
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        start[q[one | two] + 1] = False
        for more, which in ((2, one), (3, two)):
            at = q[which] + more
            start[at[at < n]] = True
    return start


def code_points(buf: np.ndarray, off: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """The text of some rows, its code points, and where each row starts in them."""
    raw = buf.tobytes()
    try:
        text = raw.decode()
        at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[off]
    except UnicodeDecodeError:
        rows = [raw[a:b].decode(errors="replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        text, at = "".join(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    return text, np.frombuffer(text.encode("utf-32-le"), np.uint32), at.astype(np.int64)


class Grown:
    """Numbers that others are added behind; room doubles, so that few are copied."""

    def __init__(self, kind: type, some: int = 0):
        self.room, self.size = np.zeros(1 << 12, kind), some

    def add(self, more: np.ndarray) -> None:
        end = self.size + len(more)
        if end > len(self.room):
            room = np.empty(max(end, 2 * len(self.room)), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : end] = more
        self.size = end

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.size]


class Encoder:
    """Token ids of texts: every distinct piece is encoded once and kept, up to a bound."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], added: dict[str, int], bound: int = 500_000):
        self.encode, self.added, self.bound = encode, added, bound
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.offsets = Grown(np.uint32), Grown(np.int64, 1)
        self.letters, self.places = Grown(np.uint32), Grown(np.int64, 1)  # code points of the pieces

    def __call__(self, arr: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For bounded ranges of rows: first row, end row, all ids, the offsets of each row's ids."""
        buf, off = utf8(arr)
        for a, b in chunks(off):
            text, cp, rows = code_points(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            if not len(cp):
                yield a, b, np.zeros(0, np.uint32), np.zeros(b - a + 1, np.int64)
                continue
            found = self.find(text, rows)
            cuts = np.unique(np.concatenate([rows[rows < len(cp)], *[np.array([x, y]) for x, y, _ in found if y < len(cp)], *[np.array([x]) for x, y, _ in found if y >= len(cp)]]).astype(np.int64))
            start = boundaries(cp, cuts)
            for x, y, _ in found:
                start[x + 1 : y] = False
            s = np.flatnonzero(start)
            e = np.append(s[1:], len(cp))
            keys = span_hash(prefix(cp), s, e)
            slot = self.checked(self.slots_of(keys, text, s, e), text, cp, s, e)
            offsets = self.offsets.all
            at = offsets[slot]
            n = offsets[slot + 1] - at
            ids = self.ids.all[gather(at, n)]
            yield a, b, ids, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(s, rows)]

    def find(self, text: str, rows: np.ndarray) -> list[tuple[int, int, int]]:
        """Leftmost added tokens that lie within one row."""
        out = []
        for name, i in self.added.items():
            at = text.find(name)
            while at >= 0:
                end = at + len(name)
                if np.searchsorted(rows, at, "right") == np.searchsorted(rows, end - 1, "right"):
                    out.append((at, end, i))
                    at = text.find(name, end)
                else:
                    at = text.find(name, at + 1)
        return sorted(out)

    def slots_of(self, keys: np.ndarray, text: str, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        if len(self.keys) > self.bound or self.letters.size > 16 * self.bound:
            self.clear()
        uniq, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == uniq
        slot = np.empty(len(uniq), np.int64)
        slot[known] = self.slots[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            pieces = [text[x:y] for x, y in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)]
            slot[new] = self.held(pieces)
            self.keys = np.insert(self.keys, at[new], uniq[new])
            self.slots = np.insert(self.slots, at[new], slot[new])
        return slot[inverse]

    def held(self, pieces: list[str]) -> np.ndarray:
        """Encodes pieces and keeps them; their slots."""
        plain = [x for x in pieces if x not in self.added]
        got = iter(self.encode(plain))
        lists = [[self.added[x]] if x in self.added else next(got) for x in pieces]
        base = self.offsets.size - 1
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.offsets.add(self.ids.size + np.cumsum(sizes))
        self.ids.add(np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())))
        self.places.add(self.letters.size + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))))
        self.letters.add(np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32))
        return base + np.arange(len(pieces))

    def checked(self, slot: np.ndarray, text: str, cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The slots, once each piece is found equal to the one kept there; a piece that only hashes like another is encoded itself."""
        places = self.places.all
        first = places[slot]
        n = e - s
        wrong = n != places[slot + 1] - first
        at = gather(first, np.where(wrong, 0, n))
        here = cp if not wrong.any() else cp[gather(s, np.where(wrong, 0, n))]
        differ = np.flatnonzero(self.letters.all[at] != here)
        if not len(differ) and not wrong.any():
            return slot
        ends = np.cumsum(np.where(wrong, 0, n))
        wrong[np.searchsorted(ends, differ, "right")] = True
        odd = np.flatnonzero(wrong)
        slot = slot.copy()
        slot[odd] = self.held([text[x:y] for x, y in zip(s[odd].tolist(), e[odd].tolist(), strict=True)])
        return slot
