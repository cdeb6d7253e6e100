"""Array helpers that run inside Spark tasks over one Arrow batch at a time.

Everything here is a small pure function over the UTF-8 bytes of a few
megabytes of text: word boundaries, 64-bit span hashes, run gathering.
Spark partitions, shuffles and joins the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; bounds a worker's memory.
CHUNK_BYTES = 1 << 20

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = bytes([0x20, *range(0x09, 0x0E)])

_U = np.uint64
#: Hashes are polynomials modulo this prime in one of two random bases: any two contents of n letters
#: hash alike for at most n bases in 2**61. Arithmetic that wraps at 2**64 has no such bound.
PRIME = (1 << 61) - 1
_P = _U(PRIME)
_BASES = (0x1B7A4C93D5E6F021, 0x0D3C5A96E1F7842B)
_INVERSES = tuple(pow(b, -1, PRIME) for b in _BASES)
_LOW31, _LOW30, _30, _31, _61 = _U((1 << 31) - 1), _U((1 << 30) - 1), _U(30), _U(31), _U(61)


#: Numbers handled at once, so that what lies between stays in a processor's cache.
_RUN = 1 << 14


def reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo the prime."""
    y = x >> _61
    y += x & _P
    return np.minimum(y, y - _P)  # below the prime the difference wraps around


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it."""
    out = np.empty(len(a), _U)
    for k in range(0, len(a), _RUN):
        x, y = a[k : k + _RUN], b[k : k + _RUN]
        high, low, middle = x >> _31, x & _LOW31, y & _LOW31
        both = high * middle
        middle *= low
        y = y >> _31
        low *= y
        both += low
        high *= y
        high <<= _U(1)
        high += middle
        high += both >> _30
        both &= _LOW30
        both <<= _31
        high += both
        out[k : k + _RUN] = reduced(high)
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = times(out[:step], np.full(step, pow(base, done, PRIME), _U))
        done += step
    return out


_cache: dict[str, np.ndarray] = {}


def powers(n: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a hash base and of its inverse."""
    p, q = f"p{base}", f"q{base}"
    if p not in _cache or len(_cache[p]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _cache[p], _cache[q] = _powers(_BASES[base], size), _powers(_INVERSES[base], size)
    return _cache[p], _cache[q]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the whole word."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def prefix(values: np.ndarray, base: int = 0) -> np.ndarray:
    """Prefix sums modulo the prime of values (bytes, code points or hashes) times powers, one longer than the input."""
    power = powers(len(values) + 1, base)[0]
    out = np.zeros(len(values) + 1, _U)
    total = _U(0)
    for k in range(0, len(values), _RUN):
        some = values[k : k + _RUN]
        by = power[k : k + len(some)]
        if some.dtype == _U:
            term = times(reduced(some), by)
        else:  # small letters: a product needs fewer parts
            letter = some.astype(_U)
            letter += _U(1)
            term = by >> _31
            term *= letter
            letter *= by & _LOW31
            letter += term >> _30
            term &= _LOW30
            term <<= _31
            term += letter
            term = reduced(term)
        # Halves of the terms are summed apart, so that no sum passes 2**64; the upper half's weight is 2**30.
        high = np.cumsum(term >> _30)
        term &= _LOW30
        low = np.cumsum(term)
        low += high >> _31
        high &= _LOW31
        high <<= _30
        low += high
        low += total
        out[k + 1 : k + 1 + len(some)] = reduced(low)
        total = out[k + len(some)]
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """64-bit hash of each span [start, end); equal contents hash alike wherever they stand."""
    out, inverse = np.empty(len(start), _U), powers(len(sums), base)[1]
    for k in range(0, len(start), _RUN):
        x, y = start[k : k + _RUN], end[k : k + _RUN]
        d = sums[y]
        d += _P
        d -= sums[x]
        h = times(np.minimum(d, d - _P), inverse[x])
        n = (y - x).astype(_U)
        n *= _U(0xA24BAED4963EE407)
        h += n
        out[k : k + _RUN] = mix(h)
    return out


def set_hash(h: np.ndarray, starts: np.ndarray, which: int) -> np.ndarray:
    """64-bit hash of each run of distinct hashes as a set: runs start at starts and none is empty."""
    return mix(np.add.reduceat(mix(h ^ _U((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[which])), starts))


def fold_table(lower: bool) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[0x41:0x5B] += 0x20
    return t


def word_table(alnum: bool) -> np.ndarray:
    """True for bytes of words: all but the six spaces, or digits, letters a-z and bytes beyond ASCII."""
    t = np.ones(256, bool)
    if alnum:
        t[:0x80] = False
        t[0x30:0x3A] = True
        t[0x61:0x7B] = True
    else:
        t[list(SPACES)] = False
    return t


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    got = batch.column(batch.schema.get_field_index(name))
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets of its rows; null rows are empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    if data is None or not len(arr):
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about limit bytes; a longer row stands alone."""
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def word_spans(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the n+1 offsets of the rows' words."""
    if not len(buf):
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(off), np.int64)
    w = is_word[buf]
    start = w.copy()
    start[1:] &= ~w[:-1]
    end = w.copy()
    end[:-1] &= ~w[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    start[inner] = w[inner]
    end[inner - 1] = w[inner - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all members of the runs (start, length), one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    out = np.repeat(starts - begin, lengths)
    out += np.arange(total, dtype=out.dtype)
    return out


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as sorted maximal runs; touching spans become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:] - 1, len(s) - 1)]
