"""Words of texts as 64-bit hashes, worked out for whole Arrow columns at a time.

A word is a run of bytes other than ASCII white space; A-Z may be lower-cased. The hash is a polynomial over random
byte values, taken from prefix sums modulo 2^64, then mixed. Two different words among n share a hash with
probability below n^2 / 2^64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over an unsigned array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of ``x`` for each seed."""
    return mix(x + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers above 0 and at most 1."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


_PLAIN = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _PLAIN[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, ``n`` at least."""
    if len(_powers.get("up", ())) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            each = np.full(n, base, np.uint64)
            each[0] = 1
            _powers[name] = np.multiply.accumulate(each)
    return _powers["up"], _powers["down"]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): hashes of all words in order, and where each text's words begin; the last offset is their number."""
    return word_spans(column, lower)[3:]


def word_spans(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, hashes, offsets): the same, with the place of each word in the bytes of all texts."""
    data, offsets = flat_bytes(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    bound = np.zeros(len(data) + 1, bool)
    bound[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | bound[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | bound[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    hashes = span_hashes(data, starts, [ends], lower)[0]
    return data, starts, ends, hashes, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: list[np.ndarray], lower: bool = True) -> list[np.ndarray]:
    """Hashes of stretches of bytes: for each array in ``ends``, those from ``starts`` to it. The first ends are the furthest."""
    values = _LOWER if lower else _PLAIN
    out = [np.empty(len(starts), np.uint64) for _ in ends]
    at = 0
    while at < len(starts):
        # as many words as end within a chunk, one at least
        stop = max(at + 1, int(np.searchsorted(ends[0], starts[at] + _CHUNK, "right")))
        low, high = int(starts[at]), int(ends[0][stop - 1])
        up, down = _table(max(high - low, _CHUNK))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * up[: high - low], out=sums[1:])
        first = starts[at:stop] - low
        for made, end in zip(out, ends, strict=True):
            made[at:stop] = (sums[end[at:stop] - low] - sums[first]) * down[first]
        at = stop
    return [mix(made + (end - starts).astype(np.uint64)) for made, end in zip(out, ends, strict=True)]


_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 97


def shape_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words with each run of lower-case (or other) letters, capitals or digits, or of one sign, made one byte."""
    kind = _CLASS[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[starts] = True
    at = np.cumsum(keep)
    return span_hashes(kind[keep], at[starts] - 1, [at[ends - 1]], lower=False)[0]


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the runs of ``size`` words within each text; a shorter text is one run of all its words."""
    counts = np.diff(offsets)
    made = np.maximum(counts - size + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate([[0], np.cumsum(made)])
    first = np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1], made) + np.repeat(offsets[:-1], made)
    length = np.repeat(np.minimum(counts, size), made)
    out = length.astype(np.uint64)
    for k in range(size):
        there = length > k
        if there.all():
            out = mix(out * np.uint64(0x2545F4914F6CDD1D) + words[first + k])
        else:
            out[there] = mix(out[there] * np.uint64(0x2545F4914F6CDD1D) + words[first[there] + k])
    return out, out_offsets
