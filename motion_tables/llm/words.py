"""Words and word shingles of whole Arrow batches as 64-bit hashes, in numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D, the pattern
``[^\\x20\\x09-\\x0D]+``.  A null text counts as an empty one.  Everything here is a
pure function of the text, the same in every process, so a lost task can be redone.
Memory: a few arrays as long as the batch's bytes, and nine bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PIECE = 1 << 18
_LOW = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix64's finalizer)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def series(n: int, seed: int) -> np.ndarray:
    """n pseudorandom 64-bit values that depend on the seed alone."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


_VALUE = series(256, 1)
_VALUE[SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWER = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_LOW - 1, _BASE, dtype=np.uint64))])
_STEP = _POWER[-1:] * _BASE
_LANE = series(64, 2) | np.uint64(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, and where each row starts in them (one more entry than rows)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def spans(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each row's first word (one more entry than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~space[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, at)


def fold(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each run of values that begins at an entry of ``first``: the sum of its values, each times a power of its place."""
    place = np.arange(len(value)) - np.repeat(first, np.diff(np.append(first, len(value))))
    most = int(place.max()) if len(place) else 0
    if most >= _LOW:
        steps = np.concatenate([[np.uint64(1)], np.cumprod(np.full(most // _LOW, _STEP[0], dtype=np.uint64))])
        value = value * (_POWER[place % _LOW] * steps[place // _LOW])
    else:
        value = value * _POWER[place]
    return np.add.reduceat(value, first) if len(first) else np.zeros(0, np.uint64)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _VALUE) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, none empty, works in pieces of whole spans.  Bytes between spans must have a 0 in the table."""
    out = np.empty(len(starts), dtype=np.uint64)
    cuts = np.unique(np.concatenate([np.searchsorted(starts, np.arange(0, len(data), _PIECE)), [len(starts)]]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        low, high = starts[a], ends[b - 1]
        out[a:b] = fold(table[data[low:high]], starts[a:b] - low)
    return mix(out + (ends - starts).astype(np.uint64) * _LANE[0])


#: For spans that are lines: only the byte between lines counts nothing.
LINE_VALUE = series(256, 1)
LINE_VALUE[0x0A] = 0


def windows(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k words in a row and each row's first window; a row of 1 to k-1 words has one window of them all."""
    n, count = len(h), np.diff(at)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    whole = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        whole[: n - j] += h[j:] * _LANE[j + 1]
    short = np.flatnonzero((count > 0) & (count < k))
    first = at[:-1][short]
    for j in range(k if len(short) else 0):
        if j == 0:
            whole[first] = 0
        there = count[short] > j
        whole[first[there]] += h[first[there] + j] * _LANE[j + 1]
    keep = np.arange(n) - np.repeat(at[:-1], count) <= np.repeat(np.maximum(count - k, 0), count)
    made = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    return mix(whole[keep]), np.concatenate([[0], np.cumsum(made)])


def shingles(column: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The windows of k words of a column of texts."""
    data, at = utf8(column)
    starts, ends, first = spans(data, at)
    return windows(hashes(data, starts, ends), first, k)
