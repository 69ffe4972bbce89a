"""Words of a batch of texts as 64-bit hashes, straight from Arrow's buffers.

A word ``[^\\x20\\x09-\\x0D]+`` (A-Z in lower case) with bytes b_0..b_m has the hash
mix(sum of T[b_i] * B**i mod 2**64, its length) for a random table T and an odd B. With
running sums over a slice of the buffer every word costs a few vector operations and no
Python object is made for it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes that are hashed at once.
SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and the ASCII marks.
MARKS = _SPACE.copy()
MARKS[[*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.Generator(np.random.PCG64(20_24)).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] | _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser, one function for each seed."""
    with np.errstate(over="ignore"):
        x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        ones = np.ones(n, _U)
        a, b = ones * _U(_BASE), ones * _U(_INVERSE)
        a[0] = b[0] = _U(1)
        return np.cumprod(a, dtype=_U), np.cumprod(b, dtype=_U)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and each text's offsets in them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if texts.buffers()[2] is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return data, at - at[0]


def slices(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``most`` bytes of text (or one row), so that the arrays of a part stay small."""
    _, at = buffers(batch.column(column))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, side="right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def spans(data: np.ndarray, at: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word in the bytes; a word never crosses two texts. ``breaks`` are the bytes between words."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = ~breaks[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cuts = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
    begin[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def look_up(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key among the sorted ones, -1 for those that aren't there."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, -1)


def hash_words(texts: pa.Array, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, and where each text's words begin and end in them."""
    data, at = buffers(texts)
    begin, end = spans(data, at, breaks)
    out = np.empty(len(begin), _U)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(begin):
            low = begin[i]
            j = max(i + 1, int(np.searchsorted(end, low + SLICE, side="right")))
            part = data[low : end[j - 1]]
            size = SLICE
            while size < len(part):
                size *= 2
            up, down = _powers(size)
            sums = np.zeros(len(part) + 1, _U)
            np.cumsum(_TABLE[part] * up[: len(part)], out=sums[1:])
            b, e = begin[i:j] - low, end[i:j] - low
            out[i:j] = mix((sums[e] - sums[b]) * down[b] + (e - b).astype(_U))
            i = j
    return out, np.searchsorted(begin, at)
