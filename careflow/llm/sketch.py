"""Word shingles and fast similarity sketches, vectorised over a batch of texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from .words import hash_words, mix


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words, for each text of a batch.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    h, at = hash_words(texts)
    count = np.diff(at)
    n = max(0, len(h) - width + 1)
    full = np.full(n, width, np.uint64)
    for i in range(width):
        full = mix(full ^ h[i : n + i], i)
    out = []
    for begin, c in zip(at[:-1].tolist(), count.tolist()):
        if c >= width:
            out.append(np.unique(full[begin : begin + c - width + 1]))
        else:
            one = np.full(min(c, 1), c, np.uint64)
            for i in range(c):
                one = mix(one ^ h[begin + i : begin + i + 1], i)
            out.append(one)
    return out


def digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def fast_sketch(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Fast similarity sketches of ``size`` coordinates (Dahlgaard, Knudsen, Thorup 2017), one row a set.

    In each of the first ``size`` rounds every element goes to a hashed bin; in the next
    ``size`` rounds to the bin of the round's number, so every bin fills. A bin keeps the least
    value of the first round that reached it, and a set takes part until its bins are full.
    Two sets agree in a coordinate with the probability of their Jaccard similarity. Empty sets
    keep the largest value everywhere.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(sets) * size, empty, np.uint64)
    open_sets = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
    with np.errstate(over="ignore"):
        if len(open_sets):
            x = np.concatenate([sets[i] for i in open_sets])
            owner = np.repeat(open_sets, [len(sets[i]) for i in open_sets])
        for i in range(2 * size):
            if not len(open_sets):
                break
            h = mix(x, i)
            at = owner * size + ((h >> np.uint64(32)).astype(np.int64) % size if i < size else i - size)
            free = out[at] == empty
            np.minimum.at(out, at[free], mix(h[free], 3 * size + i))
            full = (out.reshape(-1, size)[open_sets] != empty).all(axis=1)
            if full.any():
                done = np.zeros(len(sets), bool)
                done[open_sets[full]] = True
                stay = ~done[owner]
                x, owner, open_sets = x[stay], owner[stay], open_sets[~full]
    return out.reshape(-1, size)


def bands(sketches: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` coordinates."""
    sketches = sketches.astype(np.uint64)
    n, size = sketches.shape
    parts = sketches.reshape(n, size // rows, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(size // rows, dtype=np.uint64), parts.shape[:2])
        for i in range(rows):
            key = mix(key ^ parts[:, :, i], i)
    return key.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets; the shorter one is looked up in the longer one."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
