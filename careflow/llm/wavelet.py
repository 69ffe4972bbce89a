"""Range reporting on a grid by a wavelet tree, for many queries at once.

The tree of a permutation is kept level by level, each level's zeros before its ones, with prefix
counts of zeros; a query goes down as an interval of positions for each node that it meets. All
queries go down together, a level at a time, as arrays.
"""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Points (i, values[i]) of a permutation ``values`` of 0..m-1."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.zeros, now = [], np.asarray(values, np.int64)
        for level in range(self.bits - 1, -1, -1):
            zero = (now >> level) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            now = np.concatenate([now[zero], now[~zero]])

    def report(self, x1: np.ndarray, x2: np.ndarray, y1: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, y) of every point with x1 <= x < x2 and y1 <= y < y2 of each query."""
        query = np.flatnonzero((x1 < x2) & (y1 < y2))
        low, high, value = x1[query], x2[query], np.zeros(len(query), np.int64)
        for level, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            l0, h0 = zeros[low], zeros[high]
            query = np.concatenate([query, query])
            low, high = np.concatenate([l0, zeros[-1] + low - l0]), np.concatenate([h0, zeros[-1] + high - h0])
            value = np.concatenate([value, value + (1 << level)])
            met = (low < high) & (value < y2[query]) & (value + (1 << level) > y1[query])
            query, low, high, value = query[met], low[met], high[met], value[met]
        return query, value
