"""Polynomial hashes mod 2^64 of any ranges of bytes, with numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all others, one to one."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Hashes:
    """Hashes of ranges of a text; they depend on the bytes in the range alone."""

    power, inverse = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(self.power) < n:
            Hashes.power, Hashes.inverse = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        self.sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: n - 1]))

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        """Of the ranges from each start to each end; slices take the place of neighbouring numbers."""
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])
