"""Hashes of substrings in constant time, over arrays."""

from __future__ import annotations

import numpy as np

BASE = 0x100000001B3


def mix(x: np.ndarray) -> np.ndarray:
    """A mixing permutation of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


_known: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, from 0 on; kept for the next call if they aren't many."""
    if not _known or len(_known[0]) < n:
        size = max(n, 1 << 17)
        made = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 2**64))]
        if size > 1 << 20:
            return made[0], made[1]
        _known[:] = made
    return _known[0], _known[1]


class Hashes:
    """Polynomials modulo 2^64 over mixed symbols, from prefix sums."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        up, self.down = _powers(n + 1)
        up = up[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * up, out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the substrings [a, b)."""
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def all_of(self, size: int) -> np.ndarray:
        """Of all substrings of that size."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.down[:n]
