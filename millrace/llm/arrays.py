"""Hashes of many parts of a text at once.

The hash of a part is a polynomial in its characters modulo 2**64, from two prefix sums, then
mixed. Equal parts always hash alike. Used to propose and to group; where a result rests on
equality, the callers compare or use a 128-bit hash of the part's bytes.
"""

from __future__ import annotations

import numpy as np

BASE = 0x5851F42D4C957F2D
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) <= n:
        size = 1 << (n + 1).bit_length()
        _powers, _inverse = (powers(b, size) for b in (BASE, pow(BASE, -1, 2**64)))


def powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Parts:
    """Hashes of parts of one array of character or byte values."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        _grow(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers[:n], out=self.sums[1:])

    def hashed(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _inverse[starts])
