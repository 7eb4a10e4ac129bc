"""Hashes of the substrings of a flat text buffer, by prefix sums of a polynomial modulo 2^64."""

from __future__ import annotations

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15
#: Powers are kept for buffers of at least so many bytes.
LEAST_POWERS = 1 << 20

_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0 to n modulo 2^64, and their inverses."""
    if len(_POWERS[0]) <= n:
        inverse = pow(MULTIPLIER, -1, 1 << 64)
        for i, m in enumerate((MULTIPLIER, inverse)):
            _POWERS[i] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, LEAST_POWERS), m, np.uint64)])
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


class Hashes:
    """Hashes of any substring from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray) -> None:
        power, self.inverse = powers(len(data))
        self.sums = np.r_[np.uint64(0), np.cumsum(_CODES[data] * power[:-1])]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of a hash spread over the whole word."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(32))
