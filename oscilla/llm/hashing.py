"""Polynomial hashes modulo 2**64 of all substrings, by prefix sums in numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_RNG = np.random.default_rng(77)
#: A random word for each byte value.
_BYTES = _RNG.integers(0, 2**64, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit word spread over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(1 << 16, 1 << n.bit_length())
            if size > 1 << 23:
                size = n + 1
            grow = lambda b: np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, b, np.uint64))])
            self.up, self.down = grow(_BASE), grow(pow(_BASE, -1, 2**64))
        return self.up, self.down


powers = Powers()


def prefixes(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which substrings' hashes come; data: uint8."""
    up, _ = powers.upto(len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTES[data] * up[: len(data)], out=out[1:])
    return out


def substrings(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends], equal for equal contents wherever they stand; not yet mixed."""
    _, down = powers.upto(len(sums) - 1)
    return (sums[ends] - sums[starts]) * down[starts]
