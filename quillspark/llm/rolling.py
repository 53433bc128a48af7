"""Rolling hashes of byte arrays, all positions at once.

Byte ``b`` at place ``i`` adds ``value[b] * ratio**-i`` to a running sum modulo
2**64, so any substring's hash is one difference times a power: no loop over
bytes. Values and ratio are fixed random numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_MASK = (1 << 64) - 1


class Rolling:
    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, _MASK, 256, np.uint64, endpoint=True)
        # 8 k + 5 generates the largest cycle of powers modulo 2**64.
        self.ratio = int(rng.integers(1, 1 << 60)) * 8 + 5
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                for name, base in (("up", self.ratio), ("down", pow(self.ratio, -1, 1 << 64))):
                    steps = np.full(n, base & _MASK, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums with a leading zero; ``data`` holds bytes."""
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.down[:len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the substrings [start, end)."""
        return (sums[end] - sums[start]) * self.up[start]

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hashes of every substring of the given width."""
        n = len(sums) - width
        return (sums[width:] - sums[:n]) * self.up[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def blocks(sizes: Sequence[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``limit`` bytes, so that work arrays stay small; a longer text stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
