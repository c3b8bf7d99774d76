"""Suffix sorting inside a task: mergesort on suffixes compared by hashed prefixes.

The common extension of two suffixes is found by binary search over prefix hashes
(polynomials modulo 2^64 of all prefixes of one buffer), so a comparison takes a
logarithmic number of steps; all comparisons of a merge round run as array operations.
What is reported as equal is compared byte by byte.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Odd multipliers; another is tried if equal hashes turn out to belong to unequal bytes.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below n."""
    inverse = pow(base, -1, 1 << 64)
    factors = np.empty((2, n), dtype=np.uint64)
    factors[:, 0] = 1
    factors[0, 1:], factors[1, 1:] = base, inverse
    ups, downs = np.cumprod(factors, axis=1, dtype=np.uint64)
    return ups, downs


def prefix_sums(data: np.ndarray, downs: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes, each scaled so that differences are substring hashes."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    scaled = sums[1:]
    np.add(data, 1, out=scaled, dtype=np.uint64)
    scaled *= downs[: len(data)]
    np.cumsum(scaled, out=scaled)
    return sums


class SuffixSorter:
    """Sorts suffixes of ``data`` within segments, on their first ``length`` bytes."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]) -> None:
        self.data = data
        # Tables of few sizes, so that they are made once.
        self.ups, downs = powers(base, 1 << max(len(data), 1 << 20).bit_length())
        self.sums = prefix_sums(data, downs)

    def common(self, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
        """Bytes that the suffixes at x and y have in common, ``length`` at most."""
        low, high = np.zeros(len(x), dtype=np.int64), np.full(len(x), length, dtype=np.int64)
        sums, sx, sy, ux, uy = self.sums, self.sums[x], self.sums[y], self.ups[x], self.ups[y]
        for _ in range(int(length).bit_length()):
            mid = (low + high + 1) >> 1
            same = (sums[x + mid] - sx) * ux == (sums[y + mid] - sy) * uy
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def _below(self, x: np.ndarray, y: np.ndarray, length: int, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(x, y, length)
        ended = n == length
        at = np.minimum(n, length - 1)
        return np.where(ended, or_equal, self.data[x + at] < self.data[y + at])

    def sort(self, segment: np.ndarray, start: np.ndarray, length: int):
        """Order of the items, and the common bytes of each with the one before it.

        Items of a segment stand together; the first of each segment has -1.
        """
        n = len(start)
        fresh = np.concatenate([[True], segment[1:] != segment[:-1]]) if n else np.zeros(0, bool)
        firsts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(firsts, n))
        base, size = np.repeat(firsts, sizes), np.repeat(sizes, sizes)
        inside = np.arange(n) - base
        order = np.arange(n)
        width = 1
        while width < sizes.max(initial=0):
            run = inside // width
            other = (run ^ 1) * width
            count = np.clip(size - other, 0, width)
            todo = np.flatnonzero(count > 0)
            low, high = np.zeros(n, dtype=np.int64), np.where(count > 0, count, 0)
            from_right = (run & 1).astype(bool)
            while len(todo):
                mid = (low[todo] + high[todo]) >> 1
                mine = start[order[todo]]
                theirs = start[order[base[todo] + other[todo] + mid]]
                up = self._below(theirs, mine, length, from_right[todo])
                low[todo] = np.where(up, mid + 1, low[todo])
                high[todo] = np.where(up, high[todo], mid)
                todo = todo[low[todo] < high[todo]]
            place = base + (run & ~1) * width + (inside - run * width) + low
            merged = np.empty_like(order)
            merged[place] = order
            order = merged
            width *= 2
        shared = np.full(n, -1, dtype=np.int64)
        later = np.flatnonzero(~fresh)
        shared[later] = self.common(start[order[later - 1]], start[order[later]], length)
        return order, shared

    def equal_bytes(self, x: np.ndarray, y: np.ndarray, length: int) -> bool:
        """Whether every pair of suffixes really agrees in ``length`` bytes."""
        steps = np.arange(length)
        return all(
            np.array_equal(
                self.data[x[i : i + 4096, None] + steps], self.data[y[i : i + 4096, None] + steps]
            )
            for i in range(0, len(x), 4096)
        )
