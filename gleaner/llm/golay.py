"""The binary Golay code as a fuzzy hash of short bit strings.

The code is perfect: every 23-bit word lies within three bits of exactly one of 4,096
codewords. Two words at most two bits apart have a word between them, one bit from
each at most; so if a word is hashed to the codewords of itself and of all words one bit
away (six at most), words up to two bits apart share a codeword, and a word's own
codeword is among the hashes of any word one bit away.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, CHECK_BITS = 23, 11
# The generator polynomial of the code, a fixed value.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error of each syndrome."""
    low = np.array([_remainder(w) for w in range(1 << 12)], dtype=np.int32)
    high = np.array([_remainder(w << 12) for w in range(1 << 11)], dtype=np.int32)
    error = np.zeros(1 << CHECK_BITS, dtype=np.int32)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            word = sum(1 << b for b in bits)
            error[_remainder(word)] = word
    return low, high, error


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    low, high, error = _tables()
    words = words.astype(np.int32)
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> CHECK_BITS


def fuzzy_keys(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices within one of the low ``bits``: (n, k) and which are in use."""
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.int32)
    codes = np.sort(decode(words.astype(np.int32)[:, None] ^ flips), axis=1)
    fresh = np.ones(codes.shape, dtype=bool)
    fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
    width = int(fresh.sum(axis=1).max(initial=1))
    order = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(codes, order, 1), np.take_along_axis(fresh, order, 1)
