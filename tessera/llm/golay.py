"""The perfect binary [23, 12] code: every 23-bit word lies within 3 bits of one codeword."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, CHECKS = 23, 11


def remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """The remainder by part of the word (three parts of 8 bits), and the error pattern by remainder."""
    parts = np.array([[remainder(v << 8 * p) if v << 8 * p < 1 << LENGTH else 0 for v in range(256)] for p in range(3)], np.int64)
    error = np.zeros(1 << CHECKS, np.int64)
    for weight in range(4):
        for bits in combinations(range(LENGTH), weight):
            word = sum(1 << b for b in bits)
            error[remainder(word)] = word
    return parts, error


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each word."""
    parts, error = tables()
    rest = parts[0][words & 255] ^ parts[1][words >> 8 & 255] ^ parts[2][words >> 16]
    return (words ^ error[rest]) >> CHECKS


def near(words: np.ndarray, width: int = LENGTH) -> np.ndarray:
    """Indices of every word and of what one error in its lowest `width` bits makes of it: six different ones at most."""
    flips = np.array([0, *(1 << b for b in range(width))], np.int64)
    return decode(words[:, None] ^ flips)
