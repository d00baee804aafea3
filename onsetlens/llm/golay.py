"""The binary Golay code of 23 bits as a fuzzy hash, vectorised over numpy arrays.

Every 23-bit word is within three bits of exactly one of the 4,096 codewords.  The indices of a
word are those of the codewords nearest to it and to its one-bit neighbours: one, or six.  Two
words that differ in two bits or fewer have an index in common, that of a word between them.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, DATA = 23, 12
# Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
INDICES = 6  # indices of a word, at most


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, LENGTH - DATA - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - (LENGTH - DATA))
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of single bits, of bytes at their three places, and the error of a syndrome."""
    single = np.array([_remainder(1 << bit) for bit in range(LENGTH)], np.int64)
    by_byte = np.zeros((3, 256), np.int64)
    for place in range(3):
        for bit in range(min(8, LENGTH - 8 * place)):
            by_byte[place] ^= np.where(np.arange(256) >> bit & 1, single[8 * place + bit], 0)
    errors = np.zeros(1 << (LENGTH - DATA), np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            errors[np.bitwise_xor.reduce(single[list(bits)])] = sum(1 << bit for bit in bits)
    return single, by_byte, errors


def nearest(words: np.ndarray) -> np.ndarray:
    """Index of the codeword nearest to each word."""
    _, by_byte, errors = _tables()
    syndrome = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16]
    return (words ^ errors[syndrome]) >> (LENGTH - DATA)


def indices(words: np.ndarray, width: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(values, used), both words x INDICES: the distinct indices of words of ``width`` bits."""
    flips = np.concatenate([[0], 1 << np.arange(width)])
    every = np.sort(nearest(words[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(every.shape, bool)
    new[:, 1:] = every[:, 1:] != every[:, :-1]
    place = np.cumsum(new, axis=1) - 1
    values = np.zeros((len(words), INDICES), np.int64)
    row, column = np.nonzero(new)
    values[row, place[row, column]] = every[row, column]
    return values, np.arange(INDICES)[None, :] <= place[:, -1:]
