"""Sets of word shingles of whole texts, vectorised over Arrow batches, and their MinHash values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from onsetlens.llm.common import words_of

SHINGLE = 4
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(v: np.ndarray) -> np.ndarray:
    """64-bit finaliser: shift, xor and multiply."""
    v = (v ^ (v >> np.uint64(30))) * _M1
    v = (v ^ (v >> np.uint64(27))) * _M2
    return v ^ (v >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Ascending distinct 64-bit hashes of the shingles of each text.

    A-Z are lower-cased; words stand between ASCII white space.  A text of fewer than ``size``
    words has one shingle, all its words; a text without words has none.
    """
    offsets, codes, words = words_of(pc.ascii_lower(texts))
    if "" in words:
        empty = words.index("")
        keep = codes != empty
        before = np.concatenate([[0], np.cumsum(keep)])
        offsets, codes = before[offsets], codes[keep]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    h = hashes[codes]
    n = len(h)
    full = np.zeros(max(n - size + 1, 0), np.uint64)
    for i in range(size):
        full = mixed(full + h[i : n - size + 1 + i] + np.uint64(i + 1))
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= size:
            part = full[a : b - size + 1]
        elif b > a:
            v = np.zeros(1, np.uint64)
            for i, word in enumerate(h[a:b]):
                v = mixed(v + word + np.uint64(i + 1))
            part = mixed(v + np.uint64(b - a))  # no shingle of full size has this value but by chance
        else:
            part = np.zeros(0, np.uint64)
        out.append(np.unique(part))
    return out


class MinHash:
    """Signatures of ``rows`` 16-bit values: low bits of the smallest value of a hash family."""

    def __init__(self, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, rows, dtype=np.uint64)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.uint64(0xFFFFFFFFFFFFFFFF))
        for i in range(0, len(shingles), 512):  # in cache
            found = shingles[i : i + 512, None] * self.a[None, :]
            found += self.b[None, :]
            np.minimum(least, found.min(axis=0), out=least)
        return (mixed(least) >> np.uint64(48)).astype(np.uint16)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for ascending distinct values."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    shared = int((large[at] == small).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)
