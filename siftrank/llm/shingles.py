"""Word shingles of whole texts as 64-bit hashes, in numpy.

Words are runs of bytes other than space and the five controls from tab to
carriage return; A-Z are lower-cased.  Equal shingles have equal hashes; two
different ones agree with a chance of 2**-64.
"""

from __future__ import annotations

import numpy as np

WORDS = 5

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ORDER = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB],
                  dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up = np.full(n, _BASE)
    down = np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    if n:
        up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Shingler:
    """Keeps the tables of powers between calls."""

    def __init__(self) -> None:
        self.up, self.down = powers(1 << 20)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of the texts, and where each text's words begin."""
        n = len(data)
        if n + 1 > len(self.up):
            self.up, self.down = powers(2 * n + 1)
        word = ~_SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = word[:-1]
        after = np.zeros(n, dtype=bool)
        after[:-1] = word[1:]
        starts = np.flatnonzero(word & (~before | edge[:n]))
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_LOWER[data] + np.uint64(1)) * self.up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        return hashes, np.searchsorted(starts, offsets)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Each text's distinct shingle hashes in ascending order."""
        words, first = self.words(data, offsets)
        runs = np.zeros(max(0, len(words) - WORDS + 1), dtype=np.uint64)
        for k in range(WORDS):
            runs += words[k:k + len(runs)] * _ORDER[k]
        runs = mix(runs)
        found = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= WORDS:
                found.append(np.unique(runs[a:b - WORDS + 1]))
            elif b > a:  # the whole sequence is one shingle
                found.append(mix(((words[a:b] * _ORDER[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)).reshape(1)))
            else:
                found.append(np.zeros(0, dtype=np.uint64))
        return found
