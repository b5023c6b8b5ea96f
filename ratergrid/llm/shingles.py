"""Five-word shingles and circulant MinHash signatures."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import xxhash

from ratergrid.llm.common import WordCache

WIDTH = 5
_MIX = np.random.default_rng(3).integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes() -> WordCache:
    """64-bit hash by word."""
    return WordCache(xxhash.xxh3_64_intdigest)


def words_of(text: str) -> list[bytes]:
    """Words between the six blanks, with A-Z in lower case and all else as it is."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads close ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a sequence of word hashes; fewer than five words are one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < WIDTH:
        return mix64((words * _MIX[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = np.zeros(n - WIDTH + 1, np.uint64)
    for i in range(WIDTH):
        total += words[i:n - WIDTH + 1 + i] * _MIX[i]
    return np.unique(mix64(total))


@dataclass(frozen=True)
class Circulant:
    """Circulant MinHash over ``size`` places (a power of two) with ``length`` coordinates.

    A first permutation breaks up the structure of the set, a second one ranks the places; coordinate k uses the
    second one shifted circularly by k. The coordinates of one element are then ``length`` neighbouring entries
    of one table, and a signature is the smallest row, entry by entry, over the elements.
    """

    size: int = 1 << 20
    length: int = 256
    seed: int = 20

    @functools.cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        first, second = rng.permutation(self.size).astype(np.uint32), rng.permutation(self.size).astype(np.uint32)
        around = np.concatenate([second, second[:self.length]])
        return first, np.lib.stride_tricks.sliding_window_view(around, self.length)

    def signature(self, elements: np.ndarray) -> np.ndarray:
        first, shifted = self.tables
        places = first[(elements & np.uint64(self.size - 1)).astype(np.int64)]
        out = np.full(self.length, self.size, np.uint32)
        for i in range(0, len(places), 2048):
            np.minimum(out, shifted[places[i:i + 2048]].min(axis=0), out=out)
        return out
