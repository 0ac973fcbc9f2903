"""Words of raw UTF-8 and hashes of word shingles, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from umbrascan.llm.pretokens import Cache, once

BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; a worker remembers those of frequent words."""
    known = once(("words",), lambda: Cache(xxhash.xxh64_intdigest, 16 << 20))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words."""
    n = len(hashes) - k + 1
    out = hashes[:n].copy()
    for i in range(1, k):
        out = out * BASE + hashes[i : n + i]
    return mixed(out)


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; with fewer than ``k`` words, of all words as one."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < k:
        return mixed(grams(hashes, len(words)) + np.uint64(len(words)))
    return np.unique(grams(hashes, k))
