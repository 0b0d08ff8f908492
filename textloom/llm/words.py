"""Words of a text as hashes, for the operators that compare passages."""

from __future__ import annotations

import numpy as np
import xxhash

#: ASCII bytes that are neither letter nor digit separate words; every other byte belongs to one.
SEPARATORS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each word, in order; letter case and punctuation don't count."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(SEPARATORS).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that any of their bits serve as a hash."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def spaced_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words at the mask's places, for each start; the other places don't count."""
    starts = words.size - len(mask) + 1
    if starts <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(starts, int(mask, 2), dtype=np.uint64)
    for place, used in enumerate(mask):
        if used == "1":
            total = (total ^ words[place : place + starts]) * np.uint64(0x100000001B3)
            total ^= total >> np.uint64(29)
    return mixed(total)
