"""Word and window hashes of text batches, vectorised over whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

STEP = np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 150_000


class WordHash(dict):
    """64-bit hash by word; the first ``CACHE_WORDS`` words are remembered (frequent words come early)."""

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = out
        return out


def small_batches(frame, column: str, most: int) -> Iterator:
    """Cut a pandas batch into parts of about ``most`` bytes of ``column`` (a longer value is its own part)."""
    size = frame[column].map(lambda v: 0 if v is None else len(v)).to_numpy()
    part = np.cumsum(size) // most
    for p in np.unique(part):
        yield frame[part == p]


def word_hashes(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, lengths) -> dict[int, np.ndarray]:
    """Hashes of all windows of each length: entry ``i`` covers words ``i`` to ``i + length - 1``."""
    out, g = {}, h.copy()
    with np.errstate(over="ignore"):
        for n in range(1, max(lengths) + 1):
            if n > 1:
                g = g[:-1] * STEP + h[n - 1 :] if len(h) >= n else g[:0]
            if n in lengths:
                out[n] = mixed(g)
    return out


def mixed(g: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        g = (g ^ (g >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return (g ^ (g >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
