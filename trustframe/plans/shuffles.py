"""Keyed permutations of 0 .. n - 1 as arithmetic: a row finds its own place, so no row moves to be shuffled.

The number is split into two bit fields that are mixed into each other in turns (a Feistel
network, a bijection of the next power of two); results beyond n walk on until they fall inside.
"""

from __future__ import annotations

import hashlib

import numpy as np

ROUNDS = 10
MIX = 73_244_475
LOW32 = np.int64(0xFFFFFFFF)


def round_keys(seed: int, n_perm: int) -> np.ndarray:
    """(n_perm, ROUNDS) keys of 32 bits from md5."""
    names = [f"{seed}|{p}|{r}" for p in range(n_perm) for r in range(ROUNDS)]
    return np.array([int(hashlib.md5(s.encode()).hexdigest()[:8], 16) for s in names], np.int64).reshape(n_perm, ROUNDS)


def scramble(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = ((x >> 16) ^ x) * MIX & LOW32
    return (x >> 16) ^ x


def field_bits(n: int) -> tuple[int, int]:
    """Bits of the upper and the lower field."""
    bits = max(2, (n - 1).bit_length())
    return bits - bits // 2, bits // 2


def places(i: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """(rows, permutations): where each permutation of 0 .. n - 1 puts the numbers ``i``."""
    upper, lower = field_bits(n)
    cut, top = np.int64((1 << lower) - 1), np.int64((1 << upper) - 1)
    x = np.repeat(np.asarray(i, np.int64)[:, None], len(keys), axis=1).ravel()
    own = np.tile(np.arange(len(keys)), len(i))
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> lower, x[todo] & cut
        for r in range(ROUNDS):
            k = keys[own[todo], r]
            if r % 2 == 0:
                left = left ^ scramble(right + k & LOW32) & top
            else:
                right = right ^ scramble(left + k & LOW32) & cut
        x[todo] = left << lower | right
        todo = todo[x[todo] >= n]
    return x.reshape(len(i), len(keys))
