"""Vectorised 64-bit hashes of words and of word windows, in numpy.

A window's hash is built by doubling: the hash of 2n words combines those of its two
halves of n words, so every window length costs a handful of array passes.
"""

from __future__ import annotations

import numpy as np

# Odd constants; the two word seeds give independent halves of a 128-bit digest.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LEFT, _RIGHT = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values *= _LEFT
    values ^= values >> np.uint64(29)
    return values


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each word's bytes: a polynomial in the seed, mixed with the length."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), seed, dtype=np.uint64)
    powers = np.cumprod(powers, dtype=np.uint64)
    letters = data[place + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    sums = np.add.reduceat(letters * powers[place], first)
    return _mix(sums + lengths.astype(np.uint64) * np.uint64(seed))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each window of ``length`` consecutive words; one value per start."""
    if len(words) < length:
        return np.zeros(0, dtype=np.uint64)
    power, taken, current, result = 1, 0, words, None
    while power <= length:
        if length & power:
            if result is None:
                result = current
            else:
                count = len(words) - taken - power + 1
                result = _mix(result[:count] * _LEFT + current[taken : taken + count] * _RIGHT)
            taken += power
        power *= 2
        if power <= length:
            half = power // 2
            current = _mix(current[:-half] * _LEFT + current[half:] * _RIGHT)
    return result
