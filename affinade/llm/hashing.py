"""Hashes of all words of a text at once, in numpy."""

from __future__ import annotations

import numpy as np

WIDE = np.uint64
_places: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> WIDE(31))) * WIDE(0x9E3779B97F4A7C15)
    h = (h ^ (h >> WIDE(29))) * WIDE(0xBF58476D1CE4E5B9)
    return h ^ (h >> WIDE(32))


def places(n: int) -> np.ndarray:
    """A random odd number for each place in a run, by rule, for runs of up to ``n`` symbols."""
    if not _places or len(_places[0]) < n:
        at = np.arange(max(n, 1 << 12), dtype=np.uint64)
        _places[:] = [mix(mix(at + WIDE(0x2545F4914F6CDD1D)) + at) | WIDE(1)]
    return _places[0]


def of_runs(symbols: np.ndarray, numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of symbols[start:end] for each pair of ascending, disjoint runs; equal runs have equal hashes wherever they stand.

    ``numbers`` has a random number for each symbol. A run's hash is the sum of its symbols' numbers, each times the random
    number of its place in the run: unlike powers of one base, places share no structure that texts could repeat.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    last = np.cumsum(size)
    place = np.arange(last[-1]) - np.repeat(last - size, size)
    value = numbers[symbols[place + np.repeat(starts, size)]]
    value *= places(int(size.max()))[place]
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return mix(total[last] - total[last - size] + size.astype(np.uint64))
