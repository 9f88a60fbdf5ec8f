"""A seeded sequence of numbers that is the same everywhere, element by element."""

from __future__ import annotations

import numpy as np

#: Fixed values of the sequence.
GAMMA, FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def splitmix(seed: int, count: int) -> np.ndarray:
    """The first numbers of the sequence; each follows from its place alone."""
    z = np.uint64(seed) + np.arange(1, count + 1, dtype=np.uint64) * GAMMA
    z = (z ^ z >> np.uint64(30)) * FIRST
    z = (z ^ z >> np.uint64(27)) * SECOND
    return z ^ z >> np.uint64(31)


def units(seed: int, count: int) -> np.ndarray:
    """Numbers from 0 to below 1, of the upper 24 bits."""
    return (splitmix(seed, count) >> np.uint64(40)).astype(np.float64) / (1 << 24)


def normals(seed: int, count: int) -> np.ndarray:
    """Normally distributed numbers, each of a pair of those."""
    u = units(seed, 2 * count).reshape(-1, 2)
    return np.sqrt(-2 * np.log(np.maximum(u[:, 0], 1e-12))) * np.cos(2 * np.pi * u[:, 1])
