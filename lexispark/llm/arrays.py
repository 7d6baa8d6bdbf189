"""Small numpy helpers."""

from __future__ import annotations

import numpy as np


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges of ``count`` numbers from ``first``, one after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it, the first row included."""
    if not len(columns[0]):
        return np.zeros(0, dtype=bool)
    out = np.zeros(len(columns[0]), dtype=bool)
    out[0] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out
