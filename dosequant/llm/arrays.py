"""Small array operations on runs of places."""

from __future__ import annotations

import numpy as np


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def runs(flags: np.ndarray, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of flagged windows at consecutive words of a row: row, at, n."""
    rows, at = rows[flags], at[flags]
    new = np.ones(len(at), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return rows[first], at[first], np.diff(np.append(first, len(at)))
