"""Summed differences of many descriptors, on arrays.

Descriptors are laid onto a grid first, so coarse that their sums fit 16 bits. From sums on the grid follows what can't be among the
nearest; only the rest is compared exactly. So results are exact, and most pairs cost a few nanoseconds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Pairs in a tile, which the processor's cache should hold, and pairs that are compared exactly at a time.
TILE, EXACT = 131_072, 32_768
MOST = np.iinfo(np.int16).max
#: Dimensions that leave the grid sixteen steps at least.
WIDE = MOST // 16


def classes(rows: np.ndarray) -> np.ndarray:
    """A number for each row, the same for equal ones, from 0 in the order in which they first come."""
    return pd.factorize(np.array([x.tobytes() for x in np.ascontiguousarray(rows)], object))[0]


def firsts(rows: np.ndarray, k: int) -> np.ndarray:
    """Places of rows of which fewer than k equal ones come before: the others can't be among anything's k nearest, as ties go to the smaller place."""
    number = classes(rows)
    return np.flatnonzero(pd.Series(number).groupby(number).cumcount().to_numpy() < k)


def grid(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Both on one grid, and by how many steps two sums on it must differ at least for the descriptors' sums to differ in the same way."""
    low = np.minimum(a.min(0), b.min(0))
    size = a.shape[1]
    step = float((np.maximum(a.max(0), b.max(0)) - low).max()) / (MOST // size) or 1.0
    # a difference is off by a step at most, so a sum by `size` steps, and two sums by twice as many
    return *(np.rint((x - low) / step).astype(np.int16) for x in (a, b)), 2 * size + 2


def apart(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sums on the grid between each of the rows and each of the columns (dimension by descriptor)."""
    out, part = np.zeros((2, len(rows), columns.shape[1]), np.int16)
    for x, y in zip(rows.T, columns, strict=True):
        np.subtract(x[:, None], y, out=part)
        np.abs(part, out=part)
        out += part
    return out


def within(sums: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the sums up to the limit."""
    return np.divmod(np.flatnonzero(sums <= limit), sums.shape[1])


def exact(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Summed differences of a[p] and b[q]."""
    parts = [np.abs(a[p[lo : lo + EXACT]] - b[q[lo : lo + EXACT]]).sum(1) for lo in range(0, len(p), EXACT)]
    return np.concatenate(parts) if parts else np.zeros(0, a.dtype)


def first(of: np.ndarray, n: int, k: int, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of n queries (`of`: a candidate's) the places of its first k candidates by `by`, the most important last; and how many it has, k at most. Beyond those the places mean nothing."""
    order = np.lexsort((*by, of))
    begin = np.searchsorted(of[order], np.arange(n + 1))
    at = np.minimum(begin[:-1, None] + np.arange(k), max(len(of) - 1, 0))
    return order[at] if len(of) else np.zeros((n, k), int), np.minimum(np.diff(begin), k)


def nearest(rows: np.ndarray, to: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in `to` and distances of each row's k nearest (or all, if fewer), nearest first, ties to the smaller place."""
    k = min(k, len(to))
    number = classes(rows)
    rows = rows[np.unique(number, return_index=True)[1]]
    kept = firsts(to, k)
    to = to[kept]
    coarse = 0 < to.shape[1] <= WIDE and np.isfinite(rows).all() and np.isfinite(to).all()
    if coarse:
        a, b, slack = grid(rows, to)
        columns = np.ascontiguousarray(b.T)
    at, dist = np.empty((len(rows), k), int), np.empty((len(rows), k), to.dtype)
    ends = [len(to) * i // k for i in range(k + 1)]
    height = max(TILE // len(to), 1)
    for lo in range(0, len(rows), height):
        hi = min(lo + height, len(rows))
        if coarse:
            sums = apart(a[lo:hi], columns)
            # the nearest of each of k parts are k descriptors, so none of the k nearest is farther
            limit = np.max([sums[:, x:y].min(1) for x, y in zip(ends, ends[1:], strict=False)], 0)
            q, t = within(sums, np.minimum(limit.astype(int) + slack, MOST).astype(np.int16)[:, None])
        else:
            q, t = (x.ravel() for x in np.indices((hi - lo, len(to))))
        d = exact(rows[lo:hi], to, q, t)
        best, _ = first(q, hi - lo, k, t, d)
        at[lo:hi], dist[lo:hi] = t[best], d[best]
    return kept[at][number], dist[number]
