"""Exact penalised changepoint search (pruned optimal partitioning) for shifts in the mean of a series."""

from __future__ import annotations

import numpy as np


def segment(y: np.ndarray, penalty: float) -> list[tuple[int, int]]:
    """The segmentation of ``y`` with the least (squared error within segments + ``penalty`` per change).

    Exact: dynamic programming over the last change, with candidates pruned only once they can never be best again.
    Returns half-open index ranges in order; none for an empty series.
    """
    n = len(y)
    if n == 0:
        return []
    s1 = np.concatenate(([0.0], np.cumsum(y)))
    s2 = np.concatenate(([0.0], np.cumsum(y * y)))
    if s2[n] - s1[n] * s1[n] / n <= penalty:
        return [(0, n)]  # no split can save more than the whole error, so none pays its penalty
    best = np.empty(n + 1)
    best[0] = -penalty
    last = np.zeros(n + 1, dtype=np.int64)
    alive = np.array([0])
    for t in range(1, n + 1):
        d = s1[t] - s1[alive]
        cost = best[alive] + (s2[t] - s2[alive] - d * d / (t - alive))
        k = int(np.argmin(cost))
        best[t] = cost[k] + penalty
        last[t] = alive[k]
        alive = np.append(alive[cost <= best[t] + 1e-9], t)
    out, t = [], n
    while t > 0:
        out.append((int(last[t]), t))
        t = int(last[t])
    return out[::-1]


def segment_pieces(n: np.ndarray, s1: np.ndarray, s2: np.ndarray, penalty: float) -> list[tuple[int, int]]:
    """``segment`` for a series given as pieces that stay whole: their numbers of values, sums and sums of squares.

    With pieces cut where any block of the series changes or ends, segments grow over the ends of blocks with the same
    penalty and error as within them.
    """
    m = len(n)
    cn, c1, c2 = (np.concatenate(([0.0], np.cumsum(x))) for x in (n, s1, s2))
    best = np.empty(m + 1)
    best[0] = -penalty
    last = np.zeros(m + 1, dtype=np.int64)
    alive = np.array([0])
    for t in range(1, m + 1):
        d = c1[t] - c1[alive]
        cost = best[alive] + (c2[t] - c2[alive] - d * d / np.maximum(cn[t] - cn[alive], 1.0))
        k = int(np.argmin(cost))
        best[t] = cost[k] + penalty
        last[t] = alive[k]
        alive = np.append(alive[cost <= best[t] + 1e-9], t)
    out, t = [], m
    while t > 0:
        out.append((int(last[t]), t))
        t = int(last[t])
    return out[::-1]


def known_shift(level: float, base: float, known: tuple[float, ...], tolerance: float) -> float:
    """The known shift nearest to that of a level against a base, 0 if none is within the tolerance."""
    near = min(known, key=lambda k: abs(level - base - k))
    return near if abs(level - base - near) <= tolerance else 0.0


def level_shifts(y: np.ndarray, known: tuple[float, ...], penalty: float, tolerance: float, reference: float | None = None) -> np.ndarray:
    """For each value the known level shift that its segment shows against ``reference``, 0 where it shows none.

    ``reference`` is the level of unshifted values; by default the median of the series.
    """
    out = np.zeros(len(y))
    if len(y) == 0:
        return out
    base = float(np.median(y)) if reference is None else reference
    for a, b in segment(y, penalty):
        out[a:b] = known_shift(float(y[a:b].mean()), base, known, tolerance)
    return out
