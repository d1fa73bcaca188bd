"""Plain versions of what the operators do in blocks."""

import numpy as np


def find_peaks(x: np.ndarray, height: float, distance: int = 1) -> np.ndarray:
    """Local maxima (the middle of a plateau) of at least ``height``; of two nearer than ``distance`` the lower goes."""
    d = np.diff(x)
    change = np.flatnonzero(d)
    up = np.flatnonzero((d[change[:-1]] > 0) & (d[change[1:]] < 0)) if len(change) > 1 else np.zeros(0, int)
    at = (change[up] + 1 + change[up + 1]) // 2
    at = at[x[at] >= height]
    keep = np.ones(len(at), bool)
    for k in np.argsort(x[at], kind="stable")[::-1]:
        if keep[k]:
            near = np.flatnonzero(np.abs(at - at[k]) < distance)
            keep[near[near != k]] = False
    return at[keep]


def prominence(x: np.ndarray, p: int) -> float:
    """How far the peak stands above the higher of its two bases."""
    left = np.flatnonzero(x[:p] > x[p])
    right = np.flatnonzero(x[p + 1 :] > x[p])
    lo = x[(left[-1] if len(left) else 0) : p + 1].min()
    hi = x[p : (p + 1 + right[0]) if len(right) else len(x)].min()
    return float(x[p] - max(lo, hi))


def width_at(x: np.ndarray, p: int, level: float) -> tuple[float, float]:
    """Interpolated places around ``p`` where ``x`` falls to ``level`` (the ends if it doesn't)."""
    left = np.flatnonzero(x[:p] <= level)
    right = np.flatnonzero(x[p + 1 :] <= level)
    a = left[-1] + (level - x[left[-1]]) / (x[left[-1] + 1] - x[left[-1]]) if len(left) else 0.0
    k = p + 1 + right[0] if len(right) else None
    b = k - (level - x[k]) / (x[k - 1] - x[k]) if k is not None else len(x) - 1.0
    return float(a), float(b)
