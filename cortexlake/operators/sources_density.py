"""Inverse current source density: a small matrix from the probe's geometry, applied as a join and a sum."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tissue conductivity (S/m), radius of the sources and spacing of the contacts (m).
CONDUCTIVITY, RADIUS, SPACING = 0.3, 0.25e-3, 0.05e-3


def forward_matrix(n: int, method: str, spacing: float = SPACING, radius: float = RADIUS, sigma: float = CONDUCTIVITY, sigma_top: float = CONDUCTIVITY, steps: int = 64) -> np.ndarray:
    """Potentials at the contacts from unit sources: thin discs (``delta``) or discs as thick as the spacing (``step``), with their images above the surface."""
    z = np.arange(1, n + 1) * spacing
    mirror = (sigma - sigma_top) / (sigma + sigma_top)
    disc = lambda d: np.sqrt(d**2 + radius**2) - np.abs(d)
    if method == "delta":
        return spacing / (2 * sigma) * (disc(z[:, None] - z) + mirror * disc(z[:, None] + z))
    inner = (np.arange(steps) + 0.5) / steps * spacing - spacing / 2
    at = np.maximum(z[:, None] + inner, 0)
    total = disc(z[:, None, None] - at[None]) + mirror * disc(z[:, None, None] + at[None])
    return total.mean(2) * spacing / (2 * sigma)


def _spline(nodes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at ``at`` of the natural cubic splines that are 1 at one of the evenly spaced ``nodes`` and 0 at the others; a column for each node."""
    n, h = len(nodes), nodes[1] - nodes[0]
    inner = (4 * np.eye(n - 2) + np.eye(n - 2, k=1) + np.eye(n - 2, k=-1)) * h / 6
    bend = np.zeros((n, n))
    bend[1:-1] = np.linalg.solve(inner, (np.eye(n - 2, n) - 2 * np.eye(n - 2, n, k=1) + np.eye(n - 2, n, k=2)) / h)
    i = np.clip(np.floor((at - nodes[0]) / h).astype(int), 0, n - 2)
    b = ((at - nodes[i]) / h)[:, None]
    a, unit = 1 - b, np.eye(n)
    return a * unit[i] + b * unit[i + 1] + ((a**3 - a) * bend[i] + (b**3 - b) * bend[i + 1]) * h**2 / 6


def spline_matrix(n: int, steps: int, spacing: float = SPACING, radius: float = RADIUS, sigma: float = CONDUCTIVITY, sigma_top: float = CONDUCTIVITY, order: int = 24) -> np.ndarray:
    """Source density at ``steps`` even depths from the first to the last of ``n`` contacts, from the potentials at these.

    The density is the natural cubic spline with a node at each contact and zero one spacing beyond the first and the last. Each piece's
    potential is integrated over discs of its depth; a disc is weighed by the spline there, with its image above the surface.
    """
    z = np.arange(1, n + 1) * spacing
    nodes = np.arange(0, n + 2) * spacing
    x, w = np.polynomial.legendre.leggauss(order)
    depth = (nodes[:-1, None] + (x + 1) / 2 * spacing).ravel()
    weight = np.tile(w / 2 * spacing, n + 1)
    disc = lambda d: np.sqrt(d**2 + radius**2) - np.abs(d)
    mirror = (sigma - sigma_top) / (sigma + sigma_top)
    potential = (disc(z[:, None] - depth) + mirror * disc(z[:, None] + depth)) / (2 * sigma)
    forward = (potential * weight) @ _spline(nodes, depth)[:, 1:-1]
    return _spline(nodes, np.linspace(z[0], z[-1], steps))[:, 1:-1] @ np.linalg.inv(forward)


def spatial_filter(kind: str, size: int, width: float = 1.0) -> np.ndarray:
    """Weights over ``size`` neighbouring channels that sum to 1: ``boxcar``, ``hamming``, ``triangular``, ``gaussian`` (of deviation ``width``) or ``identity``."""
    k = np.arange(size)
    if kind == "identity":
        return np.ones(1)
    if kind == "boxcar":
        w = np.ones(size)
    elif kind == "hamming":
        w = np.hamming(size)
    elif kind == "triangular":
        w = 1 - np.abs(k - (size - 1) / 2) / ((size + size % 2) / 2)
    elif kind == "gaussian":
        w = np.exp(-0.5 * ((k - (size - 1) / 2) / width) ** 2)
    else:
        raise ValueError(f"no spatial filter {kind!r}")
    return w / w.sum()


def smoothing_matrix(n: int, weights: np.ndarray) -> np.ndarray:
    """The filter over ``n`` rows; beyond the ends there is nothing. Of an even number of weights the middle is the left one of two."""
    full = np.array([np.convolve(row, weights) for row in np.eye(n)]).T
    return full[(len(weights) - 1) // 2 :][:n]


def density_matrix(n: int, method: str, smooth: tuple | None = None, doubled_ends: bool = False, steps: int = 200, **geometry: float) -> np.ndarray:
    """What ``inverse_source_density`` applies: a row for each channel or depth of the result; rows of ``standard`` without neighbours are zero."""
    spacing, sigma = geometry.get("spacing", SPACING), geometry.get("sigma", CONDUCTIVITY)
    if method == "standard":
        m = -sigma / spacing * (np.eye(n, k=-1) - 2 * np.eye(n) + np.eye(n, k=1))
        if doubled_ends:
            m[0, 0] = m[-1, -1] = sigma / spacing
        else:
            m[[0, -1]] = 0
    else:
        m = spline_matrix(n, steps, **geometry) if method == "spline" else np.linalg.inv(forward_matrix(n, method, **geometry))
    if smooth is None:
        return m
    if method == "standard" and not doubled_ends:  # there is no row for the outer channels
        m[1:-1] = smoothing_matrix(n - 2, spatial_filter(*smooth)) @ m[1:-1]
        return m
    return smoothing_matrix(len(m), spatial_filter(*smooth)) @ m


def inverse_source_density(signal: DataFrame, keys: list[str], n: int, method: str, smooth: tuple | None = None, doubled_ends: bool = False, steps: int = 200, **geometry: float) -> DataFrame:
    """``keys, ch, csd`` by the inverse of the forward matrix, or by the plain second difference (``standard``).

    The outer channels of ``standard`` have none, unless their potentials are doubled beyond the ends. For ``spline``, ``ch`` is one of ``steps``
    even depths. ``smooth`` is a spatial filter's kind, size and width. The matrix has n or ``steps`` times n entries for n
    contacts and is broadcast; every sample meets one column of it.
    """
    m = density_matrix(n, method, smooth, doubled_ends, steps, **geometry)
    rows, cols = np.nonzero(m)
    entries = signal.sparkSession.createDataFrame([(int(a) + 1, int(b) + 1, float(m[a, b])) for a, b in zip(rows, cols)], "out_ch int, ch int, f double")
    return signal.join(F.broadcast(entries), "ch").groupBy(*keys, F.col("out_ch").alias("ch")).agg(F.sum(F.col("f") * F.col("v")).alias("csd"))
