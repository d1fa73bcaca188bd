"""Clusters by density against plain loops; source density of known sources."""

import numpy as np
import pandas as pd
import pytest

from cortexlake.operators import clusters, sources_density as sd
from cortexlake.operators.clusters import dbscan
from cortexlake.operators.graph import components


def by_hand(ids, xy, eps, least):
    near = [np.flatnonzero(((xy - p) ** 2).sum(1) <= eps * eps) for p in xy]
    core = np.array([len(n) >= least for n in near])
    cluster = [None] * len(ids)
    for k in np.argsort(ids):
        if core[k] and cluster[k] is None:
            stack = [k]
            cluster[k] = ids[k]
            while stack:
                for j in near[stack.pop()]:
                    if cluster[j] is None:
                        cluster[j] = ids[k]
                        if core[j]:
                            stack.append(j)
    return {int(i): (None if c is None else int(c), bool(b)) for i, c, b in zip(ids, cluster, core)}


def check(spark, ids, xy, eps, least):
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "x": xy[:, 0], "y": xy[:, 1]})).repartition(4)
    got = {r.id: (r.cluster, r.core) for r in dbscan(df, eps, least).collect()}
    want = by_hand(ids, xy, eps, least)
    assert got == want
    return want


def test_clusters_with_noise_ties_and_equal_points(spark):
    r = np.random.default_rng(1)
    xy = np.concatenate([r.normal(c, 0.15, (300, 2)) for c in ((0, 0), (1, 0.2), (0.4, 1.1))] + [r.uniform(-1, 2, (400, 2)), np.full((500, 2), 0.5), np.round(r.uniform(-1, 2, (200, 2)), 1)])
    want = check(spark, r.permutation(len(xy)) * 3, xy, 0.05, 6)
    found = [c for c, _ in want.values()]
    assert len(set(found)) > 4 and None in found and any(c is not None and not core for c, core in want.values())


def test_crowded_cells_that_a_few_points_do_not_link(spark, monkeypatch):
    monkeypatch.setattr(clusters, "TRIED", 2)
    r = np.random.default_rng(2)
    left, right = r.uniform(0, 0.7, (150, 2)), r.uniform(0, 0.7, (150, 2)) + [1.55, 0]
    xy = np.concatenate([left, right, [[0.72, 0.3], [1.5, 0.3]], [[0.71, 0.35], [1.52, 0.33]]])
    check(spark, np.arange(len(xy)), xy, 1.0, 4)
    check(spark, np.arange(len(xy)), xy, 0.8, 4)
    check(spark, np.arange(len(xy)), xy, 0.75, 4)


def test_points_without_coordinates_and_none_at_all(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 0.0, 0.0)], "id long, x double, y double")
    assert {r.id: (r.cluster, r.core) for r in dbscan(df, 1.0, 2).collect()} == {1: (1, True), 2: (None, False), 3: (None, False), 4: (1, True)}
    assert dbscan(df.filter("false"), 1.0, 2).count() == 0 and dbscan(df, 1.0, 9).filter("cluster is not null").count() == 0


def test_components_of_a_long_chain(spark):
    order = np.random.default_rng(3).permutation(200)
    links = spark.createDataFrame([(int(order[k]), int(order[k + 1])) for k in range(199) if k != 120], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    low, high = int(order[:121].min()), int(order[121:].min())
    assert got == {**{int(x): low for x in order[:121] if x != low}, **{int(x): high for x in order[121:] if x != high}}


def test_spline_recovers_a_smooth_source():
    n, spacing, radius, sigma = 24, 0.05e-3, 0.25e-3, 0.3
    z = np.arange(1, n + 1) * spacing
    source = lambda d: np.exp(-(((d - 0.5e-3) / 0.12e-3) ** 2)) - 0.7 * np.exp(-(((d - 0.8e-3) / 0.1e-3) ** 2))
    fine = np.linspace(0, (n + 1) * spacing, 40001)
    kernel = (np.sqrt((z[:, None] - fine) ** 2 + radius**2) - np.abs(z[:, None] - fine)) / (2 * sigma)
    v = np.trapezoid(kernel * source(fine), fine, axis=1)
    got = sd.spline_matrix(n, 100, spacing, radius, sigma, sigma) @ v
    at = np.linspace(z[0], z[-1], 100)
    assert np.abs(got - source(at)).max() < 0.02
    deeper = sd.spline_matrix(n, 100, spacing, radius, sigma, 0.0) @ (v + np.trapezoid((np.sqrt((z[:, None] + fine) ** 2 + radius**2) - np.abs(z[:, None] + fine)) / (2 * sigma) * source(fine), fine, axis=1))
    assert np.abs(deeper - source(at)).max() < 0.02


@pytest.mark.parametrize("kind, size, want", [("boxcar", 3, [1, 1, 1]), ("triangular", 3, [0.5, 1, 0.5]), ("triangular", 4, [0.25, 0.75, 0.75, 0.25]), ("gaussian", 3, [np.exp(-0.5), 1, np.exp(-0.5)]), ("hamming", 3, [0.08, 1, 0.08]), ("identity", 7, [1])])
def test_spatial_filters(kind, size, want):
    assert np.allclose(sd.spatial_filter(kind, size), np.array(want) / np.sum(want))
    m = sd.smoothing_matrix(9, sd.spatial_filter(kind, size))
    x = np.arange(9.0) ** 2
    assert np.allclose(m @ x, np.convolve(x, sd.spatial_filter(kind, size), "same"))
