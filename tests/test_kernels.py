"""Kernels and the network against known numbers."""

import math
from datetime import date, timedelta

import numpy as np
import pytest

from phasegrid.functions import kernels
from phasegrid.model import Ifg, Network
from phasegrid.operators import network


def net(pairs, days=36):
    start = date(2006, 1, 1)
    return Network.of({"ifg_id": i, "first_date": start + timedelta(days * a), "second_date": start + timedelta(days * b), "nan_fraction": 0.0} for i, (a, b) in enumerate(pairs))


def test_least_norm_series():
    """Cumulative displacement of one pixel seen by eight interferograms."""
    epochs = np.array([0, 0.1, 0.6, 0.8, 1.1, 1.3])
    first, second = np.array([1, 1, 2, 2, 3, 3, 4, 5]) - 1, np.array([2, 4, 3, 4, 5, 6, 6, 6]) - 1
    b = kernels.design(first, second, np.diff(epochs))
    velocity = np.linalg.pinv(b) @ [0.5, 4, 2.5, 3.5, 2.5, 3.5, 2.5, 1]
    assert np.allclose(np.cumsum(velocity * np.diff(epochs)), [0.5, 3, 4, 5.5, 6.5], atol=0.01)


def test_robust_rate():
    obs, span = np.array([0.5, 3.5, 4, 2.5, 1]), np.array([0.1, 0.7, 0.8, 0.5, 0.2])
    rate, error, n = kernels.robust_rate(obs, span, np.eye(5), 3, 2)
    assert (round(rate, 9), round(error, 9), n) == (5.0, 0.836242010, 5)
    rate, _, n = kernels.robust_rate(np.append(obs, 40.0), np.append(span, 0.3), np.eye(6), 3, 2)
    assert (round(rate, 9), n) == (5.0, 5)
    assert math.isnan(kernels.robust_rate(obs[:1], span[:1], np.eye(1), 3, 2)[0])


def test_weighted_least_squares():
    assert np.allclose(kernels.weighted_least_squares([[1, 1], [0.4, 1], [0.3, 1]], [13, 7.2, 5.7], np.ones(3)), [10.1628, 2.8744], atol=1e-4)


def test_temporal_covariance_of_five():
    d = lambda s: date(2000 + int(s[:2]), int(s[2:4]), int(s[4:]))
    pairs = ["060828-061211", "061106-061211", "061106-070115", "061106-070326", "070326-070917"]
    ifgs = tuple(Ifg(i, *map(d, p.split("-"))) for i, p in enumerate(pairs))
    own = [8.486, 12.925, 6.313, 0.788, 0.649]
    v = network.covariance_matrix(Network(ifgs), own)
    assert np.allclose(np.diag(v), own) and np.allclose(v, v.T)
    assert np.allclose(v[0, 1], 0.5 * math.sqrt(own[0] * own[1])) and v[0, 2] == 0
    assert np.allclose(v[3, 4], -0.5 * math.sqrt(own[3] * own[4])) and np.allclose(v[1, 2], 0.5 * math.sqrt(own[1] * own[2]))


def test_cycles():
    near = lambda edges: {v: {b for a, b in edges + [e[::-1] for e in edges] if a == v} for e in edges for v in e}
    assert network.cycles(near([(0, 1), (1, 2), (2, 3), (0, 3), (1, 4), (3, 4)]), 4) == [[0, 1, 2, 3], [0, 1, 4, 3], [1, 2, 3, 4]]
    k4 = near([(a, b) for a in range(4) for b in range(a + 1, 4)])
    assert network.cycles(k4, 4) == [[0, 1, 2, 3]] and len(network.cycles(k4, 3)) == 4


def test_loops_are_signed_and_sorted():
    loops = network.signed_loops(net([(0, 1), (1, 2), (0, 2), (2, 3), (0, 3)]), 4)
    assert [[(i.ifg_id, s) for i, s in x.edges] for x in loops] == [[(0, 1), (2, -1), (1, 1)], [(0, 1), (4, -1), (1, 1), (3, 1)], [(2, 1), (4, -1), (3, 1)]]
    assert [x.weight for x in loops] == sorted(x.weight for x in loops)
    assert len(network.limit_redundancy(loops * 5, 1)) < 15


def test_spanning_tree():
    n = Network(tuple(Ifg(i, date(2006, a, 1), date(2006, b, 1), w) for i, (a, b, w) in enumerate([(1, 2, 0.5), (2, 3, 0.1), (1, 3, 0.1), (5, 6, 0.9)])), (date(2006, 1, 1), date(2006, 2, 1), date(2006, 3, 1), date(2006, 5, 1), date(2006, 6, 1)))
    tree = network.spanning_tree(n)
    assert [i.ifg_id for i in tree.ifgs] == [1, 2, 3] and not tree.is_tree and tree.n_trees == 2
    assert network.spanning_tree(net([(0, 1), (1, 2)])).is_tree


def test_dates_must_run_forward():
    with pytest.raises(ValueError):
        net([(1, 0)])


def test_pivoted_qr_and_dependent_rows():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a = rng.standard_normal((5, 4))
        order, r = kernels.pivoted_qr(a)
        assert np.allclose(np.abs(np.diag(r)), sorted(np.abs(np.diag(r)), reverse=True))
        assert np.allclose(r.T @ r, a[:, order].T @ a[:, order])
    # Two trees: what spans the gap can't be had.
    b = kernels.design([0, 1, 3], [1, 2, 4], np.ones(4))
    assert kernels.independent_rows(b) is not None
    assert kernels.independent_rows(b[:1]) is None


def test_laplacian_smooths():
    b = kernels.design(range(6), range(1, 7), np.ones(6))
    y = np.array([1, -1, 1, -1, 1, -1.0]) + 5
    rough = kernels.svd_operator(b, True)[2] @ y
    smooth = kernels.laplacian_operator(b, True, 1, 10.0, np.eye(6))[2] @ y
    assert np.allclose(rough, y) and smooth.std() < rough.std() / 5


def test_minimise():
    assert abs(kernels.minimise(lambda x: (x - 0.37) ** 2, 1.0) - 0.37) < 1e-4


def test_autocorrelation_by_definition():
    x = np.random.default_rng(3).standard_normal((6, 5))
    found = kernels.autocorrelation(x)
    assert np.isclose(found[3, 2], (x**2).sum() / 30) and np.isclose(found.max(), found[3, 2])
    shifted = sum(x[i, j] * x[(i + 1) % 6, j] for i in range(6) for j in range(5)) / 30
    assert np.isclose(found[4, 2], shifted)


def test_decay_with_distance():
    """The fit finds the length of a correlated field."""
    rng = np.random.default_rng(7)
    image = kernels.gaussian_lowpass(rng.standard_normal((64, 64)), 1.0, 90, 90, None, 128)
    rough = kernels.covariance_with_distance(rng.standard_normal((64, 64)), 90, 90)
    smooth = kernels.covariance_with_distance(image / image.std(), 90, 90)
    assert smooth[1] < rough[1] and np.isclose(kernels.covariance_with_distance(image, 90, 90, False)[0], (image**2).mean())


def test_gaussian_lowpass():
    x = np.random.default_rng(1).standard_normal((20, 30))
    x[3, 4] = np.nan
    low = kernels.gaussian_lowpass(x, 0.5, 100, 80, "nearest", 64)
    assert np.isnan(low[3, 4]) and np.nanstd(low) < np.nanstd(x) and low.shape == x.shape
    with pytest.raises(ValueError):
        kernels.gaussian_lowpass(x, 0.5, 100, 80, "cubic", 64)


def test_fills():
    x = np.array([[1, np.nan, np.nan, 4.0], [5, np.nan, 7, 8.0]])
    assert kernels.fill_nearest(x).tolist() == [[1, 1, 4, 4], [5, 5, 7, 8]]
    assert np.allclose(kernels.fill_linear(x), [[1, 2, 3, 4], [5, 6, 7, 8]])
    assert not np.isnan(kernels.fill_nearest(np.full((2, 2), np.nan))).any()


def test_azimuth():
    """Due east and north, and a point itself."""
    lat = np.radians([0.0, 0.0, -37.95, 10.0])
    lon = np.radians([10.0, 10.0, 144.42, 20.0])
    out = kernels.vincenty_azimuth(lat, lon, np.radians([0.0, 5.0, -37.65, 10.0]), np.radians([11.0, 10.0, 143.93, 20.0]), 6378137.0, 6356752.3141)
    assert np.allclose(out[:2], [math.pi / 2, 0]) and 5 < out[2] < 2 * math.pi and out[3] == 0


def test_cell_size():
    x, y = kernels.cell_size(-34.17, 150.91, 0.000833333, -0.000833333)
    assert 74.5 < x < 79.2 and 88 < y < 92  # the zone's grid is turned by a degree here
    with pytest.raises(ValueError):
        kernels.cell_size(85, 0, 1, 1)
    # The central meridian and the equator are fixed points of the projection.
    assert np.allclose(kernels.mercator(0, 3, 31), (500_000, 0), atol=1e-6)


def test_epoch_baselines():
    n = net([(0, 1), (1, 2), (0, 2)])
    assert np.allclose(network.epoch_baselines(n, [10.0, -4.0, 6.0]), [0, 10, 6])


def test_tree_paths_are_exact():
    """On a spanning tree the least-norm answer is the sum along the path."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = 7
        edges = [(int(rng.integers(0, i)), i) for i in range(1, n)]
        steps = rng.random(n - 1) + 0.1
        truth = np.concatenate([[0], np.cumsum(rng.standard_normal(n - 1))])
        b = kernels.design([a for a, _ in edges], [z for _, z in edges], steps)
        y = np.array([truth[z] - truth[a] for a, z in edges])
        assert np.allclose(np.cumsum(kernels.svd_operator(b, True)[2] @ y * steps), truth[1:])
