"""Clusterings of long series: blocked kernel sums against dense ones, and memory."""

import tracemalloc

import numpy as np
import pytest

from tidemark.functions import fuzzy


def dense(x, sharpness):
    return np.exp(-sharpness * ((x[:, None] - x[None]) ** 2).sum(2)).sum(1)


@pytest.mark.parametrize("n, columns, sharpness", [(1, 1, 4.0), (700, 1, 4.0), (1500, 2, 100.0), (900, 3, 1e5), (800, 12, 4.0), (1300, 5, 400.0)])
def test_blocked_sums_equal_dense_ones(n, columns, sharpness):
    rng = np.random.default_rng(n)
    x = np.concatenate((rng.random((n - n // 3, columns)), rng.random((n // 3, columns)) * 1e-3))
    x[-1] = x[0]
    assert np.allclose(fuzzy.kernel_sums(x, sharpness), dense(x, sharpness), rtol=1e-12, atol=0)


def test_one_point_many_times():
    assert fuzzy.kernel_sums(np.ones((600, 2)), 4.0) == pytest.approx(np.full(600, 600.0))


def centers_by_definition(data, radius):
    low, span = data.min(0), np.ptp(data, 0)
    z = (data - low) / np.where(span > 0, span, 1.0)
    p = dense(z, 4 / radius**2)
    chosen, first = [], None
    while True:
        i = int(p.argmax())
        share = p[i] / (first or p[i])
        if p[i] <= 0 or (chosen and share <= fuzzy.REJECT):
            return chosen
        if chosen and share < fuzzy.ACCEPT and np.sqrt(((z[chosen] - z[i]) ** 2).sum(1).min()) / radius + share < 1:
            p[i] = 0.0
            continue
        first = first or p[i]
        chosen.append(i)
        p = np.maximum(0.0, p - p[i] * np.exp(-4 / (fuzzy.SQUASH * radius) ** 2 * ((z - z[i]) ** 2).sum(1)))


@pytest.mark.parametrize("radius", [0.2, 0.5, 1.0])
def test_centers_equal_the_dense_way(radius):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (400, 2)) for c in ((0, 0), (3, 1), (1, 4))])
    assert list(fuzzy.subtractive(x, radius)[0]) == centers_by_definition(x, radius)


def test_a_hundred_thousand_points():
    """Memory stays linear: some hundred MB less than the 80 GB of all distances."""
    rng = np.random.default_rng(5)
    middles = rng.random((6, 2))
    x = np.concatenate([rng.normal(c, 0.02, (100_000 // 6, 2)) for c in middles])
    tracemalloc.start()
    at, _ = fuzzy.subtractive(x, 0.08)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    low, span = x.min(0), np.ptp(x, 0)
    near = np.sqrt((((x[at][:, None] - middles[None]) / span) ** 2).sum(2)).min(0)
    assert (near < 0.05).all()
