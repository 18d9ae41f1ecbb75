"""Likelihoods, filters and searches of SARIMA and exponential smoothing against dense and plain versions."""

from itertools import product

import numpy as np
import pytest

from tidemark.functions import forecasters, optimum, smoothing, statespace


def dense(w, ar, ma, mean, sigma2, far=6000):
    """Log-density of w as one multivariate normal, covariances from the moving-average form."""
    psi = np.zeros(far)
    psi[0] = 1.0
    for k in range(1, far):
        psi[k] = (ma[k - 1] if k <= len(ma) else 0.0) + sum(ar[j] * psi[k - 1 - j] for j in range(min(len(ar), k)))
    n = len(w)
    gamma = np.array([psi[: far - h] @ psi[h:] for h in range(n)]) * sigma2
    cov = gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    x = w - mean
    return -0.5 * (n * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + x @ np.linalg.solve(cov, x))


@pytest.mark.parametrize("seed", range(8))
def test_likelihood_equals_the_dense_density(seed):
    rng = np.random.default_rng(seed)
    u = rng.uniform(-0.9, 0.9, 6) * (rng.random(6) < 0.7)
    seasonal = bool(seed % 2)
    ar, ma = statespace.polynomials(u[None], 4, seasonal)
    w = rng.normal(size=25)
    assert statespace.log_likelihood(w, ar[0], ma[0], 0.3, 1.7) == pytest.approx(dense(w, ar[0], ma[0], 0.3, 1.7), abs=1e-8)


def test_polynomials_are_products():
    u = np.array([[0.5, -0.3, 0.4, 0.2, 0.6, -0.5]])
    ar, ma = statespace.polynomials(u, 5, True)
    short = lambda a, b: np.array([a * (1 - b), b])
    full_ar = np.convolve(np.append(1, -short(0.5, -0.3)), [1, 0, 0, 0, 0, -0.6])
    full_ma = np.convolve(np.append(1, -short(0.4, 0.2)), [1, 0, 0, 0, 0, 0.5])
    assert np.allclose(-full_ar[1:], ar[0]) and np.allclose(full_ma[1:], ma[0])
    assert (np.abs(np.roots(full_ar)) < 1).all() and (np.abs(np.roots(full_ma)) < 1).all()


def series(seed, n=70, m=12):
    rng = np.random.default_rng(seed)
    return rng.normal(size=n).cumsum() + 5 * np.sin(np.arange(n) * 2 * np.pi / m) + 40


def test_the_fit_is_a_maximum_of_the_likelihood():
    y = series(1)
    for f in statespace.fit(y, 12, [(1, 0, 0, 0, 0, 0), (1, 1, 1, 0, 0, 0), (0, 1, 1, 0, 1, 1), (2, 0, 1, 1, 0, 0)]):
        assert f["converged"]
        p, d, q, sp, sd, sq = f["order"]
        w, seasonal = statespace.difference(y, 12, d, sd), sp + sq > 0

        def at(u, mean, sigma2, w=w, seasonal=seasonal):
            ar, ma = statespace.polynomials(u[None], 12, seasonal)
            return statespace.log_likelihood(w, ar[0], ma[0], mean, sigma2)

        assert at(f["u"], f["mean"], f["sigma2"]) == pytest.approx(f["loglik"], abs=1e-8)
        high = statespace.bounds([f["order"]])[0]
        rng = np.random.default_rng(2)
        for _ in range(40):
            u = np.clip(f["u"] + rng.normal(0, 0.15, 6), -high, high)
            mean = f["mean"] + (rng.normal(0, 0.3) if d + sd == 0 else 0.0)
            assert at(u, mean, f["sigma2"] * np.exp(rng.normal(0, 0.1))) <= f["loglik"] + 1e-9
        starts = rng.uniform(-0.8, 0.8, (12, 6)) * (high > 0)
        cost = lambda which, x: np.array([[-statespace.concentrated(*statespace.filtered(w, *statespace.polynomials(v[None], 12, seasonal))[:2], d + sd == 0)[2][0] / len(w) for v in row] for row in x])  # noqa: E731, B023
        _, values, _ = optimum.minimise(cost, starts, np.repeat(-high[None], 12, 0), np.repeat(high[None], 12, 0), rounds=40)
        assert -f["loglik"] / len(w) <= values.min() + 1e-6


@pytest.mark.parametrize("order", [(2, 0, 1, 0, 0, 0), (1, 1, 1, 1, 0, 1), (0, 1, 2, 1, 1, 0), (0, 1, 0, 0, 1, 0)])
def test_observing_equals_filtering_all_anew(order):
    """Mean, covariance and forecasts after each value equal those of a filter over the whole series; parameters stay."""
    y = series(3, 80)
    u = np.array([0.5, -0.2, 0.3, 0.1, 0.4, 0.3]) * (statespace.bounds([order])[0] > 0)
    state = statespace.State(y[:60], 12, order, u, 0.2)
    for t in range(60, 80):
        anew = statespace.State(y[:t], 12, order, u, 0.2)
        assert np.allclose(state.a, anew.a, atol=1e-8) and np.allclose(state.p, anew.p, atol=1e-8) and np.allclose(state.last, anew.last)
        assert state.forecast() == pytest.approx(anew.forecast(), abs=1e-7)
        state.observe(y[t])


def test_forecast_of_an_autoregression_by_hand():
    rng = np.random.default_rng(33)
    y = np.empty(120)
    y[0] = 5.0
    for t in range(1, 120):
        y[t] = 5.0 + 0.6 * (y[t - 1] - 5.0) + rng.normal()
    model = forecasters.Sarima(y, 1, [(1, 0, 0, 0, 0, 0)])
    mean, phi = model.fit["mean"], model.fit["u"][0]
    assert model.forecast() == pytest.approx(mean + phi * (y[-1] - mean))
    exact = lambda phi, mean, s2: dense(y, np.array([phi]), np.zeros(0), mean, s2)
    grid = max(exact(a, b, model.fit["sigma2"]) for a in np.linspace(0.0, 0.9, 37) for b in np.linspace(4, 6, 25))
    assert model.fit["loglik"] >= grid - 1e-9


def test_the_order_has_the_least_criterion():
    y = series(5)
    fits = statespace.fit(y, 12, forecasters.sarima_candidates(12))
    scores = {f["order"]: -2 * f["loglik"] + 2 * f["k"] + 2 * f["k"] * (f["k"] + 1) / (f["n"] - f["k"] - 1) for f in fits}
    model = forecasters.Sarima(y, 12)
    assert len(fits) > 100 and scores[model.order] == pytest.approx(min(scores.values()))


def plain_errors(y, m, trend, seasonal, point, states):
    alpha, share, season_share, phi = point
    level, slope = states[0], states[1] if trend != "none" else 0.0
    s = [*states[1 + (trend != "none") :], 0.0] if seasonal else [0.0]
    phi, beta = phi if trend == "damped" else 1.0, alpha * share if trend != "none" else 0.0
    gamma = season_share * (1 - alpha) if seasonal else 0.0
    out = []
    for t, v in enumerate(y):
        k = t % len(s)
        e = v - level - phi * slope - s[k]
        level, slope = level + phi * slope + alpha * e, phi * slope + beta * e
        s[k] += gamma * e
        out.append(e)
    return np.array(out)


@pytest.mark.parametrize("trend, seasonal", smoothing.candidates(4))
def test_smoothing_is_at_an_optimum_over_weights_and_states(trend, seasonal):
    y = series(7, 60, 4)
    f = smoothing.fit(y, 4, trend, seasonal)
    assert f["converged"]
    point, states = f["weights"], f["states"]
    e = plain_errors(y, 4, trend, seasonal, point, states)
    assert (e**2).sum() == pytest.approx(f["sse"])
    low, high = (np.array([b, b if trend != "none" else 0.5, b if seasonal else 0.5, c if trend == "damped" else 1.0]) for b, c in ((smoothing.LOW, 0.8), (smoothing.HIGH, 0.995)))

    def sse(x):
        return float((plain_errors(y, 4, trend, seasonal, x[:4], x[4:]) ** 2).sum())

    x = np.concatenate((point, states))
    for k in range(len(x)):
        step = np.zeros(len(x))
        step[k] = 1e-5 * max(1.0, abs(x[k]))
        slope = (sse(x + step) - sse(x - step)) / (2 * step[k]) / sse(x)
        if k >= 4:
            assert abs(slope) < 1e-4  # starting states are free
        elif low[k] < high[k]:
            assert abs(slope) < 1e-3 or (x[k] == low[k] and slope > 0) or (x[k] == high[k] and slope < 0)
    # No worse than a search from many points.
    grid = np.array(list(product(*(np.linspace(a, b, 9) if a < b else [a] for a, b in zip(low, high, strict=True)))))
    assert f["sse"] <= smoothing.squares(y, 4, trend, seasonal, grid).min() * (1 + 1e-6)


def test_smoothing_state_goes_on_as_the_recursion():
    y = series(9, 50, 4)
    model = forecasters.Ets(y[:40], 4)
    weights, states = model.weights.copy(), model.fit["states"].copy()
    got = []
    for v in y[40:]:
        got.append(model.forecast())
        model.observe(v)
    e = plain_errors(y, 4, model.trend, model.seasonal, weights, states)
    assert np.allclose(np.array(got), y[40:] - e[40:]) and (model.weights == weights).all()


def test_bounded_search():
    """Quadratics with their optimum inside and outside of the bounds, a curved valley, fixed variables."""
    rng = np.random.default_rng(0)
    root = rng.normal(size=(5, 3, 3))
    matrix = root @ root.transpose(0, 2, 1) + np.eye(3)
    middle = rng.normal(0, 2, (5, 3))
    f = lambda which, x: 0.5 * np.einsum("bki,bij,bkj->bk", x - middle[which][:, None], matrix[which], x - middle[which][:, None])
    low, high = np.full((5, 3), -1.0), np.full((5, 3), 1.0)
    low[4], high[4] = -9, 9
    low[3, 1] = high[3, 1] = 0.5
    x, value, reached = optimum.minimise(f, np.zeros((5, 3)), low, high)
    assert reached.all() and np.allclose(x[4], middle[4], atol=1e-4) and x[3, 1] == 0.5 and (x >= low).all() and (x <= high).all()
    for b in range(4):
        points = rng.uniform(low[b], high[b], (4000, 3))
        assert value[b] <= f(np.array([b]), points[None])[0].min() + 1e-9
    valley = lambda which, x: (1 - x[..., 0]) ** 2 + 100 * (x[..., 1] - x[..., 0] ** 2) ** 2
    x, value, reached = optimum.minimise(valley, np.array([[-1.2, 1.0]]), np.full((1, 2), -2.0), np.full((1, 2), 2.0), rounds=300)
    assert reached[0] and np.allclose(x, 1.0, atol=1e-3)
