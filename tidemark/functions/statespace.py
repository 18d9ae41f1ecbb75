"""Exact Gaussian likelihood of seasonal ARIMA models by a Kalman filter (NumPy), for many parameters at a time.

The differenced series w is a stationary ARMA process with the polynomials' products as lags, in companion form: a state of r
values with mean a and covariance P before each value. The start is the stationary covariance (the start of the d + D m values
lost to differencing is diffuse: they are conditioned on, which leaves the likelihood of w). The mean, if there's one, and the
variance are worked out in closed form for given lags (both are linear in what the filter gives).

Lags are stated by partial autocorrelations within bounds, so that every point is stationary and invertible.
"""

from __future__ import annotations

from itertools import product

import numpy as np

from tidemark.functions.optimum import minimise

#: Bound of partial autocorrelations.
BOUND = 0.99
#: (p, q, P, Q) at most; the places of the coefficients in a vector: two of AR, two of MA, one seasonal of each.
WIDTH = 6


def difference(y: np.ndarray, m: int, d: int, sd: int) -> np.ndarray:
    y = np.asarray(y, float)
    for _ in range(sd):
        y = y[m:] - y[:-m]
    return np.diff(y, d) if d else y


def difference_weights(m: int, d: int, sd: int) -> np.ndarray:
    """c_1, c_2, ...: the differenced value is y_t + c_1 y_{t-1} + c_2 y_{t-2} + ..."""
    c = np.ones(1)
    for _ in range(sd):
        c = np.convolve(c, np.concatenate(([1.0], np.zeros(m - 1), [-1.0])))
    for _ in range(d):
        c = np.convolve(c, [1.0, -1.0])
    return c[1:]


def _short(u: np.ndarray) -> np.ndarray:
    """Coefficients of lags 1 and 2 from two partial autocorrelations (the second may be 0)."""
    return np.stack((u[..., 0] * (1 - u[..., 1]), u[..., 1]), -1)


def polynomials(u: np.ndarray, m: int, seasonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Lag coefficients (index 0 is lag 1) of both sides, for vectors of partial autocorrelations (points x WIDTH)."""
    n = 2 + (m if seasonal else 0)
    ar, ma = np.zeros((len(u), n)), np.zeros((len(u), n))
    short_ar, short_ma = _short(u[:, :2]), -_short(u[:, 2:4])
    ar[:, :2], ma[:, :2] = short_ar, short_ma
    if seasonal:
        for out, short, long, sign in ((ar, short_ar, u[:, 4], -1.0), (ma, short_ma, -u[:, 5], 1.0)):
            out[:, m - 1] += long
            out[:, m] += sign * short[:, 0] * long
            out[:, m + 1] += sign * short[:, 1] * long
    return ar, ma


def companion(ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First column of the transition (the rest shifts up) and the weights of the shock, padded to r values."""
    phi = np.pad(ar, ((0, 0), (0, 1)))
    return phi, np.pad(ma, ((0, 0), (1, 0)), constant_values=1.0)


def stationary(phi: np.ndarray, shock: np.ndarray) -> np.ndarray:
    """Covariance of the state in the long run, by doubling: P = sum of T^k S T'^k."""
    b, r = phi.shape
    t = np.zeros((b, r, r))
    t[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    t[:, :, 0] += phi
    p = shock[:, :, None] * shock[:, None, :]
    for _ in range(40):
        step = t @ p @ t.transpose(0, 2, 1)
        p = p + step
        t = t @ t
        if not (np.abs(step).max() > 1e-13 * np.abs(p).max()):
            break
    return p


def _shift(x: np.ndarray, axis: int) -> np.ndarray:
    """Values moved up by one along an axis, 0 at the end."""
    out = np.zeros_like(x)
    if axis == 1:
        out[:, :-1] = x[:, 1:]
    else:
        out[:, :, :-1] = x[:, :, 1:]
    return out


def filtered(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prediction errors of w and of a series of ones (points x n x 2), their variances (points x n, in units of that of the
    shocks), and the state's mean (points x r x 2) and covariance after the last value: the prediction of the next one."""
    phi, shock = companion(ar, ma)
    used = max([1, *(np.flatnonzero(np.abs(phi).max(0)) + 1), *(np.flatnonzero(np.abs(shock).max(0)) + 1)])
    phi, shock = phi[:, :used], shock[:, :used]
    b, r = phi.shape
    p, a = stationary(phi, shock), np.zeros((b, r, 2))
    noise = shock[:, :, None] * shock[:, None, :]
    errors, variances = np.empty((b, len(w), 2)), np.empty((b, len(w)))
    settled = False
    for t, value in enumerate(w):
        if not settled:
            f = p[:, 0, 0]
            tp = phi[:, :, None] * p[:, :1, :] + _shift(p, 1)
            gain = tp[:, :, 0] / f[:, None]
            new = tp[:, :, :1] * phi[:, None, :] + _shift(tp, 2) + noise - gain[:, :, None] * gain[:, None, :] * f[:, None, None]
            settled = bool((np.abs(new - p).max((1, 2)) <= 1e-13 * f).all())
            p = new
        v = np.array([value, 1.0]) - a[:, 0]
        errors[:, t], variances[:, t] = v, f
        a = phi[:, :, None] * a[:, :1, :] + _shift(a, 1) + gain[:, :, None] * v[:, None, :]
    return errors, variances, a, p


def concentrated(errors: np.ndarray, variances: np.ndarray, with_mean: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, variance of the shocks and log-likelihood at their best, for each point."""
    n = variances.shape[1]
    mean = (errors[:, :, 0] * errors[:, :, 1] / variances).sum(1) / (errors[:, :, 1] ** 2 / variances).sum(1) if with_mean else np.zeros(len(errors))
    v = errors[:, :, 0] - mean[:, None] * errors[:, :, 1]
    sigma2 = np.maximum((v**2 / variances).mean(1), 1e-300)
    return mean, sigma2, -0.5 * (n * np.log(2 * np.pi * sigma2) + np.log(variances).sum(1) + n)


def log_likelihood(w: np.ndarray, ar: np.ndarray, ma: np.ndarray, mean: float, sigma2: float) -> float:
    """Of one set of parameters."""
    errors, variances, _, _ = filtered(w, ar[None], ma[None])
    v = errors[0, :, 0] - mean * errors[0, :, 1]
    return float(-0.5 * (np.log(2 * np.pi * sigma2 * variances[0]) + v**2 / (sigma2 * variances[0])).sum())


def bounds(orders: list[tuple]) -> np.ndarray:
    """Largest partial autocorrelations of each order (p, d, q, P, D, Q); 0 fixes those that it doesn't have."""
    return np.array([[BOUND * (p > 0), BOUND * (p > 1), BOUND * (q > 0), BOUND * (q > 1), BOUND * sp, BOUND * sq] for p, _, q, sp, _, sq in orders])


def fit(y: np.ndarray, m: int, orders: list[tuple]) -> list[dict]:
    """Maximum likelihood of each order: order, u, loglik, sigma2, mean, k (parameters), n (values of w), converged.

    Orders with the same differences are searched together; each starts from the best of a few points. Where w is constant, an
    order without coefficients fits it with no error (a variance of 1e-300), and others aren't fitted.
    """
    out = []
    for d, sd, seasonal in product((0, 1), (0, 1), (False, True)):
        some = [o for o in orders if (o[1], o[4]) == (d, sd) and (o[3] + o[5] > 0) == seasonal]
        w = difference(y, m, d, sd) if len(y) > d + sd * m else np.zeros(0)
        some = [o for o in some if len(w) >= 10 + o[0] + o[2] + m * (o[3] + o[5])]
        if not some:
            continue
        with_mean = d + sd == 0
        if w.var() <= 1e-24 * max(1.0, float(np.abs(w).max()) ** 2):  # a constant: coefficients have nothing to fit
            some = [o for o in some if not any((o[0], o[2], o[3], o[5]))]
            out += [{"order": o, "u": np.zeros(WIDTH), "loglik": 0.5 * len(w) * 690.0, "sigma2": 1e-300, "mean": float(w.mean()) if with_mean else 0.0, "k": 1 + with_mean, "n": len(w), "converged": True} for o in some]
            continue
        scaled = w / w.std()

        def cost(which, points, scaled=scaled, seasonal=seasonal, with_mean=with_mean):
            u = points.reshape(-1, WIDTH)
            errors, variances, _, _ = filtered(scaled, *polynomials(u, m, seasonal))
            value = -concentrated(errors, variances, with_mean)[2] / len(scaled)
            return np.where(np.isfinite(value), value, np.inf).reshape(points.shape[:2])

        high = bounds(some)
        tries = np.stack([np.full(WIDTH, 0.1) * s for s in (0, 1, -1)] + [np.array(s) for s in ((0.6, 0, -0.3, 0, 0.3, -0.3), (0.3, 0, 0.6, 0, 0, 0.6))])
        tries = np.clip(tries[None], -high[:, None], high[:, None])
        start = tries[np.arange(len(some)), cost(None, tries).argmin(1)]
        u, _, reached = minimise(cost, start, -high, high)
        errors, variances, _, _ = filtered(w, *polynomials(u, m, seasonal))
        mean, sigma2, loglik = concentrated(errors, variances, with_mean)
        for i, order in enumerate(some):
            k = order[0] + order[2] + order[3] + order[5] + with_mean + 1
            out.append({"order": order, "u": u[i], "loglik": float(loglik[i]), "sigma2": float(sigma2[i]), "mean": float(mean[i]), "k": k, "n": len(w), "converged": bool(reached[i])})
    return out


def aicc(loglik: float, k: int, n: int) -> float:
    return -2 * loglik + 2 * k * n / (n - k - 1) if n > k + 1 else np.inf


class State:
    """What a fitted model keeps: the lags (fixed), the state's mean and covariance, and the last values of y that differencing
    needs. ``observe`` takes one step of the filter; nothing is fitted again, and no history is kept."""

    def __init__(self, y: np.ndarray, m: int, order: tuple, u: np.ndarray, mean: float):
        self.order, self.m = tuple(order), m
        ar, ma = polynomials(np.asarray(u, float)[None], m, order[3] + order[5] > 0)
        _, _, a, p = filtered(difference(y, m, order[1], order[4]), ar, ma)
        r = a.shape[1]
        phi, shock = companion(ar, ma)
        self.phi, self.shock, self.mean = phi[0, :r], shock[0, :r], mean
        self.a, self.p = a[0, :, 0] - mean * a[0, :, 1], p[0]
        self.weights = difference_weights(m, order[1], order[4])
        self.last = np.asarray(y, float)[::-1][: len(self.weights)].copy()  # newest first

    def packed(self) -> tuple[list[int], list[float], list[float], list[float]]:
        """What never changes (order and season; mean and lags), and what does (mean and covariance of the state; last values)."""
        return [*self.order, self.m], [self.mean, *self.phi, *self.shock], [*self.a, *self.p.ravel()], list(self.last)

    @classmethod
    def of(cls, order: list[int], fixed: list[float], latent: list[float], buffer: list[float]) -> State:
        new = cls.__new__(cls)
        new.order, new.m = tuple(order[:6]), order[6]
        r = (len(fixed) - 1) // 2
        new.mean, new.phi, new.shock = fixed[0], np.array(fixed[1 : r + 1]), np.array(fixed[r + 1 :])
        new.a, new.p = np.array(latent[:r]), np.array(latent[r:]).reshape(r, r)
        new.weights, new.last = difference_weights(new.m, new.order[1], new.order[4]), np.array(buffer, float)
        return new

    def forecast(self) -> float:
        return float(self.mean + self.a[0] - self.weights @ self.last)

    def observe(self, y: float) -> None:
        v = y + self.weights @ self.last - self.mean - self.a[0]
        f = self.p[0, 0]
        tp = np.outer(self.phi, self.p[0]) + np.vstack((self.p[1:], np.zeros(len(self.p))))
        gain = tp[:, 0] / f
        self.a = self.phi * self.a[0] + np.append(self.a[1:], 0.0) + gain * v
        self.p = np.outer(tp[:, 0], self.phi) + np.hstack((tp[:, 1:], np.zeros((len(tp), 1)))) + np.outer(self.shock, self.shock) - np.outer(gain, gain) * f
        if len(self.last):
            self.last = np.append(y, self.last[:-1])
