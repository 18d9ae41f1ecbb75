"""One-step forecasters that are fitted once and then only observe (NumPy).

Each has ``forecast()`` (next value, from what was observed so far) and ``observe(y)``. Parameters never change after the
fit. ``run`` forecasts and observes a test series and reports failures by stage, never another model's values.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np

from tidemark.functions import smoothing, statespace


class Naive:
    def __init__(self, y: np.ndarray, m: int = 1):
        self.last = y[-1]

    def forecast(self) -> float:
        return self.last

    def observe(self, y: float) -> None:
        self.last = y

    def packed(self) -> tuple[list[int], list[float], list[float], list[float]]:
        return [], [], [self.last], []

    @classmethod
    def of(cls, order: list[int], fixed: list[float], latent: list[float], buffer: list[float]) -> Naive:
        return cls(np.array(latent))


class SeasonalNaive:
    def __init__(self, y: np.ndarray, m: int):
        if m <= 1 or len(y) < m:
            raise ValueError("a season of more than one value, and one season of data are needed")
        self.ring = list(y[-m:])

    def forecast(self) -> float:
        return self.ring[0]

    def observe(self, y: float) -> None:
        self.ring = [*self.ring[1:], y]

    def packed(self) -> tuple[list[int], list[float], list[float], list[float]]:
        return [], [], [], list(self.ring)

    @classmethod
    def of(cls, order: list[int], fixed: list[float], latent: list[float], buffer: list[float]) -> SeasonalNaive:
        return cls(np.array(buffer), len(buffer))


class Drift(Naive):
    def __init__(self, y: np.ndarray, m: int = 1):
        super().__init__(y)
        self.slope = (y[-1] - y[0]) / (len(y) - 1)

    def forecast(self) -> float:
        return self.last + self.slope

    def packed(self) -> tuple[list[int], list[float], list[float], list[float]]:
        return [], [self.slope], [self.last], []

    @classmethod
    def of(cls, order: list[int], fixed: list[float], latent: list[float], buffer: list[float]) -> Drift:
        new = cls.__new__(cls)
        [new.slope], [new.last] = fixed, latent
        return new


def season_means(y: np.ndarray, m: int) -> np.ndarray:
    """Additive seasonal figures: mean deviation from a centered moving average by position, summing to 0."""
    kernel = np.ones(m) / m if m % 2 else np.concatenate(([0.5], np.ones(m - 1), [0.5])) / m
    half = len(kernel) // 2
    deviation = y[half : len(y) - half] - np.convolve(y, kernel, "valid")
    at = np.arange(half, len(y) - half) % m
    figures = np.array([deviation[at == k].mean() for k in range(m)])
    return figures - figures.mean()


class Theta:
    """The two-line method: half the trend of a regression on time, and exponential smoothing, season added back."""

    def __init__(self, y: np.ndarray, m: int = 1):
        self.m = m if m > 1 and len(y) >= 2 * m + 1 else 1
        self.season = season_means(y, self.m) if self.m > 1 else np.zeros(1)
        self.n = len(y)
        z = y - self.season[np.arange(self.n) % self.m]
        t = np.arange(self.n)
        self.slope = float(((t - t.mean()) * (z - z.mean())).sum() / ((t - t.mean()) ** 2).sum())

        def error(a: float) -> tuple[float, float]:
            level, sse = z[0], 0.0
            for v in z[1:]:
                sse += (v - level) ** 2
                level += a * (v - level)
            return sse, level

        grid = np.linspace(0.01, 0.99, 50)
        a = float(grid[np.argmin([error(v)[0] for v in grid])])
        fine = np.clip(np.linspace(a - 0.02, a + 0.02, 41), 1e-3, 0.999)
        self.alpha = float(fine[np.argmin([error(v)[0] for v in fine])])
        self.level = error(self.alpha)[1]

    def forecast(self) -> float:
        trend = 0.5 * self.slope * (1 / self.alpha - (1 - self.alpha) ** self.n / self.alpha)
        return trend + self.level + self.season[self.n % self.m]

    def observe(self, y: float) -> None:
        self.level += self.alpha * (y - self.season[self.n % self.m] - self.level)
        self.n += 1

    def packed(self) -> tuple[list[int], list[float], list[float], list[float]]:
        """The number of values is part of the state: the trend's weight depends on it."""
        return [self.m], [self.slope, self.alpha, *self.season], [self.level, float(self.n)], []

    @classmethod
    def of(cls, order: list[int], fixed: list[float], latent: list[float], buffer: list[float]) -> Theta:
        new = cls.__new__(cls)
        [new.m], (new.slope, new.alpha), new.season = order, fixed[:2], np.array(fixed[2:])
        new.level, new.n = latent[0], int(latent[1])
        return new


class Ets:
    """Additive exponential smoothing (trend none, linear or damped; season if m > 1), chosen by AICc among the candidates whose
    optimum was reached (ties: the first)."""

    def __init__(self, y: np.ndarray, m: int = 1, options: list[tuple[str, bool]] | None = None):
        y = np.asarray(y, float)
        fits = [smoothing.fit(y, m, *o) for o in options or smoothing.candidates(m if len(y) >= 2 * m + 1 else 1)]
        usable = [f for f in fits if f["converged"] and np.isfinite(f["aicc"])]
        if not usable:
            raise ValueError("no smoothing model has an optimum with a finite criterion")
        self.fit = min(usable, key=lambda f: f["aicc"])
        self.trend, self.seasonal, self.weights = self.fit["trend"], self.fit["seasonal"], self.fit["weights"]
        self.state = smoothing.State(m, self.trend, self.seasonal, self.weights, self.fit["states"])
        for v in y:
            self.state.observe(float(v))

    def forecast(self) -> float:
        return self.state.forecast()

    def observe(self, y: float) -> None:
        self.state.observe(float(y))


def sarima_candidates(m: int) -> list[tuple[int, int, int, int, int, int]]:
    """(p, d, q, P, D, Q): p, q up to 2, the rest up to 1, at most 4 coefficients, seasonal ones only with a season."""
    seasonal = list(product((0, 1), repeat=3)) if m > 1 else [(0, 0, 0)]
    return [(p, d, q, P, D, Q) for p, q, d in product(range(3), range(3), range(2)) for P, D, Q in seasonal if p + q + P + Q <= 4]


class Sarima:
    """Seasonal ARIMA by exact maximum likelihood; order by AICc among ``orders``, all candidates by default. Orders without an
    optimum don't count; of equal ones the one with fewer parameters stays. Observing is a step of the Kalman filter."""

    def __init__(self, y: np.ndarray, m: int = 1, orders: list[tuple[int, int, int, int, int, int]] | None = None):
        y = np.asarray(y, float)
        fits = statespace.fit(y, m, orders or sarima_candidates(m))
        usable = [(score, f["k"], f["order"], f) for f in fits if f["converged"] and np.isfinite(score := statespace.aicc(f["loglik"], f["k"], f["n"]))]
        if not usable:
            raise ValueError("no order could be fitted")
        self.fit = min(usable, key=lambda u: u[:3])[3]
        self.order = self.fit["order"]
        self.state = statespace.State(y, m, self.order, self.fit["u"], self.fit["mean"])

    def forecast(self) -> float:
        return self.state.forecast()

    def observe(self, y: float) -> None:
        self.state.observe(float(y))


# -- regressions on lags ------------------------------------------------------------------------------------------------


def lagged(y: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    return np.lib.stride_tricks.sliding_window_view(y, lags)[:-1].copy(), y[lags:].copy()


def lags_for(m: int) -> int:
    return min(12, max(5, m))


class Ridge:
    def __init__(self, x: np.ndarray, y: np.ndarray, alpha: float = 1.0):
        self.w = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w


class KernelSvr:
    """Support vector regression with a Gaussian kernel: coordinate ascent on the dual (the bias is in the kernel)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, c: float = 10.0, epsilon: float = 0.05, gamma: float | None = None, rounds: int = 200):
        self.x = x
        self.gamma = gamma or 1.0 / (x.shape[1] * max(float(x.var()), 1e-12))
        k = self._kernel(x)
        self.beta, f = np.zeros(len(x)), np.zeros(len(x))
        for _ in range(rounds):
            moved = 0.0
            for i in range(len(x)):
                g = y[i] - f[i] + self.beta[i] * k[i, i]
                new = np.clip(np.sign(g) * max(abs(g) - epsilon, 0.0) / k[i, i], -c, c)
                step = new - self.beta[i]
                if step:
                    f += step * k[:, i]
                    self.beta[i] = new
                    moved = max(moved, abs(step))
            if moved < 1e-6:
                break

    def _kernel(self, other: np.ndarray) -> np.ndarray:
        d = ((other[:, None, :] - self.x[None]) ** 2).sum(axis=2)
        return np.exp(-self.gamma * d) + 1.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._kernel(x) @ self.beta


class Boosted:
    """Second-order boosted regression trees (squared error, exact splits)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 3, rate: float = 0.05, l2: float = 1.0, least: float = 1.0):
        self.base, self.rate, self.trees = float(y.mean()), rate, []
        f = np.full(len(y), self.base)
        for _ in range(trees):
            tree = self._grow(x, y - f, np.arange(len(y)), depth, l2, least)
            self.trees.append(tree)
            f += rate * self._apply(tree, x)

    def _grow(self, x, g, rows, depth, l2, least):
        total, n = g[rows].sum(), len(rows)
        best = (1e-12, None, None)
        if depth and n >= 2 * least:
            for j in range(x.shape[1]):
                order = rows[np.argsort(x[rows, j], kind="stable")]
                v, left = x[order, j], g[order].cumsum()[:-1]
                k = np.arange(1, n)
                gain = left**2 / (k + l2) + (total - left) ** 2 / (n - k + l2) - total**2 / (n + l2)
                gain[(v[1:] == v[:-1]) | (k < least) | (n - k < least)] = -1
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], j, (v[i] + v[i + 1]) / 2)
        if best[1] is None:
            return float(total / (n + l2))
        _, j, cut = best
        low = x[rows, j] <= cut
        return j, cut, self._grow(x, g, rows[low], depth - 1, l2, least), self._grow(x, g, rows[~low], depth - 1, l2, least)

    def _apply(self, tree, x) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, low, high = tree
        return np.where(x[:, j] <= cut, self._apply(low, x), self._apply(high, x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum(self._apply(t, x) for t in self.trees)


# Parameter grids (fixed values), in the order in which ties are decided.
RIDGE_ALPHAS = (1e-3, 1e-2, 0.1, 1.0, 10.0, 100.0, 1000.0)
SVR_GRID = tuple(product((0.1, 1.0, 10.0, 100.0), (0.2, 0.1, 0.01), (None, 0.01, 0.1)))
BOOSTED_GRID = tuple(product((50, 150), (2, 3), (0.05, 0.1), (5.0, 1.0)))


def candidates(method: str, m: int) -> list[tuple]:
    """What a method chooses from, in the order in which ties are decided; an empty tuple where there's nothing to choose."""
    grids = {"ridge": [(a,) for a in RIDGE_ALPHAS], "svr_rbf": list(SVR_GRID), "xgboost": list(BOOSTED_GRID)}
    if method == "sarima":
        return sarima_candidates(m)
    return smoothing.candidates(m) if method == "ets" else grids.get(method, [()])


class LagRegression:
    """A regression on the last values, its parameters chosen by scaled error on the end of the training part."""

    def __init__(self, y: np.ndarray, m: int, kind: str, lags: int | None = None):
        self.kind, self.lags = kind, lags or lags_for(m)
        n = len(y)
        tail = min(max(5, int(np.ceil(0.2 * n))), n - self.lags - 10)
        if tail < 5:
            raise ValueError("too short for an inner validation")
        options = candidates(kind, m)
        x, target = lagged(y, self.lags)
        fit = slice(0, len(x) - tail)
        inner = y[: n - tail]
        scale = np.abs(inner[m:] - inner[:-m]).mean() if m < len(inner) else 0.0
        if scale <= 1e-12:
            raise ValueError("the season step is zero")
        best = None
        for params in options:
            self._fit(x[fit], target[fit], params)
            error = float(np.abs(self._predict(x[len(x) - tail :]) - target[len(x) - tail :]).mean() / scale)
            if best is None or (error <= best[0] if kind == "ridge" else error < best[0]):  # ridge: ties go to the larger alpha
                best = (error, params)
        self.validation_mase, self.params = best
        self._fit(x, target, self.params)
        self.history = list(y[-self.lags :])

    def _fit(self, x: np.ndarray, y: np.ndarray, params: tuple) -> None:
        if self.kind == "xgboost":
            self.mean = self.sd = None
            trees, depth, rate, least = params
            self.model = Boosted(x, y, trees, depth, rate, 1.0, least)
            return
        self.mean, self.sd = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
        self.y_mean, self.y_sd = float(y.mean()), float(y.std()) or 1.0
        z, t = (x - self.mean) / self.sd, (y - self.y_mean) / self.y_sd
        self.model = Ridge(z, t, *params) if self.kind == "ridge" else KernelSvr(z, t, *params)

    def _predict(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return self.model.predict(x)
        return self.model.predict((x - self.mean) / self.sd) * self.y_sd + self.y_mean

    def forecast(self) -> float:
        return float(self._predict(np.array([self.history]))[0])

    def observe(self, y: float) -> None:
        self.history = [*self.history[1:], y]


class LinearLags:
    """A fitted linear regression on lags as numbers: scaling, weights, and the last values."""

    def __init__(self, model: LagRegression):
        self.mean, self.sd, self.y_mean, self.y_sd, self.w = model.mean, model.sd, model.y_mean, model.y_sd, model.model.w
        self.history = np.array(model.history, float)

    def forecast(self) -> float:
        return float((self.history - self.mean) / self.sd @ self.w * self.y_sd + self.y_mean)

    def observe(self, y: float) -> None:
        self.history = np.append(self.history[1:], y)

    def packed(self) -> tuple[list[int], list[float], list[float], list[float]]:
        return [], [self.y_mean, self.y_sd, *self.mean, *self.sd, *self.w], [], list(self.history)

    @classmethod
    def of(cls, order: list[int], fixed: list[float], latent: list[float], buffer: list[float]) -> LinearLags:
        new = cls.__new__(cls)
        new.y_mean, new.y_sd = fixed[:2]
        new.mean, new.sd, new.w = np.array(fixed[2:]).reshape(3, -1)
        new.history = np.array(buffer)
        return new


METHODS: dict[str, Callable] = {
    "naive_1": Naive,
    "seasonal_naive": SeasonalNaive,
    "drift": Drift,
    "theta": Theta,
    "ets": Ets,
    "sarima": Sarima,
    "arima_110": lambda y, m: Sarima(y, m, [(1, 1, 0, 0, 0, 0)]),
    "ridge": lambda y, m: LagRegression(y, m, "ridge"),
    "svr_rbf": lambda y, m: LagRegression(y, m, "svr_rbf"),
    "xgboost": lambda y, m: LagRegression(y, m, "xgboost"),
}


#: Methods whose fitted form is a few numbers, with the class that takes them: what a stream keeps for a series.
STATES: dict[str, type] = {"naive_1": Naive, "seasonal_naive": SeasonalNaive, "drift": Drift, "theta": Theta, "ets": smoothing.State, "sarima": statespace.State, "arima_110": statespace.State, "ridge": LinearLags}


def state_of(method: str, y: np.ndarray, m: int):
    """The fitted form of a method on the values y."""
    model = METHODS[method](np.asarray(y, float), m)
    return model.state if method in ("ets", "sarima", "arima_110") else LinearLags(model) if method == "ridge" else model


#: Other names of methods (fixed values).
ALIASES = {"naive": "naive_1", "persistence": "naive_1"}


def method_name(name: str) -> str:
    return ALIASES.get(name.lower(), name.lower())


def run(method: str, train: np.ndarray, test: np.ndarray, m: int) -> tuple[np.ndarray, str, str | None]:
    """Predictions (NaN from a failure on), status, and the stage of a failure ('fit', 'forecast' or 'update') with its message."""
    out, stage = np.full(len(test), np.nan), "fit"
    try:
        name = method_name(method)
        if name not in METHODS:
            raise ValueError(f"there is no method {method}")
        model = METHODS[name](np.asarray(train, float), m)
        for i, y in enumerate(test):
            stage = "forecast"
            value = float(model.forecast())
            if not np.isfinite(value):
                raise ValueError("the forecast isn't finite")
            out[i] = value
            stage = "update"
            model.observe(float(y))
    except (ValueError, ArithmeticError, np.linalg.LinAlgError, IndexError) as e:
        return out, "failed", f"{stage}: {e}"
    return out, "success", None


def initial_train(n: int, fraction: float = 0.85) -> int | None:
    """Values to start from among n, halves rounded to even; None unless it is 10 at least and less than n."""
    size = round(n * fraction)
    return size if 10 <= size < n else None


def rolling_refit(method: str, y: np.ndarray, start: int, m: int) -> tuple[np.ndarray, int]:
    """Refits before every step; where that fails the last value is taken and counted."""
    out, failed = np.empty(len(y) - start), 0
    for i, t in enumerate(range(start, len(y))):
        try:
            out[i] = float(METHODS[method](y[:t], m).forecast())
            if not np.isfinite(out[i]):
                raise ValueError("not finite")
        except (ValueError, ArithmeticError, np.linalg.LinAlgError, IndexError):
            out[i], failed = y[t - 1], failed + 1
    return out, failed
