"""The neuro-fuzzy forecasters: prepare, cluster, search antecedents, refit consequents, forecast with observed lags."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tidemark.functions import fuzzy, swarm
from tidemark.functions.forecasters import lagged

LOW, HIGH = 0.1, 0.9
#: Ablations: dynamics, boundary, objective weights; no dynamics: clusters and ridge alone.
VARIANTS = {
    "PC": ("constricted", "feasible_rejection", None),
    "P": ("nonconstricted", "feasible_rejection", None),
    "C": ("constricted", "project", None),
    "NEITHER": ("nonconstricted", "project", None),
    "VALIDATION_ONLY": ("constricted", "feasible_rejection", (0.0, 1.0, 0.0, 0.0)),
    "NO_SENSITIVITY": ("constricted", "feasible_rejection", (0.5, 1.0, 0.0, 0.01)),
    "NO_COVERAGE": ("constricted", "feasible_rejection", (0.5, 1.0, 0.001, 0.0)),
    "NF_BASE": (None, None, None),
}


@dataclass
class Fitted:
    model: fuzzy.Tsk
    low: float
    high: float
    lags: int
    last: np.ndarray
    objective: float = float("nan")
    history: list[dict] = field(default_factory=list)

    def scale(self, y: np.ndarray) -> np.ndarray:
        return LOW + (y - self.low) * (HIGH - LOW) / (self.high - self.low)

    def forecast(self, test: np.ndarray) -> np.ndarray:
        """One step ahead over the whole test part at once: lags are observed values, so they are known rows."""
        x, _ = lagged(self.scale(np.concatenate((self.last, test))), self.lags)
        return self.low + (self.model.predict(x) - LOW) * (self.high - self.low) / (HIGH - LOW)


def step_by_step(fitted: Fitted, test: np.ndarray) -> np.ndarray:
    """As ``Fitted.forecast`` with a buffer of lags: predict, then observe."""
    buffer, out = list(fitted.last), []
    for y in test:
        x = fitted.scale(np.array(buffer[-fitted.lags :]))[None]
        out.append(fitted.low + (float(fitted.model.predict(x)[0]) - LOW) * (fitted.high - fitted.low) / (HIGH - LOW))
        buffer.append(float(y))
    return np.array(out)


def prepare(train: np.ndarray, lags: int):
    """Scaled fit rows, validation rows, and the bounds of the fit part (its lags included)."""
    rows = len(train) - lags
    tail = max(8, int(np.floor(0.2 * rows)))
    if rows - tail < 11:
        raise ValueError("too short: 11 fit rows are needed")
    part = train[: lags + rows - tail]
    low, high = float(part.min()), float(part.max())
    if high <= low:
        raise ValueError("the fit part is constant")
    x, y = lagged(LOW + (train - low) * (HIGH - LOW) / (high - low), lags)
    return (x[:-tail], y[:-tail]), (x[-tail:], y[-tail:]), low, high


def evaluate(start: fuzzy.Tsk, antecedents: np.ndarray, near, far, alpha: float = 0.05, weights: tuple[float, ...] | None = None) -> tuple[fuzzy.Tsk, float]:
    """Variable projection: the consequents that fit ``near`` best with these antecedents, and the objective of that model."""
    candidate = start.with_vector(antecedents).fit(*near, alpha)
    return candidate, fuzzy.objective(candidate, near, far, weights or (fuzzy.W_FIT, fuzzy.W_VALIDATION, fuzzy.W_SENSITIVITY, fuzzy.W_COVERAGE))


def fit(train: np.ndarray, lags: int, radius: float = 1.0, alpha: float = 0.05, seed: int = 41001, variant: str = "PC", particles: int = 12, rounds: int = 40) -> Fitted:
    dynamics, boundary, weights = VARIANTS[variant]
    near, far, low, high = prepare(train, lags)
    start = fuzzy.initial(*near, radius)
    best, value, history = start.vector(), float("nan"), []
    if dynamics:
        best, value, history = swarm.minimise(lambda v: evaluate(start, v, near, far, alpha, weights)[1], start.vector(), *fuzzy.bounds(near[0], len(start.center)), particles, rounds, seed, dynamics, boundary)
    x, y = np.concatenate((near[0], far[0])), np.concatenate((near[1], far[1]))
    return Fitted(start.with_vector(best).fit(x, y, alpha), low, high, lags, train[-lags:], value, history)


def fit_dynamic(train: np.ndarray, lags: int, seed: int = 41001, rules: int = 2, particles: int = 15, rounds: int = 45) -> Fitted:
    """Radius searched along with the antecedents."""
    lags = min(lags, 2) if len(train) < 25 else lags
    near, far, low, high = prepare(train, lags)
    model, radius, value = swarm.dynamic_radius(*near, *far, rules=rules, particles=particles, rounds=rounds, low=0.20, high=0.60, penalty=0.02, seed=seed)
    x, y = np.concatenate((near[0], far[0])), np.concatenate((near[1], far[1]))
    return Fitted(model.fit(x, y, 0.05), low, high, lags, train[-lags:], value, [{"iteration": rounds, "radius": radius}])


def fit_fcm(train: np.ndarray, lags: int = 3, rules: int = 2, alpha: float = 0.05, m: float = 2.0) -> Fitted:
    """Rules at fuzzy c-means centers of the standardised series, widths by membership."""
    mean, sd = float(train.mean()), float(train.std()) + 1e-8
    x, y = lagged((train - mean) / sd, lags)
    center, u = fuzzy.fuzzy_c_means(x, rules, m)
    w = u**m
    sigma = np.sqrt((w[:, :, None] * (x[:, None, :] - center[None]) ** 2).sum(axis=0) / w.sum(axis=0)[:, None]) + 1e-3
    model = fuzzy.Tsk(center, sigma, np.zeros((rules, lags + 1))).fit(x, y, alpha)
    # The same linear map, written as bounds that LOW and HIGH stand for.
    return Fitted(model, mean + LOW * sd, mean + HIGH * sd, lags, train[-lags:])


def hybrid(train: np.ndarray, test: np.ndarray, lags: int, seed: int = 41001) -> np.ndarray:
    """Linear trend of the training part plus a dynamic model of what is left."""
    t = np.arange(len(train) + len(test))
    slope, intercept = np.polyfit(t[: len(train)], train, 1)
    trend = intercept + slope * t
    fitted = fit_dynamic(train - trend[: len(train)], lags, seed)
    return trend[len(train) :] + fitted.forecast(test - trend[len(train) :])
