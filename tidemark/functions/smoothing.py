"""Additive exponential smoothing with estimated starting states (NumPy).

For given weights the errors are linear in the starting states (level, slope, seasonal figures), so the best starting states are
a least-squares solution; the weights are searched within bounds by ``optimum.minimise`` with that solved at every point. The
optimum is the one over weights and states together.
"""

from __future__ import annotations

from itertools import product

import numpy as np

from tidemark.functions.optimum import minimise

#: Bounds of the weights and of damping (fixed values).
LOW, HIGH = 1e-4, 1 - 1e-4
DAMPED = (0.8, 0.995)
#: The search starts from so many of the best points of a grid, as there may be several valleys.
STARTS = 10


def candidates(m: int) -> list[tuple[str, bool]]:
    """(trend, seasonal): a season only where there is one."""
    return list(product(("none", "linear", "damped"), (False, True) if m > 1 else (False,)))


def weights(points: np.ndarray, trend: str, seasonal: bool) -> tuple[np.ndarray, ...]:
    """Gains of level, slope and season, and damping, of points (alpha, slope's share, season's share of 1 - alpha, damping)."""
    alpha, beta, gamma, phi = np.moveaxis(points, -1, 0)
    zero, one = np.zeros_like(alpha), np.ones_like(alpha)
    return alpha, alpha * beta if trend != "none" else zero, gamma * (1 - alpha) if seasonal else zero, phi if trend == "damped" else one


def responses(y: np.ndarray, m: int, trend: str, seasonal: bool, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Errors from zero starting states (points x n), and what a unit of each starting state adds (points x n x states).

    States: level, slope (if there's a trend), and all seasonal figures but the last (a constant moves between level and season
    without an effect, so that the last may be 0).
    """
    alpha, beta, gamma, phi = (v[:, None] for v in weights(points, trend, seasonal))
    states = 1 + (trend != "none") + (m - 1 if seasonal else 0)
    k = len(points)
    level, slope = np.zeros((k, 1 + states)), np.zeros((k, 1 + states))
    level[:, 1] = 1.0
    if trend != "none":
        slope[:, 2] = 1.0
    season = [np.zeros((k, 1 + states)) for _ in range(m if seasonal else 1)]
    for j in range(m - 1 if seasonal else 0):
        season[j][:, 2 + (trend != "none") + j] = 1.0
    out = np.empty((k, len(y), 1 + states))
    for t, value in enumerate(y):
        ahead = level + phi * slope
        s = season[t % len(season)]
        e = -ahead - s
        e[:, 0] += value
        out[:, t] = e
        season[t % len(season)] = s + gamma * e
        level, slope = ahead + alpha * e, phi * slope + beta * e
    return out[:, :, 0], out[:, :, 1:]


def squares(y: np.ndarray, m: int, trend: str, seasonal: bool, points: np.ndarray) -> np.ndarray:
    """Least sum of squared errors over starting states, for each point."""
    e, x = responses(y, m, trend, seasonal, points)
    q, _ = np.linalg.qr(x)
    rest = e - np.einsum("bni,bi->bn", q, np.einsum("bni,bn->bi", q, e))
    return (rest**2).sum(1)


def fit(y: np.ndarray, m: int, trend: str, seasonal: bool) -> dict:
    """Weights, starting states, sse, aicc and whether the optimum was reached."""
    y = np.asarray(y, float)
    scale = float(np.abs(y).max()) or 1.0
    low = np.array([LOW, LOW if trend != "none" else 0.5, LOW if seasonal else 0.5, DAMPED[0] if trend == "damped" else 1.0])
    high = np.array([HIGH, HIGH if trend != "none" else 0.5, HIGH if seasonal else 0.5, DAMPED[1] if trend == "damped" else 1.0])

    def cost(which, points):
        sse = squares(y / scale, m, trend, seasonal, points.reshape(-1, 4))
        return 0.5 * np.log(np.maximum(sse, 1e-30)).reshape(points.shape[:2])

    grid = np.clip(np.array(list(product((0.02, 0.25, 0.5, 0.75, 0.98), (0.02, 0.35, 0.7, 0.98), (0.02, 0.35, 0.7, 0.98), (0.8, 0.9, 0.98)))), low, high)
    grid = np.unique(grid, axis=0)
    best = np.argsort(cost(None, grid[None])[0], kind="stable")[:STARTS]
    start = grid[best]
    x, value, reached = minimise(cost, start, np.repeat(low[None], len(start), 0), np.repeat(high[None], len(start), 0))
    k = int(np.lexsort((value, ~reached))[0])
    e, r = responses(y, m, trend, seasonal, x[k : k + 1])
    states = np.linalg.lstsq(r[0], -e[0], rcond=None)[0]
    sse = float(((e[0] + r[0] @ states) ** 2).sum())
    n, params = len(y), 1 + (trend != "none") + seasonal + (trend == "damped") + 1 + (trend != "none") + m * seasonal
    room = n - params - 3
    score = n * np.log(max(sse, 1e-300) / n) + 2 * params + (2 * (params + 2) * (params + 3) / room if room > 0 else np.inf)
    return {"trend": trend, "seasonal": seasonal, "weights": x[k], "states": states, "sse": sse, "aicc": float(score), "converged": bool(reached[k])}


class State:
    """Level, slope and seasonal figures of a fitted model; ``observe`` takes one step with weights that never change."""

    def __init__(self, m: int, trend: str, seasonal: bool, point: np.ndarray, states: np.ndarray):
        self.gains = tuple(float(v) for v in weights(np.asarray(point, float), trend, seasonal))
        at = 1 + (trend != "none")
        self.level, self.slope = float(states[0]), float(states[1]) if trend != "none" else 0.0
        self.season = [*map(float, states[at:]), 0.0] if seasonal else [0.0]
        self.n = 0

    def packed(self) -> tuple[list[int], list[float], list[float], list[float]]:
        """What never changes (gains and damping), and what does (level and slope; seasonal figures, the next one first)."""
        k = self.n % len(self.season)
        return [], list(self.gains), [self.level, self.slope], self.season[k:] + self.season[:k]

    @classmethod
    def of(cls, order: list[int], fixed: list[float], latent: list[float], buffer: list[float]) -> State:
        new = cls.__new__(cls)
        new.gains, (new.level, new.slope), new.season, new.n = tuple(fixed), latent, list(buffer), 0
        return new

    def forecast(self) -> float:
        return self.level + self.gains[3] * self.slope + self.season[self.n % len(self.season)]

    def observe(self, y: float) -> float:
        alpha, beta, gamma, phi = self.gains
        k = self.n % len(self.season)
        e = y - self.forecast()
        self.level, self.slope = self.level + phi * self.slope + alpha * e, phi * self.slope + beta * e
        self.season[k] += gamma * e
        self.n += 1
        return e
