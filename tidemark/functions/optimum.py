"""Bounded quasi-Newton search for many problems at a time (NumPy).

The function takes all points at once, so that differences for the gradient and the steps of a line search are one call. A
variable whose bounds are equal is fixed; problems of different size share a vector that way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Step lengths that a line search tries together, and the decrease that counts (fraction of what the slope promises).
STEPS = 2.0 ** -np.arange(0, 20, 2)
ENOUGH = 1e-4
DELTA = 1e-5


def gradient(f: Callable, which: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Central differences, one-sided at a bound; 0 for fixed variables."""
    b, n = x.shape
    up, down = np.repeat(x[:, None, :], n, 1), np.repeat(x[:, None, :], n, 1)
    k = np.arange(n)
    up[:, k, k] = np.minimum(x + DELTA, high)
    down[:, k, k] = np.maximum(x - DELTA, low)
    width = up[:, k, k] - down[:, k, k]
    free = np.flatnonzero((width > 0).any(0))
    out = np.zeros((b, n))
    values = f(which, np.concatenate((up[:, free], down[:, free]), 1))
    difference = values[:, : len(free)] - values[:, len(free) :]
    out[:, free] = np.divide(difference, width[:, free], out=np.zeros_like(difference), where=width[:, free] > 0)
    return out


def slack(x: np.ndarray, g: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest step that steepest descent of length 1 could make within the bounds: 0 at an optimum."""
    return np.abs(np.clip(x - g, low, high) - x).max(-1)


def minimise(f: Callable, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 100, tolerance: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Optimum, value and whether it was reached, for each problem.

    f(which, points): values of problems ``which`` at points (problems x points x variables); start, low and high: a row for
    each problem. Reached means that the gradient is near zero but for variables on a bound that it pushes against.
    """
    x = np.clip(np.array(start, float), low, high)
    b, n = x.shape
    value = f(np.arange(b), x[:, None, :])[:, 0]
    reached = np.zeros(b, bool)
    bend = np.repeat(np.eye(n)[None], b, 0)
    g = gradient(f, np.arange(b), x, low, high)
    plain = np.ones(b, bool)  # no curvature is known yet
    active = np.arange(b)
    for _ in range(rounds):
        done = slack(x[active], g[active], low[active], high[active]) <= tolerance
        reached[active[done]] = True
        active = active[~done & np.isfinite(value[active])]
        if not len(active):
            break
        xa, ga, lo, hi = x[active], g[active], low[active], high[active]
        free = ~(((xa <= lo) & (ga >= 0)) | ((xa >= hi) & (ga <= 0)))
        downhill = np.where(free, -ga, 0.0)
        move = np.linalg.solve(np.where(free[:, :, None] & free[:, None, :], bend[active], np.eye(n)), downhill[:, :, None])[:, :, 0]
        uphill = (move * ga).sum(1) >= 0
        move[uphill] = downhill[uphill]
        points = np.clip(xa[:, None, :] + STEPS[None, :, None] * move[:, None, :], lo[:, None, :], hi[:, None, :])
        tried = f(active, points)
        promised = ((points - xa[:, None, :]) * ga[:, None, :]).sum(2)
        good = np.isfinite(tried) & (tried < value[active][:, None] + ENOUGH * promised)
        moves, step = good.any(1), good.argmax(1)
        # Where no step is good enough, the curvature is forgotten; where there was none, the search ends.
        stuck = active[~moves]
        ended = stuck[plain[stuck]]
        bend[stuck], plain[stuck] = np.eye(n), True
        rows = np.flatnonzero(moves)
        if len(rows):
            moved = active[rows]
            new = points[rows, step[rows]]
            value[moved] = tried[rows, step[rows]]
            old, x[moved] = x[moved], new
            old_g, g[moved] = g[moved], gradient(f, moved, new, low[moved], high[moved])
            _bend(bend, moved, new - old, g[moved] - old_g)
            plain[moved] = False
        active = np.setdiff1d(active, ended)
    return x, value, reached | (slack(x, g, low, high) <= 10 * tolerance)


def _bend(bend: np.ndarray, which: np.ndarray, s: np.ndarray, y: np.ndarray) -> None:
    """Damped update of the second derivatives, which stay positive."""
    m = bend[which]
    ms = np.einsum("bij,bj->bi", m, s)
    sms = (s * ms).sum(1)
    sy = (s * y).sum(1)
    share = np.where(sy < 0.2 * sms, 0.8 * sms / np.where(sms - sy == 0, 1, sms - sy), 1.0)
    y = share[:, None] * y + (1 - share)[:, None] * ms
    sy = (s * y).sum(1)
    some = (sms > 1e-300) & (sy > 1e-300)
    w = which[some]
    bend[w] += y[some, :, None] * y[some, None, :] / sy[some, None, None] - ms[some, :, None] * ms[some, None, :] / sms[some, None, None]
