"""First-order Takagi-Sugeno-Kang models with Gaussian antecedents, and the clusterings that start them (NumPy)."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

# Fixed values of the protocol.
ACCEPT, REJECT, SQUASH, RANGE_FLOOR = 0.5, 0.15, 1.25, 1e-3
W_FIT, W_VALIDATION, W_SENSITIVITY, W_COVERAGE = 0.5, 1.0, 0.001, 0.01
COVERAGE_FLOOR, TINY = 1e-4, 1e-300


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


#: Points whose distances are worked out at a time, and the size of a kernel below which a pair counts as nothing. A potential
#: of n points is then short by n times that at most.
BLOCK, NOTHING = 512, 1e-18


def kernel_sums(x: np.ndarray, sharpness: float) -> np.ndarray:
    """For each point the sum of exp(-sharpness * squared distance) over all points, in memory linear in their number.

    Points are put in cells of a grid over the first columns, in the order of the cells. A block of neighbours in that order
    meets only the cells that are near enough for the kernel to count; in many columns few can be ruled out, and blocks then
    meet all points, but never all at a time.
    """
    n, columns = x.shape
    reach = np.sqrt(-np.log(NOTHING) / sharpness)
    grid = min(columns, 3)
    low = x[:, :grid].min(axis=0)
    side = np.maximum(reach / 2, np.ptp(x[:, :grid], axis=0) / 64 + 1e-300)
    cell = np.floor((x[:, :grid] - low) / side).astype(np.int64)
    order = np.lexsort(cell.T[::-1])
    z, cell = x[order], cell[order]
    new = np.concatenate(([True], (cell[1:] != cell[:-1]).any(axis=1)))
    first = np.append(np.flatnonzero(new), n)
    cells = cell[first[:-1]]
    out = np.empty(n)
    for at in range(0, n, BLOCK):
        block = z[at : at + BLOCK]
        down, up = block[:, :grid].min(axis=0) - reach, block[:, :grid].max(axis=0) + reach
        near = np.flatnonzero(((low + (cells + 1) * side >= down) & (low + cells * side <= up)).all(axis=1))
        sums = np.zeros(len(block))
        rows = np.concatenate([np.arange(first[c], first[c + 1]) for c in near])
        for k in range(0, len(rows), 8 * BLOCK):
            some = rows[k : k + 8 * BLOCK]
            sums += np.exp(-sharpness * sum((block[:, None, j] - z[None, some, j]) ** 2 for j in range(columns))).sum(axis=1)
        out[at : at + BLOCK] = sums
    back = np.empty(n)
    back[order] = out
    return back


def subtractive(data: np.ndarray, radius: float, accept: float = ACCEPT, reject: float = REJECT, squash: float = SQUASH, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Chiu's subtractive clustering on unit-scaled columns: indices of the centers and their potentials."""
    low, span = data.min(axis=0), np.ptp(data, axis=0)
    z = (data - low) / np.where(span > 0, span, 1.0)
    potential = kernel_sums(z, 4 / radius**2)
    fade = 4 / (squash * radius) ** 2
    chosen: list[int] = []
    values: list[float] = []
    while most is None or len(chosen) < most:
        i = int(potential.argmax())
        p = float(potential[i])
        if p <= 0:
            break
        if chosen:
            share = p / values[0]
            if share <= reject:
                break
            if share < accept:
                nearest = np.sqrt(((z[chosen] - z[i]) ** 2).sum(axis=1).min())
                if nearest / radius + share < 1:
                    potential[i] = 0.0
                    continue
        chosen.append(i)
        values.append(p)
        potential = np.maximum(0.0, potential - p * np.exp(-fade * ((z - z[i]) ** 2).sum(axis=1)))
    return np.array(chosen, int), np.array(values)


def subtractive_raw(x: np.ndarray, radius: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The variant without scaling: centers, and one width for each from its median distance to the points."""
    density = kernel_sums(x, 1 / (radius / 2) ** 2)
    first, chosen, width = density.max(), [], []
    if first <= 1e-12:
        return x.mean(axis=0, keepdims=True), np.full((1, x.shape[1]), radius / 2)
    while len(chosen) < most:
        i = int(density.argmax())
        if density[i] < REJECT * first:
            break
        chosen.append(i)
        d2 = ((x - x[i]) ** 2).sum(axis=1)
        width.append(max(float(np.median(np.sqrt(d2))) / np.sqrt(2), 0.01))
        density = np.maximum(0.0, density - density[i] * np.exp(-d2 / (1.5 * radius / 2) ** 2))
    return x[chosen], np.repeat(np.array(width)[:, None], x.shape[1], axis=1)


def subtractive_adaptive(x: np.ndarray, radius: float, most: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """The variant on standardised columns with half the radius: ``most`` centers (raw), one width each from raw distances.

    A center is taken as long as any density is left; a density may fall under 0, and the same point may come again.
    """
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1.0)
    sharpness = 1 / (2 * (0.5 * radius) ** 2)
    density, chosen = kernel_sums(z, sharpness), []
    for _ in range(most):
        i = int(density.argmax())
        if density[i] < 0:
            break
        chosen.append(i)
        density = density - density[i] * np.exp(-sharpness / 1.5**2 * ((z - z[i]) ** 2).sum(axis=1))
    center = x[chosen]
    width = np.maximum(0.5 * np.median(np.sqrt(_squared(center, x)), axis=1), 0.01)
    return center, width[:, None]


def cluster_quality(x: np.ndarray, center: np.ndarray, width: np.ndarray) -> float:
    """Minus the weighted distances of the points to the centers, over the distances between centers; 0 for one center."""
    far = np.sqrt(_squared(center, x))
    between = float(np.sqrt(_squared(center, center))[np.triu_indices(len(center), 1)].sum())
    within = float((far * np.exp(-far / (2 * width))).sum())
    return -within / (between + 1e-6) if between >= 1e-6 else 0.0


def dynamic_design(x: np.ndarray, center: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Rows of the linear system of a model: for each rule its share of the firing times (1, x); intercepts come first."""
    far = ((x[:, None, :] - center[None]) / np.maximum(sigma, 1e-3)[None]) ** 2
    fired = np.exp(-0.5 * far.sum(axis=2))
    share = fired / np.maximum(fired.sum(axis=1, keepdims=True), 1e-12)
    ones = np.concatenate((np.ones((len(x), 1)), x), axis=1)
    return (share[:, :, None] * ones[:, None, :]).reshape(len(x), -1)


def fuzzy_c_means(x: np.ndarray, k: int, m: float = 2.0, rounds: int = 100, tolerance: float = 1e-4, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Centers and memberships (n, k)."""
    u = np.random.default_rng(seed).random((len(x), k))
    u /= u.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        w = u**m
        centers = w.T @ x / w.sum(axis=0)[:, None]
        inverse = np.maximum(_squared(x, centers), 1e-20) ** (-1 / (m - 1))
        new = inverse / inverse.sum(axis=1, keepdims=True)
        if np.abs(new - u).max() < tolerance:
            return centers, new
        u = new
    return centers, u


@dataclass(frozen=True)
class Tsk:
    """Rules: centers and widths (R, D), coefficients (R, D + 1) with the intercept last."""

    center: np.ndarray
    sigma: np.ndarray
    coef: np.ndarray

    def log_strength(self, x: np.ndarray) -> np.ndarray:
        return -0.5 * (((x[:, None, :] - self.center[None]) / self.sigma[None]) ** 2).sum(axis=2)

    def weights(self, x: np.ndarray) -> np.ndarray:
        s = self.log_strength(x)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def total_log_strength(self, x: np.ndarray) -> np.ndarray:
        s = self.log_strength(x)
        top = s.max(axis=1)
        return top + np.log(np.exp(s - top[:, None]).sum(axis=1))

    def outputs(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coef[:, :-1].T + self.coef[:, -1]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (self.weights(x) * self.outputs(x)).sum(axis=1)

    def design(self, x: np.ndarray) -> np.ndarray:
        """Rule by rule: the rule's weight times the inputs, then the weight itself."""
        extended = np.concatenate((x, np.ones((len(x), 1))), axis=1)
        return (self.weights(x)[:, :, None] * extended[:, None, :]).reshape(len(x), -1)

    def fit(self, x: np.ndarray, y: np.ndarray, alpha: float) -> Tsk:
        """Ridge solution of the coefficients; intercepts are regularised too."""
        if alpha <= 0:
            raise ValueError("alpha must be positive")
        phi = self.design(x)
        beta = np.linalg.solve(phi.T @ phi + alpha * np.eye(phi.shape[1]), phi.T @ y)
        return replace(self, coef=beta.reshape(self.coef.shape))

    def jacobian(self, x: np.ndarray) -> np.ndarray:
        """Derivative of the prediction by each input (n, D)."""
        w, out = self.weights(x), self.outputs(x)
        slope = -(x[:, None, :] - self.center[None]) / self.sigma[None] ** 2
        mean = (w[:, :, None] * slope).sum(axis=1, keepdims=True)
        return ((w * out)[:, :, None] * (slope - mean)).sum(axis=1) + w @ self.coef[:, :-1]

    def vector(self) -> np.ndarray:
        return np.concatenate((self.center.ravel(), self.sigma.ravel()))

    def with_vector(self, v: np.ndarray) -> Tsk:
        half = len(v) // 2
        return replace(self, center=v[:half].reshape(self.center.shape), sigma=v[half:].reshape(self.sigma.shape))


def bounds(x: np.ndarray, rules: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the antecedent vector: centers 5 % beyond the range, widths from 5 % to all of it."""
    span = np.maximum(np.ptp(x, axis=0), RANGE_FLOOR)
    low = np.concatenate((np.tile(x.min(axis=0) - 0.05 * span, rules), np.tile(0.05 * span, rules)))
    high = np.concatenate((np.tile(x.max(axis=0) + 0.05 * span, rules), np.tile(span, rules)))
    return low, high


def initial(x: np.ndarray, y: np.ndarray, radius: float) -> Tsk:
    """Rules at the cluster centers of the joint data, equal widths by range, coefficients 0, clipped to the bounds."""
    chosen, _ = subtractive(np.column_stack((x, y)), radius)
    span = np.maximum(np.ptp(x, axis=0), RANGE_FLOOR)
    r, d = len(chosen), x.shape[1]
    model = Tsk(x[chosen], np.tile(radius * span / np.sqrt(8), (r, 1)), np.zeros((r, d + 1)))
    return model.with_vector(np.clip(model.vector(), *bounds(x, r)))


def rmse(y: np.ndarray, p: np.ndarray) -> float:
    return float(np.sqrt(np.mean((y - p) ** 2)))


def sensitivity(model: Tsk, x: np.ndarray) -> float:
    return float((model.jacobian(x) ** 2).sum(axis=1).mean())


def low_coverage(model: Tsk, x: np.ndarray) -> float:
    s = np.maximum(model.total_log_strength(x), np.log(TINY))
    return float((np.maximum(0.0, np.log(COVERAGE_FLOOR) - s) ** 2).mean())


def objective(model: Tsk, fit: tuple[np.ndarray, np.ndarray], validation: tuple[np.ndarray, np.ndarray], weights: tuple[float, ...] = (W_FIT, W_VALIDATION, W_SENSITIVITY, W_COVERAGE)) -> float:
    """Weighted sum of fit error, validation error, mean squared Jacobian norm (all rows) and low coverage (validation)."""
    parts = (rmse(fit[1], model.predict(fit[0])), rmse(validation[1], model.predict(validation[0])), sensitivity(model, np.concatenate((fit[0], validation[0]))), low_coverage(model, validation[0]))
    return float(sum(w * p for w, p in zip(weights, parts, strict=True)))
