"""Synthetic series with seeded generators. Order of draws and of arithmetic are part of the definition."""

from __future__ import annotations

import numpy as np

LENGTH = 180
# Seasonal periods, offsets of the noise seeds, least noise scales.
PERIODS = {"nonlinear_sine": 24, "noisy_seasonal": 12}
NOISE_SEEDS = {"linear_ar": 1000, "nonlinear_sine": 2000, "regime_switching": 3000, "spiky_outbreak": 4000, "noisy_seasonal": 5000, "short_memory": 6000, "logistic_map": 7000, "henon_map": 8000, "lorenz63": 9000}
LEAST_SCALES = {"spiky_outbreak": 5.0, "noisy_seasonal": 2.0}


def _normal(rngs, n: int) -> np.ndarray:
    return np.stack([rng.normal(size=n) for rng in rngs], axis=1)


# A generator takes the random generators of any number of series and gives a row a step, a column a series: each step is taken
# for all series at once, with each series' own draws and arithmetic.


def linear_ar(rngs, n: int = LENGTH, phi: float = 0.7, constant: float = 0.0) -> np.ndarray:
    e = _normal(rngs, n)
    y = e.copy()
    for t in range(1, n):
        y[t] = constant + phi * y[t - 1] + e[t]
    return y


def nonlinear_sine(rngs, n: int = LENGTH, amplitude: float = 10.0, period: int = 24) -> np.ndarray:
    t = np.arange(n, dtype=float)
    s = np.sin(2.0 * np.pi * t / period)
    y = amplitude * s + 0.35 * amplitude * s * s + 0.03 * t
    return np.repeat(y[:, None], len(rngs), axis=1)


def regime_switching(rngs, n: int = LENGTH) -> np.ndarray:
    switch = round(n * 0.55)
    e = _normal(rngs, n)
    y = e.copy()
    for t in range(1, n):
        phi, sd, step = (0.75, 0.8, 0.03) if t < switch else (0.25, 1.8, -0.01)
        y[t] = step * t + phi * y[t - 1] + sd * e[t]
    return y


def spiky_outbreak(rngs, n: int = LENGTH) -> np.ndarray:
    t = np.arange(n, dtype=float)
    base, places = 20.0 + 0.05 * t, np.arange(10, n - 10)

    def one(rng) -> np.ndarray:
        y = base + rng.normal(size=n)
        for place in rng.choice(places, size=5, replace=False):
            height, width = rng.uniform(20.0, 70.0), rng.uniform(1.5, 5.0)
            y += height * np.exp(-0.5 * ((t - place) / width) ** 2)
        return y

    return np.maximum(np.stack([one(rng) for rng in rngs], axis=1), 0.0)


def noisy_seasonal(rngs, n: int = LENGTH, period: int = 12) -> np.ndarray:
    t = np.arange(n, dtype=float)
    y = 50.0 + 0.04 * t + 8.0 * np.sin(2.0 * np.pi * t / period) + 2.8 * np.cos(4.0 * np.pi * t / period)
    return np.repeat(y[:, None], len(rngs), axis=1)


def short_memory(rngs, n: int = LENGTH) -> np.ndarray:
    y = _normal(rngs, n)
    for t in range(2, n):
        y[t] += 0.30 * y[t - 1] - 0.15 * y[t - 2]
    return y


def logistic_orbit(x: float | np.ndarray, n: int = LENGTH) -> np.ndarray:
    """The logistic map from a given start (or each of several), without its first 500 values."""
    out = []
    for t in range(500 + n):
        if t >= 500:
            out.append(x)
        x = 4.0 * x * (1.0 - x)
    return np.array(out)


def logistic_map(rngs, n: int = LENGTH) -> np.ndarray:
    return logistic_orbit(np.array([rng.uniform(0.1, 0.9) for rng in rngs]), n)


def henon_starts(rngs, steps: int = 1000 + LENGTH - 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each random generator the first start, of those drawn, from which the map stays within 1e6; and its number."""
    start, number = np.empty((2, len(rngs))), np.zeros(len(rngs), int)
    left = np.arange(len(rngs))
    for attempt in range(1, 10_001):
        for i in left:
            start[0, i], start[1, i] = rngs[i].uniform(-0.5, 0.5), rngs[i].uniform(-0.5, 0.5)
        x, y = start[:, left]
        bounded = np.ones(len(left), bool)
        with np.errstate(over="ignore", invalid="ignore"):  # those that left the bound go on to infinity
            for _ in range(steps):
                x, y = 1.0 - 1.4 * x * x + y, 0.3 * x
                bounded &= (np.abs(x) <= 1e6) & (np.abs(y) <= 1e6)
        number[left[bounded]] = attempt
        left = left[~bounded]
        if not len(left):
            return start[0], start[1], number
    raise RuntimeError("no start stays bounded")


def henon_start(rng, steps: int = 1000 + LENGTH - 1) -> tuple[float, float, int]:
    x, y, number = henon_starts([rng], steps)
    return float(x[0]), float(y[0]), int(number[0])


def henon_map(rngs, n: int = LENGTH) -> np.ndarray:
    x, y, _ = henon_starts(rngs, 1000 + n - 1)
    out = []
    for t in range(1000 + n):
        if t >= 1000:
            out.append(x)
        x, y = 1.0 - 1.4 * x * x + y, 0.3 * x
    return np.array(out)


def lorenz63(rngs, n: int = LENGTH, dt: float = 0.01) -> np.ndarray:
    s = np.array([[rng.uniform(-15.0, 15.0), rng.uniform(-20.0, 20.0), rng.uniform(5.0, 35.0)] for rng in rngs]).T.copy()

    def rate(p: np.ndarray) -> np.ndarray:
        x, y, z = p
        return np.array([10.0 * (y - x), x * (28.0 - z) - y, x * y - (8.0 / 3.0) * z])

    def step(p: np.ndarray) -> np.ndarray:
        a = rate(p)
        b = rate(p + 0.5 * dt * a)
        c = rate(p + 0.5 * dt * b)
        return p + (dt / 6.0) * (a + 2.0 * b + 2.0 * c + rate(p + dt * c))

    for _ in range(5000):
        s = step(s)
    out = [s[0]]
    while len(out) < n:
        for _ in range(10):
            s = step(s)
        out.append(s[0])
    return np.array(out)


GENERATORS = {f.__name__: f for f in (linear_ar, nonlinear_sine, regime_switching, spiky_outbreak, noisy_seasonal, short_memory, logistic_map, henon_map, lorenz63)}
ALIASES = {"ar": "linear_ar", "sine": "nonlinear_sine", "regime": "regime_switching", "spiky": "spiky_outbreak", "seasonal": "noisy_seasonal", "short": "short_memory"}


def clean_many(name: str, seeds, n: int = LENGTH) -> np.ndarray:
    """A row for each seed (one at least): its clean series."""
    rngs = [np.random.default_rng(int(seed)) for seed in seeds]
    return np.ascontiguousarray(GENERATORS[ALIASES.get(name, name)](rngs, n=n).T)


def clean(name: str, seed: int, n: int = LENGTH) -> np.ndarray:
    return clean_many(name, [seed], n)[0]


def with_noise(y: np.ndarray, level: float, seed: int, least: float = 1.0) -> np.ndarray:
    """Normal noise of ``level`` times the series' own (population) standard deviation, ``least`` at least."""
    return y + level * max(float(np.std(y)), least) * np.random.default_rng(seed).normal(size=len(y)) if level > 0 else y.copy()


def observed_many(name: str, clean: np.ndarray, seeds, levels) -> np.ndarray:
    """Clean series (rows), each with noise drawn from its own seed; outbreaks stay at 0 or more."""
    name = ALIASES.get(name, name)
    least = LEAST_SCALES.get(name, 1.0)
    y = np.stack([with_noise(row, level, int(seed) + NOISE_SEEDS[name], least) for row, seed, level in zip(clean, seeds, levels)])
    return np.maximum(y, 0.0) if name == "spiky_outbreak" else y


def observed(name: str, seed: int, level: float, n: int = LENGTH) -> np.ndarray:
    return observed_many(name, clean_many(name, [seed], n), [seed], [level])[0]
