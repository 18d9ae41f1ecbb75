"""Synthetic panels: the same values as series made one by one, dealt over tasks by the number of series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import generators
from tidemark.operators import synthetic
from tidemark.plans.registry import QUERIES

SPREAD = [
    "O09_lorenz63",
    "O15_regime_any_length",
    "O19_panel",
    "O14_sine_any_length",
    "O13_ar_any_length",
    "O11_noise_bundle",
    "O16_spiky_any_length",
    "O18_short_any_length",
    "O17_seasonal_any_length",
]


@pytest.fixture(scope="module")
def suppliers(spark, tmp_path_factory):
    """1,024 suppliers in one small file, and 16 shuffle partitions."""
    d = str(tmp_path_factory.mktemp("suppliers"))
    spark.range(1024).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{d}/supplier.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield d
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", SPREAD)
def test_no_task_holds_many_of_the_series(spark, suppliers, name):
    rows = [r["count"] for r in QUERIES[name](spark, suppliers).groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) == 16 and max(rows) < 0.12 * sum(rows)


@pytest.mark.parametrize("name", ["O19_panel", "O14_sine_any_length", "O13_ar_any_length", "O16_spiky_any_length", "O18_short_any_length"])
def test_tasks_grow_in_number_and_not_in_size(spark, suppliers, monkeypatch, name):
    """Beyond the shuffle partitions too: a task keeps to about as many values, however many series there are."""
    monkeypatch.setattr(synthetic, "TASK", 4096)
    rows = [r["count"] for r in QUERIES[name](spark, suppliers).groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) > 16 and max(rows) < 3 * synthetic.TASK


def _one(name, rng, n):
    """A series by itself, value after value."""
    if name == "lorenz63":
        s = np.array([rng.uniform(-15.0, 15.0), rng.uniform(-20.0, 20.0), rng.uniform(5.0, 35.0)])

        def rate(p):
            return np.array([10.0 * (p[1] - p[0]), p[0] * (28.0 - p[2]) - p[1], p[0] * p[1] - (8.0 / 3.0) * p[2]])

        out = []
        for k in range(5000 + 10 * (n - 1) + 1):
            if k >= 5000 and k % 10 == 0:
                out.append(s[0])
            a = rate(s)
            b = rate(s + 0.5 * 0.01 * a)
            c = rate(s + 0.5 * 0.01 * b)
            s = s + (0.01 / 6.0) * (a + 2.0 * b + 2.0 * c + rate(s + 0.01 * c))
        return np.array(out)
    if name == "henon_map":
        while True:
            x, y = float(rng.uniform(-0.5, 0.5)), float(rng.uniform(-0.5, 0.5))
            out = []
            for _ in range(1000 + n):
                out.append(x)
                x, y = 1.0 - 1.4 * x * x + y, 0.3 * x
                if not abs(x) <= 1e6 or not abs(y) <= 1e6:
                    break
            else:
                return np.array(out[1000:])
    e = rng.normal(size=n)
    y = [float(v) for v in e]
    for t in range(1, n):
        if name == "linear_ar":
            y[t] = 0.7 * y[t - 1] + y[t]
        elif name == "regime_switching":
            y[t] = 0.03 * t + 0.75 * y[t - 1] + 0.8 * y[t] if t < round(n * 0.55) else -0.01 * t + 0.25 * y[t - 1] + 1.8 * y[t]
        elif name == "short_memory" and t > 1:
            y[t] += 0.30 * y[t - 1] - 0.15 * y[t - 2]
    return np.array(y)


@pytest.mark.parametrize("name", ["linear_ar", "regime_switching", "short_memory", "henon_map", "lorenz63"])
def test_series_made_together_are_those_made_one_by_one(name):
    seeds = range(12)
    got = generators.clean_many(name, seeds, 40)
    assert (got == np.stack([_one(name, np.random.default_rng(seed), 40) for seed in seeds])).all()


def test_panel_in_small_batches_is_the_same(spark, monkeypatch):
    """Batches of two series, made five at a time, many to a task; a repeated row gives its series again."""
    factors = spark.createDataFrame([(g, s, v) for g in ("spiky", "seasonal", "ar") for s in (3, 4, 5, 5) for v in (0.0, 0.1)], "generator string, seed int, noise_level double")

    def rows():
        return sorted(tuple(r) for r in synthetic.panel(factors, 30).collect())

    got = rows()
    want = []
    for g, s, v in (tuple(r) for r in factors.collect()):
        clean, y = generators.clean(g, s, 30), generators.observed(g, s, v, 30)
        want += [(f"{g}_n30_noise{v:g}_seed{s}", g, s, v, t, clean[t], y[t]) for t in range(30)]
    assert got == sorted(want)
    monkeypatch.setattr(synthetic, "TOGETHER", 150)
    monkeypatch.setattr(synthetic, "BATCH", 60)
    parts = [p.num_rows for p in _batches(factors, 30)]
    assert max(parts) == 60 and sum(parts) == len(want)
    assert synthetic.panel(factors.limit(0), 30).count() == 0


def _batches(factors, length):
    """The Arrow batches that one task hands on."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pandas(factors.toPandas())
    for part, clean in synthetic._together(iter([batch]), length):
        assert clean.size <= synthetic.TOGETHER
        for _, series, _ in synthetic._handed(part, length):
            yield pa.RecordBatch.from_pydict({"series": series})


def test_bundles_hold_the_levels_of_each_series(spark, tmp_path):
    """As by grouping the panel; a supplier that repeats is one series."""
    spark.createDataFrame([(3,), (4,), (4,)], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r["seed"], r["t"]): (r["high"], r["low"]) for r in QUERIES["O11_noise_bundle"](spark, str(tmp_path)).collect()}
    want = {}
    for seed in (3, 4):
        clean = generators.clean("linear_ar", seed)
        shares = [np.abs((generators.observed("linear_ar", seed, level) - clean) / level) for level in (0.05, 0.1, 0.2)]
        want |= {(seed, t): (max(s[t] for s in shares), min(s[t] for s in shares)) for t in range(len(clean))}
    assert got == want
