"""Operators for tall groups against NumPy and brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import fuzzy
from tidemark.operators import inference, tall


def test_ridge_of_ten_million_rows(spark):
    """A group with nine tenths of ten million rows; the same rows in NumPy, in blocks."""
    n = 10_000_000
    df = spark.range(n, numPartitions=8).select((F.when(F.col("id") % 10 == 0, F.col("id") % 30).otherwise(7)).alias("g"), *((F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0).alias(f"x{k}") for k in range(3)))
    df = df.select("g", F.array("x0", "x1", "x2", F.lit(1.0)).alias("x"), (F.col("x0") * 2 - F.col("x1") + F.pow(F.col("x2"), 2) + F.col("g") / 10).alias("y"))
    got = {r["g"]: r for r in tall.ridge(df, ["g"], "x", "y", 0.05).collect()}
    assert sum(r["n"] for r in got.values()) == n and got[7]["n"] == n * 9 // 10
    some = df.filter("g = 10").toPandas()
    x, y = np.stack(some["x"].to_numpy()), some["y"].to_numpy()
    want = np.linalg.solve(x.T @ x + 0.05 * np.eye(4), x.T @ y)
    assert np.allclose(got[10]["coef"], want, rtol=1e-9) and got[10]["sse"] == pytest.approx(((y - x @ want) ** 2).sum(), rel=1e-6)
    sums = df.filter("g = 7").agg(*(F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"s{i}{j}") for i in range(4) for j in range(4)), *(F.sum(F.col("x")[i] * F.col("y")).alias(f"t{i}") for i in range(4))).first()
    g = np.array([[sums[f"s{i}{j}"] for j in range(4)] for i in range(4)])
    assert np.allclose(got[7]["coef"], np.linalg.solve(g + 0.05 * np.eye(4), [sums[f"t{i}"] for i in range(4)]), rtol=1e-9)


def test_ridge_equals_the_solver_of_one_series(spark):
    """Consequents of rules: the same coefficients as the kernel that holds all rows (widths differ by group)."""
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for g, k in (("a", 3), (None, 2)):
        x, y = rng.random((80, k)), rng.random(80)
        model = fuzzy.design(x, x[:2], np.full((2, k), 0.3)) if hasattr(fuzzy, "design") else np.column_stack((x, np.ones(80)))
        want[g] = np.linalg.solve(model.T @ model + 0.1 * np.eye(model.shape[1]), model.T @ y)
        rows += [(g, r.tolist(), float(v), 1) for r, v in zip(model, y, strict=True)]
    rows += [("a", None, 1.0, 1), ("a", [1.0], None, 1), ("a", [float("nan")], 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, x array<double>, y double, n int").repartition(7)
    got = {r["g"]: r["coef"] for r in tall.ridge(df, ["g"], "x", "y", 0.1).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[g], want[g], rtol=1e-8) for g in want)
    whole = tall.ridge(df.filter("g = 'a'"), [], "x", "y", 0.1).first()
    assert np.allclose(whole["coef"], want["a"]) and whole["n"] == 80
    assert tall.ridge(df.limit(0), ["g"], "x", "y", 0.1).count() == 0


def test_order_statistics_of_ten_million_rows(spark):
    n = 10_000_000
    df = spark.range(n, numPartitions=8).select(F.exp(F.pmod(F.col("id") * 7919, F.lit(n)) / 1e6).alias("v"))
    r = tall.order_statistics(df, [], "v", {"a": F.lit(1), "b": F.lit(1234567), "c": F.col("n")} | tall.median_ranks(F.col("n"))).first()
    at = lambda k: np.exp((k - 1) / 1e6)
    assert r["n"] == n and [r["a"], r["b"], r["c"], r["lower_median"], r["upper_median"]] == pytest.approx([at(1), at(1234567), at(n), at(n // 2), at(n // 2 + 1)], rel=1e-14)


def test_order_statistics_of_awkward_groups(spark):
    rng = np.random.default_rng(1)
    groups = {"one": [5.0], "ties": [2.0] * 50, "two": [1.0, 1.0 + 1e-16, 3.0], "wide": [-1e308, 1e308, 0.0, 5e-324, -5e-324], "random": list(rng.normal(size=999)), "heavy": list(np.exp(rng.normal(size=500) * 40)), None: [1.0, 9.0]}
    rows = [(g, float(v), 3) for g, vs in groups.items() for v in vs] + [("one", None, 1), ("one", float("nan"), 1), ("none", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, n int").repartition(5).drop("n")
    ranks = {"first": F.lit(1), "third": F.lit(3), "last": F.col("n"), **tall.median_ranks(F.col("n"))}
    got = {r["g"]: r for r in tall.order_statistics(df, ["g"], "v", ranks).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        s, r = sorted(vs), got[g]
        assert r["n"] == len(s) and r["first"] == s[0] and r["last"] == s[-1] and r["third"] == (s[2] if len(s) > 2 else None)
        assert (r["lower_median"] + r["upper_median"]) / 2 == pytest.approx(np.median(s))


def test_rank_of_the_median_interval():
    from math import comb

    for n in [*range(1, 60), 500, 1001]:
        k = inference.median_interval_rank(n)
        tail = lambda k, n=n: 2 * sum(comb(n, i) for i in range(k)) / 2**n
        assert tail(k) <= 0.05 < tail(k + 1)
    n = 10_000_000
    assert abs(inference.median_interval_rank(n) - (n / 2 - 1.959964 * np.sqrt(n) / 2)) < 2


def test_diameters(spark):
    rng = np.random.default_rng(3)
    t = np.linspace(0, 2 * np.pi, 400)
    groups = {"random": rng.normal(size=(3000, 2)), "line": np.stack((np.arange(700.0), 2 * np.arange(700.0)), 1), "upright": np.stack((np.zeros(300), rng.random(300)), 1), "circle": np.stack((np.cos(t), np.sin(t)), 1), "one": np.array([[3.0, 4.0]]), "same": np.ones((40, 2)), "far": rng.normal(size=(500, 2)) * 1e-6 + 1e6}
    rows = [(g, float(a), float(b)) for g, p in groups.items() for a, b in p] + [("one", None, 1.0), (None, 0.0, 0.0), (None, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(6)
    got = {r["g"]: r["diameter"] for r in tall.diameter(df, ["g"], "x", "y").collect()}
    for g, p in groups.items():
        assert got[g] == pytest.approx(np.sqrt(((p[:, None] - p[None]) ** 2).sum(2).max()), rel=1e-12), g
    assert got[None] == 5.0 and len(got) == len(groups) + 1


def test_diameter_of_a_million_points(spark):
    df = spark.range(1_000_000, numPartitions=8).select(*((F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1_000_003)) / 1000.0).alias(c) for k, c in enumerate("xy")))
    p = df.toPandas().to_numpy()
    corners = pd.DataFrame(p).iloc[np.unique([(p @ [np.cos(a), np.sin(a)]).argmax() for a in np.linspace(0, 2 * np.pi, 2000)])].to_numpy()
    want = np.sqrt(((corners[:, None] - corners[None]) ** 2).sum(2).max())
    assert tall.diameter(df, [], "x", "y").first()[0] == pytest.approx(want, rel=1e-12)
