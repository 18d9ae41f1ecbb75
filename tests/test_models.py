"""Numerical kernels: golden values, formulas, leakage, streams against batches."""

import numpy as np
import pytest

from tidemark.functions import forecasters, fuzzy, generators, neurofuzzy, swarm
from tidemark.operators import inference


def test_golden_generators():
    assert generators.clean("logistic_map", 1001)[:2].tolist() == [0.09794285907028949, 0.3534002217097076]
    assert generators.clean("henon_map", 1001)[:2].tolist() == [0.42571744856521265, 0.5052617439120684]
    assert generators.clean("lorenz63", 1001)[:2].tolist() == [13.762481521700717, 11.170882547675332]
    assert generators.henon_start(np.random.default_rng(1))[2] == 3


@pytest.mark.parametrize("name", sorted(generators.GENERATORS))
def test_generators_are_finite_and_reproducible(name):
    a, b = generators.observed(name, 1001, 0.1), generators.observed(name, 1001, 0.1)
    assert len(a) == 180 and np.isfinite(a).all() and (a == b).all()
    assert (generators.with_noise(a, 0.0, 1) == a).all()


def test_constriction():
    assert swarm.constriction() == pytest.approx(0.7298437881283576, abs=1e-15)
    assert swarm.constriction() * 2.05 == pytest.approx(1.496179765663133, abs=1e-15)
    with pytest.raises(ValueError):
        swarm.constriction(2.0, 2.0)


def test_jacobian_is_the_derivative():
    rng = np.random.default_rng(0)
    model = fuzzy.Tsk(rng.random((4, 3)), 0.2 + rng.random((4, 3)), rng.random((4, 4)))
    x, h = rng.random((6, 3)), 1e-6
    numeric = np.stack([(model.predict(x + h * e) - model.predict(x - h * e)) / (2 * h) for e in np.eye(3)], axis=1)
    assert np.abs(model.jacobian(x) - numeric).max() < 1e-7
    assert np.allclose(model.design(x) @ model.coef.ravel(), model.predict(x))
    assert np.allclose(model.weights(x).sum(axis=1), 1)


def test_ridge_solves_its_system():
    rng = np.random.default_rng(1)
    x, y = rng.random((30, 2)), rng.random(30)
    model = fuzzy.Tsk(rng.random((2, 2)), np.full((2, 2), 0.5), np.zeros((2, 3))).fit(x, y, 0.1)
    phi = model.design(x)
    assert np.allclose((phi.T @ phi + 0.1 * np.eye(6)) @ model.coef.ravel(), phi.T @ y)
    with pytest.raises(ValueError):
        model.fit(x, y, 0.0)


def test_clusters_of_separated_points():
    rng = np.random.default_rng(2)
    x = np.concatenate([c + 0.01 * rng.normal(size=(20, 2)) for c in ([0, 0], [1, 1], [0, 1])])
    chosen, potential = fuzzy.subtractive(x, 0.5)
    assert len(chosen) == 3 and (np.diff(potential) <= 0).all()
    assert sorted((chosen // 20).tolist()) == [0, 1, 2]


@pytest.mark.parametrize("dynamics", ["constricted", "nonconstricted"])
@pytest.mark.parametrize("boundary", ["project", "feasible_rejection"])
def test_swarm_stays_in_the_box_and_improves(dynamics, boundary):
    low, high, seen = np.full(3, -1.0), np.full(3, 2.0), []

    def cost(v):
        seen.append(v.copy())
        return float(((v - 0.5) ** 2).sum())

    best, value, history = swarm.minimise(cost, np.full(3, 1.5), low, high, seed=3, dynamics=dynamics, boundary=boundary)
    assert value <= 3.0 and len(history) == 40
    assert all(((v >= low) & (v <= high)).all() for v in seen)
    assert (np.diff([h["best_cost"] for h in history]) <= 0).all()
    again = swarm.minimise(cost, np.full(3, 1.5), low, high, seed=3, dynamics=dynamics, boundary=boundary)
    assert (again[0] == best).all()


def test_preparation_ignores_what_comes_later():
    y = generators.observed("noisy_seasonal", 1001, 0.1)
    a = neurofuzzy.prepare(y[:144], 12)
    changed = y[:144].copy()
    changed[-20:] *= 5
    b = neurofuzzy.prepare(changed, 12)
    assert (a[0][0] == b[0][0]).all() and a[2:] == b[2:]
    assert len(a[1][1]) == 26 and len(neurofuzzy.prepare(y[:144], 5)[1][1]) == 27


def test_first_forecast_ignores_the_future():
    y = generators.observed("noisy_seasonal", 1001, 0.1)
    fitted = neurofuzzy.fit(y[:144], 12, rounds=3)
    other = y[144:].copy()
    other[1:] = 0
    assert fitted.forecast(y[144:])[0] == fitted.forecast(other)[0]


@pytest.mark.parametrize("method", ["naive_1", "seasonal_naive", "drift", "theta", "ets", "sarima", "ridge"])
def test_forecasters_see_only_the_past(method):
    y = generators.observed("noisy_seasonal", 1002, 0.05)
    a, status, failure = forecasters.run(method, y[:144], y[144:], 12)
    other = y[144:].copy()
    other[10:] += 100
    b, *_ = forecasters.run(method, y[:144], other, 12)
    assert status == "success" and failure is None and (a[:11] == b[:11]).all()


def test_sarima_searches_all_candidates():
    y = generators.observed("noisy_seasonal", 1002, 0.05)[:63]
    got = forecasters.METHODS["sarima"](y, 12)
    assert got.order == forecasters.Sarima(y, 12, forecasters.sarima_candidates(12)).order and sum(got.order[3:]) > 0
    assert forecasters.METHODS["arima_110"](y, 12).order == (1, 1, 0, 0, 0, 0)


def test_sarima_queries_and_baselines_are_whole(spark):
    from oracle import TINY

    from tidemark.plans import design
    from tidemark.plans.registry import QUERIES

    assert {r["method"] for r in QUERIES["M22_all_baselines"](spark, TINY).select("method").distinct().collect()} == set(design.BASELINES)
    assert {r["method"] for r in QUERIES["M02_rolling_arima"](spark, TINY).select("method").distinct().collect()} == {"arima_110"}
    assert len(QUERIES["N10_sarima_choice"](spark, TINY).collect()) == len(QUERIES["M15_sarima"](spark, TINY).collect()) == 5


def test_failures_are_named_not_filled():
    p, status, failure = forecasters.run("seasonal_naive", np.arange(20.0), np.arange(3.0), 1)
    assert status == "failed" and failure.startswith("fit") and np.isnan(p).all()


def test_distributions():
    assert inference.chi_square_p(5.991464547107979, 2) == pytest.approx(0.05)
    assert inference.chi_square_p(2.0, 2) == pytest.approx(np.exp(-1))
    assert inference.sign_test_p(8, 2) == pytest.approx(0.109375)
    assert inference.wilcoxon_p(0.0, 5, 0) == pytest.approx(0.0625)
    assert inference.wilcoxon_p(0.0, 5, 0, "less") == pytest.approx(0.03125)
    assert inference.median_interval_rank(30) == 10


def test_metrics_by_hand(spark):
    from tidemark.operators import metrics

    df = spark.createDataFrame([("a", 13.0, 12.0, 2.5, 7.5), ("a", 17.0, 20.0, 2.5, 7.5), ("z", 0.0, 0.0, 1.0, 1.0), ("z", 2.0, 1.0, 1.0, 1.0), ("c", 1.0, 1.0, 0.0, 0.0)], "k string, actual double, predicted double, scale double, scale_sq double")
    got = {r["k"]: r for r in metrics.final(df, "k").collect()}
    assert got["a"]["mae"] == 2 and got["a"]["rmse"] == pytest.approx(5**0.5) and got["a"]["mase"] == pytest.approx(0.8)
    assert got["a"]["rmsse"] == pytest.approx((5 / 7.5) ** 0.5) and got["a"]["smape"] == pytest.approx(100 * (1 / 25 + 3 / 37))
    assert got["z"]["smape"] == pytest.approx(100 / 3)
    assert got["c"]["status"] == "failed" and got["c"]["mase"] is None


def test_run_ids_of_all_tasks(spark):
    from oracle import TINY

    from tidemark.plans.registry import QUERIES

    got = QUERIES["I11_run_id"](spark, TINY)
    assert got.count() == got.select("run_id").distinct().count() == 28350


def test_design_sizes(spark):
    from tidemark.plans import design

    assert design.development_tasks(spark).select("run_id").distinct().count() == 28_350
    assert design.final_tasks(spark).select("run_id").distinct().count() == 7_140
    real = spark.createDataFrame([("M3", f, f"s{i}", m) for f, m in (("Yearly", 1), ("Quarterly", 4), ("Monthly", 12)) for i in range(40)], "source string, frequency string, series_id string, seasonal_period int")
    assert design.final_tasks(spark, real).count() == 8_780


def test_ties_in_selection(spark):
    from tidemark.operators.selection import best_pair
    from tidemark.plans.design import candidate_grid
    from pyspark.sql import functions as F

    row = best_pair(candidate_grid(spark).withColumn("statistic", F.lit(1.0))).first()
    assert (row["radius"], row["alpha"]) == (1.0, 0.1)


def test_stream_equals_batch(spark):
    from tidemark.streaming.run import over

    y = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    series = spark.createDataFrame([("s", t, v) for t, v in enumerate(y)], "series_id string, t bigint, y double")
    got = [tuple(r) for r in over(series, 3).orderBy("t").collect()]
    level = None
    for t, (_, at, actual, naive, seasonal, drift, ses) in enumerate(got):
        assert (at, actual) == (t, y[t])
        assert naive == (y[t - 1] if t else None) and ses == level
        assert seasonal == (y[t - 3] if t >= 3 else None)
        assert drift == (pytest.approx(y[t - 1] + (y[t - 1] - y[0]) / max(t - 1, 1)) if t else None)
        level = actual if level is None else level + 0.3 * (actual - level)


def test_stream_of_many_series_and_late_values(spark):
    """More series than files, in many small batches: equal to a plain loop; a value that repeats a time gives no row."""
    from tidemark.streaming.run import over

    rows = [(f"s{k}", t, float((k * 7 + t * t) % 11)) for k in range(23) for t in range(k % 6 + 1)]
    series = spark.createDataFrame([*rows, ("s1", 1, 99.0)], "series_id string, t bigint, y double").orderBy("series_id", "t", "y")
    got = {(r["series_id"], r["t"]): r for r in over(series, 2, steps=4).collect()}
    assert sorted(got) == sorted((s, t) for s, t, _ in rows)
    of = {(s, t): y for s, t, y in rows}
    for (s, t), r in got.items():
        assert r["actual"] == of[s, t] and r["naive_1"] == of.get((s, t - 1)) and r["seasonal_naive"] == of.get((s, t - 2))
    empty = spark.createDataFrame([], "series_id string, t bigint, y double")
    assert over(empty, 2).collect() == []


def test_files(spark, tmp_path):
    from tidemark.sources import files

    good = spark.createDataFrame([("2020-01-01", "1.5"), ("2020-02-01", "2")], "date string, value string")
    assert files.validated(good, "date", "value").count() == 2
    for bad in ([("2020-01-01", "x")], [("2020-01-01", "1"), ("2020-01-01", "2")], [("no", "1")]):
        with pytest.raises(ValueError):
            files.validated(spark.createDataFrame(bad, "date string, value string"), "date", "value")
    files.write_once(good, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_once(good, str(tmp_path / "out"))
    wide = spark.createDataFrame([("a", "1", None, "3")], "id string, v1 string, v2 string, v3 string")
    assert [(r["t"], r["y"]) for r in files.narrow(wide, "id").orderBy("t").collect()] == [(0, 1.0), (2, 3.0)]


def test_svr_meets_the_optimality_conditions():
    """Of the dual with the bias in the kernel: inside the tube 0, on its border between, outside at the bound."""
    rng = np.random.default_rng(31)
    x = rng.normal(size=(60, 3))
    y = np.sin(x[:, 0]) + 0.3 * x[:, 1] + 0.2 * rng.normal(size=60)
    c, eps = 1.0, 0.1
    model = forecasters.KernelSvr(x, y, c, eps, rounds=5000)
    r = y - model.predict(x)
    beta = model.beta
    inside, bound = np.abs(beta) < 1e-9, np.abs(beta) > c - 1e-9
    assert (np.abs(r[inside]) <= eps + 1e-4).all() and inside.any()
    assert (np.sign(beta[bound]) * r[bound] >= eps - 1e-4).all() and bound.any()
    free = ~inside & ~bound
    assert np.abs(np.sign(beta[free]) * r[free] - eps).max() < 1e-4 and free.any()


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(32)
    x, l2 = np.round(rng.normal(size=(40, 3)), 1), 1.0
    y = (x[:, 1] > 0.3) * 2.0 + 0.1 * rng.normal(size=40)
    g = y - y.mean()
    best = (-1.0, None)
    for j in range(3):
        for cut in (np.unique(x[:, j])[1:] + np.unique(x[:, j])[:-1]) / 2:
            low = x[:, j] <= cut
            gain = g[low].sum() ** 2 / (low.sum() + l2) + g[~low].sum() ** 2 / ((~low).sum() + l2) - g.sum() ** 2 / (40 + l2)
            if gain > best[0] + 1e-12:
                best = (gain, (j, cut, g[low].sum() / (low.sum() + l2), g[~low].sum() / ((~low).sum() + l2)))
    [tree] = forecasters.Boosted(x, y, trees=1, depth=1, rate=1.0, l2=l2).trees
    assert tree == (best[1][0], pytest.approx(best[1][1]), pytest.approx(best[1][2]), pytest.approx(best[1][3]))


def test_seasonal_difference_forecast_by_hand():
    """Without coefficients the seasonal walk repeats the last season's step."""
    y = np.arange(30.0) + np.tile([0.0, 3.0, -1.0], 10)
    model = forecasters.Sarima(y, 3, [(0, 1, 0, 0, 1, 0)])
    assert model.forecast() == pytest.approx(y[-3] + (y[-1] - y[-4]))


def test_dynamic_design_and_decoding():
    rng = np.random.default_rng(35)
    x = rng.random((30, 2))
    at, used = swarm.dynamic_start(x, 6, 4, 0.15, 1.2, np.random.default_rng(1))
    radius, center, sigma = swarm.decode(at[2], 6, 2, used)
    assert 0.15 <= radius <= 1.2 and center.shape == sigma.shape == (used, 2)
    assert (at[:, 1 + 2 * used : 13] == 0).all() and (at[:, 13 + 2 * used :] == 0).all()
    phi = fuzzy.dynamic_design(x, center, sigma)
    plain = np.array([[np.exp(-0.5 * sum(((p[k] - c[k]) / s[k]) ** 2 for k in range(2))) for c, s in zip(center, sigma, strict=True)] for p in x])
    plain /= plain.sum(axis=1, keepdims=True)
    assert np.allclose(phi, np.concatenate([plain[:, [r]] * np.column_stack((np.ones(30), x)) for r in range(used)], axis=1))
    assert fuzzy.cluster_quality(x, x[:1], np.ones((1, 1))) == 0.0


def test_batches_stop_after_a_failed_task_and_go_on_where_they_stood(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.operators import fitting

    series = spark.range(240).select((F.col("id") % 6).cast("string").alias("series_id"), (F.col("id") / 6).cast("int").alias("t"), F.sin("id").alias("y"))
    good = fitting.tasks(series, ["naive_1", "drift"])
    done = fitting.in_batches(good, f"{tmp_path}/good", 12, 4)
    assert done.select("run_id").distinct().count() == 12 and done.count() == 12 * 8
    assert done.select("batch").distinct().count() == 3
    first = {f: f.stat().st_mtime_ns for f in tmp_path.glob("good/*/*.parquet")}
    assert fitting.in_batches(good, f"{tmp_path}/good", 12, 4).count() == 12 * 8
    assert first == {f: f.stat().st_mtime_ns for f in tmp_path.glob("good/*/*.parquet")}
    bad = fitting.in_batches(fitting.tasks(series, ["absent"]), f"{tmp_path}/bad", 12, 2)
    assert bad.select("batch").distinct().count() == 1 and bad.filter("status = 'failed'").count() == bad.count()
    assert fitting.in_batches(fitting.tasks(series, ["absent"]), f"{tmp_path}/all", 12, 2, fail_fast=False).select("run_id").distinct().count() == 6


def test_parameters_and_method_lists(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import rules

    df = spark.createDataFrame([(7, 3, False), (None, 3, False), (None, None, False), (30, 3, True), (2, 3, True)], "a int, b int, quick boolean")
    assert [r[0] for r in df.select(rules.resolved(F.col("a"), F.col("b"), 12, F.col("quick"))).collect()] == [7, 3, 12, 5, 2]
    names = spark.createDataFrame([("theta,Naive,theta, x", 1), ("seasonal_naive", 12), ("seasonal_naive", 1), (None, 1)], "names string, m int")
    got = names.select(rules.method_list(F.col("names"), ["naive_1", "seasonal_naive", "theta"], {"naive": "naive_1"}, F.col("m"))).collect()
    assert [r[0] for r in got] == [["theta", "naive_1"], ["seasonal_naive"], [], None]
