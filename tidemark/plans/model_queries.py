"""Queries of fitted models, clusterings, swarms, generators, designs, files and streams."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import forecasters, fuzzy, generators, neurofuzzy, smoothing, swarm
from tidemark.operators import fitting, metrics, reporting, selection, shaping, synthetic, tall
from tidemark.plans import design
from tidemark.plans.core import query, r8
from tidemark.plans.scores import CONDITION, METHODS, SCORES_SQL, scores
from tidemark.sources import files
from tidemark.sources.shared import shared_folder
from tidemark.sources.tables import FAMILIES_SQL, PRIORITY_SQL, families, priority_monthly, read

P = f"WITH {PRIORITY_SQL}"
M = 12
SEED = [41001]


def tasks(spark, d, methods, seeds=SEED):
    return fitting.tasks(priority_monthly(spark, d), methods, seeds)


def _scored(spark, d, methods, seeds=SEED):
    """Errors of fitted methods by series, method and seed."""
    work = tasks(spark, d, methods, seeds)
    mixed = "sarima" in methods and len(methods) > 1  # one method is dearer than all others together
    p = fitting.predictions(fitting.balanced(work) if mixed else work, M, dealt=mixed).filter("status = 'success'")
    scale = metrics.scales(priority_monthly(spark, d), M, F.col("t") < F.floor(F.col("n") * 0.8))
    return metrics.final(p.join(scale, "series_id"), "series_id", "method", "seed")


# -- forecasters that are fitted ------------------------------------------------------------------------------------------

for _id, _methods in {
    "M14_theta": ["theta"], "M15_sarima": ["sarima"], "M16_ets": ["ets"], "M17_ridge": ["ridge"], "M18_svr": ["svr_rbf"], "M19_boosted_trees": ["xgboost"],
    "M22_all_baselines": design.BASELINES, "M23_neuro_fuzzy": ["PC"], "M25_base": ["NF_BASE"], "M28_dynamic": ["DYNAMIC"],
    "M29_hybrid": ["HYBRID"], "K14_fcm_model": ["FCM"], "M27_ablation": list(neurofuzzy.VARIANTS),
}.items():
    query(_id)(lambda spark, d, methods=_methods: _scored(spark, d, methods))

for _id, _method in {"M02_rolling_arima": "arima_110", "M03_rolling_ets": "ets", "M04_rolling_theta": "theta"}.items():
    query(_id)(lambda spark, d, method=_method: fitting.refit(priority_monthly(spark, d), [method], M))


def _map_series(series, each, schema):
    """each(series_id, values) for every series: packed as a row each, and dealt out."""

    def run(batches):
        for batch in batches:
            for row in batch.itertuples():
                yield each(row.series_id, np.asarray(row.y, float))

    return fitting.spread(files.gather(series, "series_id", "t", "y")).mapInPandas(run, schema)


def _lag_rolling(kind: str):
    """A regression with fixed parameters, fitted again before each step."""

    def run(spark, d):
        def each(series_id: str, y: np.ndarray) -> pd.DataFrame:
            out = []
            for t in range(forecasters.initial_train(len(y)) or len(y), len(y)):
                x, target = forecasters.lagged(y[:t], 5)
                mean, sd = x.mean(axis=0), x.std(axis=0)
                if kind == "svr":
                    p = forecasters.KernelSvr((x - mean) / sd, target, 10.0, 0.05).predict((y[None, t - 5 : t] - mean) / sd)[0]
                else:
                    p = forecasters.Boosted(x, target).predict(y[None, t - 5 : t])[0]
                out.append((series_id, t, float(y[t]), float(p)))
            return pd.DataFrame(out, columns=["series_id", "t", "actual", "predicted"])

        return _map_series(priority_monthly(spark, d), each, "series_id string, t int, actual double, predicted double")

    return run


query("M05_rolling_svr")(_lag_rolling("svr"))
query("M06_rolling_boosted")(_lag_rolling("boosted"))


@query("M24_forecast_from_rules")
def forecast_from_rules(spark, d):
    """Test forecasts of stored rules as expressions: lags are observed values, so test rows are known."""
    stored = fitting.rules(tasks(spark, d, ["PC"]), M)
    bounds = stored.select("series_id", "low", "high").distinct()
    s = priority_monthly(spark, d).join(bounds, "series_id")
    scaled = s.withColumn("y", 0.1 + (F.col("y") - F.col("low")) * 0.8 / (F.col("high") - F.col("low")))
    rows = shaping.lag_array(scaled, M).filter(F.col("t") >= F.floor(F.col("n") * 0.8)).select("series_id", "t", "x", "target")
    fired = fitting.fire(rows, stored.select("series_id", "center", "sigma", "coef"))
    return fired.groupBy("series_id", "t").agg(F.sum(F.col("weight") * F.col("output")).alias("predicted"), F.first("target").alias("target"))


UNIT = f"{P}, u AS (SELECT series_id, t, (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) AS v FROM series WINDOW w AS (PARTITION BY series_id)), x AS (SELECT series_id, t, lag(v, 3) OVER w AS a, lag(v, 2) OVER w AS b, lag(v, 1) OVER w AS c FROM u WINDOW w AS (PARTITION BY series_id ORDER BY t))"
FIRED = f"""{UNIT}, rules(rule, center, sigma) AS (VALUES (1, 0.2::DOUBLE, 0.3::DOUBLE), (2, 0.8::DOUBLE, 0.4::DOUBLE)),
f AS (SELECT series_id, t, rule, a, b, c, -0.5 * (((a - center) / sigma) ** 2 + ((b - center) / sigma) ** 2 + ((c - center) / sigma) ** 2) AS s FROM x, rules WHERE t >= 3),
w AS (SELECT *, exp(s - max(s) OVER q) / sum(exp(s)) OVER q * exp(max(s) OVER q) AS weight FROM f WINDOW q AS (PARTITION BY series_id, t))"""


K06 = """SELECT series_id, t, round(sum(weight * CASE rule WHEN 1 THEN 0.5 * a + 0.2 * b + 0.1 * c + 0.05 ELSE 0.1 * a + 0.2 * b + 0.5 * c + 0.1 END), 8) AS predicted FROM w GROUP BY 1, 2"""


@query("K06_rule_outputs", f"{FIRED} {K06}")
def rule_outputs(spark, d):
    rows = shaping.lag_array(shaping.unit(priority_monthly(spark, d)).withColumn("y", F.col("unit")), 3).select("series_id", "t", "x")
    rule = spark.createDataFrame([([0.2] * 3, [0.3] * 3, [0.5, 0.2, 0.1, 0.05]), ([0.8] * 3, [0.4] * 3, [0.1, 0.2, 0.5, 0.1])], "center array<double>, sigma array<double>, coef array<double>")
    all_rules = rows.select("series_id").distinct().crossJoin(F.broadcast(rule))
    fired = fitting.fire(rows, all_rules)
    return fired.groupBy("series_id", "t").agg(r8(F.sum(F.col("weight") * F.col("output"))).alias("predicted"))


def _fired(spark, d):
    rows = shaping.lag_array(shaping.unit(priority_monthly(spark, d)).withColumn("y", F.col("unit")), 3).select("series_id", "t", "x")
    rule = spark.createDataFrame([(1, [0.2] * 3, [0.3] * 3, [0.5, 0.2, 0.1, 0.05]), (2, [0.8] * 3, [0.4] * 3, [0.1, 0.2, 0.5, 0.1])], "rule int, center array<double>, sigma array<double>, coef array<double>")
    return fitting.fire(rows, rows.select("series_id").distinct().crossJoin(F.broadcast(rule)))


@query("K04_firing_strength", f"{FIRED} SELECT series_id, t, CAST(rule AS INTEGER) AS rule, round(s, 8) AS log_strength FROM w")
def firing_strength(spark, d):
    return _fired(spark, d).select("series_id", "t", "rule", r8("log_strength").alias("log_strength"))


@query("K05_normalised_weights", f"{FIRED} SELECT series_id, t, CAST(rule AS INTEGER) AS rule, round(weight, 8) AS weight FROM w")
def normalised_weights(spark, d):
    return _fired(spark, d).select("series_id", "t", "rule", r8("weight").alias("weight"))


@query("I05_log_sum_exp", f"{FIRED} SELECT series_id, t, round(ln(sum(exp(s))), 8) AS total FROM f GROUP BY 1, 2")
def log_sum_exp(spark, d):
    return _fired(spark, d).groupBy("series_id", "t").agg(r8(F.max("log_strength") + F.log(F.sum(F.exp(F.col("log_strength"))))- F.max("log_strength")).alias("total"))


@query("K08_design_rows", f"{FIRED} SELECT series_id, t, CAST(rule AS INTEGER) AS rule, round(weight * a, 8) AS wx1, round(weight * c, 8) AS wx3, round(weight, 8) AS w FROM w")
def design_rows(spark, d):
    x = lambda k: r8(F.col("weight") * F.get("x", F.lit(k)))
    return _fired(spark, d).select("series_id", "t", "rule", x(0).alias("wx1"), x(2).alias("wx3"), r8("weight").alias("w"))


@query("J10_low_coverage", f"{FIRED}, c AS (SELECT series_id, t, ln(sum(exp(s))) AS total FROM f GROUP BY 1, 2) SELECT series_id, round(avg(greatest(0, ln(1e-1) - total) ** 2), 8) AS coverage FROM c GROUP BY 1")
def low_coverage(spark, d):
    total = _fired(spark, d).groupBy("series_id", "t").agg(F.log(F.sum(F.exp("log_strength"))).alias("total"))
    short = F.greatest(F.lit(0.0), F.lit(float(np.log(0.1))) - F.col("total"))
    return total.groupBy("series_id").agg(r8(F.avg(short * short)).alias("coverage"))


@query("K12_antecedent_bounds", f"{P} SELECT series_id, round(min(y) - 0.05 * greatest(max(y) - min(y), 1e-3), 8) AS low, round(max(y) + 0.05 * greatest(max(y) - min(y), 1e-3), 8) AS high, round(0.05 * greatest(max(y) - min(y), 1e-3), 8) AS least_sigma, round(greatest(max(y) - min(y), 1e-3), 8) AS most_sigma FROM series GROUP BY 1")
def antecedent_bounds(spark, d):
    span = F.greatest(F.max("y") - F.min("y"), F.lit(1e-3))
    g = priority_monthly(spark, d).groupBy("series_id")
    return g.agg(r8(F.min("y") - 0.05 * span).alias("low"), r8(F.max("y") + 0.05 * span).alias("high"), r8(0.05 * span).alias("least_sigma"), r8(span).alias("most_sigma"))


@query("K01_subtractive_clusters")
def subtractive_clusters(spark, d):
    return fitting.clusters(shaping.lag_array(priority_monthly(spark, d), 5), 0.55)


@query("K01_first_potential", f"{UNIT}, z AS (SELECT series_id, t, v FROM u) SELECT a.series_id, a.t, round(sum(exp(-4 / (0.55 * 0.55) * (a.v - b.v) * (a.v - b.v))), 8) AS potential FROM z a JOIN z b USING (series_id) GROUP BY 1, 2")
def first_potential(spark, d):
    u = shaping.unit(priority_monthly(spark, d)).select("series_id", "t", F.col("unit").alias("v"))
    both = u.join(u.select("series_id", F.col("v").alias("w")), "series_id")
    gap = F.col("v") - F.col("w")
    return both.groupBy("series_id", "t").agg(r8(F.sum(F.exp(-4 / (0.55 * 0.55) * gap * gap))).alias("potential"))


def _each_series(schema, f):
    """A query that applies f to the values of each series."""

    def run(spark, d):
        def each(series_id: str, y: np.ndarray) -> pd.DataFrame:
            out = pd.DataFrame(f(y))
            out.insert(0, "series_id", series_id)
            return out

        return _map_series(priority_monthly(spark, d), each, f"series_id string, {schema}")

    return run


def _raw_clusters(y):
    x, _ = forecasters.lagged((y - y.mean()) / y.std(), 2)
    center, width = fuzzy.subtractive_raw(x, 0.8, 5)
    return {"number": np.arange(len(center), dtype=np.int32), "center": list(center), "width": width[:, 0]}


def _fcm(y):
    x, _ = forecasters.lagged((y - y.mean()) / y.std(), 3)
    center, u = fuzzy.fuzzy_c_means(x, 2)
    return {"number": np.arange(2, dtype=np.int32), "center": list(center), "members": u.sum(axis=0)}


def _train(y):
    """The training part: four fifths, rounded down."""
    return y[: len(y) * 4 // 5]


def _small_model(y):
    near, far, *_ = neurofuzzy.prepare(_train(y), 5)
    return fuzzy.initial(*near, 1.0).fit(*near, 0.05), near, far


def _jacobian(y):
    model, near, far = _small_model(y)
    return {"row": np.arange(len(far[0]), dtype=np.int32), "jacobian": list(model.jacobian(far[0]))}


def _diagnostics(y):
    model, near, far = _small_model(y)
    rng = np.random.default_rng(123)
    x = far[0]
    step = 0.01 * x.std(axis=0, ddof=1)
    ratios = []
    for _ in range(8):
        e = rng.normal(size=x.shape) * step
        ratios.append(np.abs(model.predict(x + e) - model.predict(x)) / np.linalg.norm(e, axis=1))
    strength = np.exp(model.total_log_strength(x))
    return {"lipschitz": [float(np.max(ratios))], "jacobian_norm": [float(np.sqrt((model.jacobian(x) ** 2).sum(axis=1)).max())], "min_activation": [float(strength.min())], "median_activation": [float(np.median(strength))], "max_output": [float(np.abs(model.outputs(x)).max())]}


def _objective(y):
    model, near, far = _small_model(y)
    return {"objective": [fuzzy.objective(model, near, far)], "fit_rmse": [fuzzy.rmse(near[1], model.predict(near[0]))], "validation_rmse": [fuzzy.rmse(far[1], model.predict(far[0]))], "sensitivity": [fuzzy.sensitivity(model, far[0])], "coverage": [fuzzy.low_coverage(model, far[0])]}


def _legacy_objectives(y):
    model, near, far = _small_model(y)
    e = far[1] - model.predict(far[0])
    return {"error_std": [float(e.std(ddof=1))], "rmse": [float(np.sqrt((e**2).mean()))], "dynamic": [float(np.sqrt((e**2).mean())) + 0.01 * len(model.center) / 15]}


def _noise_study(y):
    model, near, far = _small_model(y)
    rng, rows = np.random.default_rng(123), []
    for level in (0.0, 0.01, 0.05, 0.1):
        for trial in range(30):
            p = model.predict(far[0] + rng.normal(size=far[0].shape) * level)
            rows.append((level, trial, fuzzy.rmse(far[1], p)))
    return pd.DataFrame(rows, columns=["level", "trial", "rmse"])


def _separation(y):
    c = _small_model(y)[0].center
    dist = np.sqrt(fuzzy._squared(c, c))
    dist[dist == 0] = np.inf
    return {"rules": [len(c)], "separation": [float(dist.min()) if len(c) > 1 else None]}


def _boundary(y):
    z = (y - y.min()) / np.ptp(y) * 1.4 - 0.2
    return {"candidate": z, "projected": np.clip(z, 0, 1), "velocity_sign": np.where((z < 0) | (z > 1), -1, 1).astype(np.int32)}


def _legacy_swarm(y):
    best, cost, rows = swarm.minimise(lambda v: float((v**2).sum()), np.full(4, y[0] % 1 + 1), np.full(4, -5.0), np.full(4, 5.0), 10, 20, 7, "nonconstricted", "project")
    return pd.DataFrame(rows)[["iteration", "best_cost", "swarm_diameter"]]


def _multiplicative(y):
    """The legacy search: factors in a wide box that scale the antecedents."""
    model, near, far = _small_model(y)
    start = model.vector()

    def cost(f):
        f = np.where(np.abs(f) < 1e-6, 1e-6, f)
        m = model.with_vector(start * f)
        return fuzzy.rmse(far[1], fuzzy.Tsk(m.center, np.abs(m.sigma), m.coef).predict(far[0]))

    _, value, _ = swarm.minimise(cost, np.ones_like(start), np.full_like(start, -25.0), np.full_like(start, 25.0), 8, 10, 123, "nonconstricted")
    return {"start": [cost(np.ones_like(start))], "best": [value]}


def _dynamic_search(y):
    near, far, *_ = neurofuzzy.prepare(_train(y), 5)
    model, radius, cost = swarm.dynamic_radius(*near, *far, seed=3)
    return {"rules": [len(model.center)], "radius": [radius], "cost": [cost]}


def _grid_choice(kind):
    def run(y):
        got = forecasters.LagRegression(_train(y), M, kind)
        return {"params": [json.dumps(got.params)], "validation_mase": [got.validation_mase]}

    return run


def _sarima_choice(y):
    got = forecasters.Sarima(_train(y), M)
    return {"order": [str(got.order)], "n_coefficients": [got.fit["k"] - 1], "loglik": [got.fit["loglik"]], "sigma2": [got.fit["sigma2"]]}


def _ets_choice(y):
    got = forecasters.Ets(_train(y), M)
    return {"trend": [got.trend], "seasonal": [got.seasonal], "sse": [got.fit["sse"]], "aicc": [got.fit["aicc"]]}


def _sha(y):
    import hashlib

    return {"sha256": [hashlib.sha256(np.asarray(y, "<f8").tobytes()).hexdigest()], "n": [len(y)]}


for _id, _schema, _f in (
    ("K03_raw_clusters", "number int, center array<double>, width double", _raw_clusters),
    ("K13_fuzzy_c_means", "number int, center array<double>, members double", _fcm),
    ("K07_jacobian", "row int, jacobian array<double>", _jacobian),
    ("J13_diagnostics", "lipschitz double, jacobian_norm double, min_activation double, median_activation double, max_output double", _diagnostics),
    ("E31_model_activation", "lipschitz double, jacobian_norm double, min_activation double, median_activation double, max_output double", _diagnostics),
    ("J07_objective", "objective double, fit_rmse double, validation_rmse double, sensitivity double, coverage double", _objective),
    ("J11_legacy_objectives", "error_std double, rmse double, dynamic double", _legacy_objectives),
    ("J14_noise_study", "level double, trial int, rmse double", _noise_study),
    ("E32_center_separation", "rules int, separation double", _separation),
    ("L06_boundary", "candidate double, projected double, velocity_sign int", _boundary),
    ("L02_legacy_swarm", "iteration int, best_cost double, swarm_diameter double", _legacy_swarm),
    ("L07_multiplicative_search", "start double, best double", _multiplicative),
    ("L03_dynamic_radius", "rules int, radius double, cost double", _dynamic_search),
    ("N03_ridge_choice", "params string, validation_mase double", _grid_choice("ridge")),
    ("N04_svr_choice", "params string, validation_mase double", _grid_choice("svr_rbf")),
    ("N05_boosted_choice", "params string, validation_mase double", _grid_choice("xgboost")),
    ("N10_sarima_choice", "order string, n_coefficients int, loglik double, sigma2 double", _sarima_choice),
    ("N11_ets_choice", "trend string, seasonal boolean, sse double, aicc double", _ets_choice),
    ("I13_series_sha256", "sha256 string, n int", _sha),
):
    query(_id)(_each_series(_schema, _f))


@query("K09_ridge_rules")
def ridge_rules(spark, d):
    return fitting.rules(tasks(spark, d, ["NF_BASE"], [0]), M)


@query("K09_tall_consequents", """WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity * l_quantity) + 0.01 AS a, sum(l_quantity) AS b, count(*) + 0.01 AS c, sum(l_quantity * l_extendedprice) / 1000 AS d, sum(l_extendedprice) / 1000 AS e FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, n, round((d * c - b * e) / (a * c - b * b), 6) AS slope, round((a * e - b * d) / (a * c - b * b), 6) AS intercept FROM g""")
def tall_consequents(spark, d):
    """Ridge consequents (price by quantity) of each flag and status, over all line items, from sums of products alone."""
    rows = read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.array(F.col("l_quantity").cast("double"), F.lit(1.0)).alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    got = tall.ridge(rows, ["l_returnflag", "l_linestatus"], "x", "y", 0.01)
    return got.select("l_returnflag", "l_linestatus", "n", F.round(F.col("coef")[0], 6).alias("slope"), F.round(F.col("coef")[1], 6).alias("intercept"))


@query("L01_swarm_history")
def swarm_history(spark, d):
    return fitting.history(tasks(spark, d, ["PC"]), M)


@query("E25_history_summary")
def history_summary(spark, d):
    h = fitting.history(tasks(spark, d, ["PC"]), M)
    cols = ["best_cost", "mean_cost", "swarm_diameter"]
    aggs = [a for c in cols for a in (F.min_by(c, "iteration").alias(f"{c}_first"), F.max_by(c, "iteration").alias(f"{c}_last"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    return h.groupBy("series_id", "method", "seed").agg(*aggs).withColumn("improvement", F.col("best_cost_first") - F.col("best_cost_last"))


# -- generators -------------------------------------------------------------------------------------------------------------


@query("O02_sine", "SELECT o_orderkey, i AS t, round(10 * sin(2 * pi() * i / 24) + 3.5 * sin(2 * pi() * i / 24) ** 2 + 0.03 * i, 8) AS y FROM (SELECT o_orderkey, CAST(o_orderkey % 180 AS INTEGER) AS i FROM orders)")
def sine(spark, d):
    """The sine series as an expression, at a place given by each order."""
    at = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 180).cast("int").alias("t"))
    return at.select("o_orderkey", "t", r8(synthetic.sine(F.col("t"))).alias("y"))


@query("O05_seasonal", "SELECT o_orderkey, i AS t, round(50 + 0.04 * i + 8 * sin(2 * pi() * i / 12) + 2.8 * cos(4 * pi() * i / 12), 8) AS y FROM (SELECT o_orderkey, CAST(o_orderkey % 180 AS INTEGER) AS i FROM orders)")
def seasonal(spark, d):
    at = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 180).cast("int").alias("t"))
    return at.select("o_orderkey", "t", r8(synthetic.seasonal(F.col("t"))).alias("y"))


def _factors(spark, names, seeds, levels):
    return design.product(design.values(spark, "generator", names, "string"), design.values(spark, "seed", seeds, "int"), design.values(spark, "noise_level", levels, "double"))


def by_supplier(spark, d, names, levels):
    """Factors of a panel with a seed for every supplier, so that the panel grows with the tables. Suppliers come first: the others are broadcast."""
    seeds = read(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("seed"))
    return design.product(seeds, design.values(spark, "generator", names, "string"), design.values(spark, "noise_level", levels, "double"))


for _k, _name in (("O01", "linear_ar"), ("O03", "regime_switching"), ("O04", "spiky_outbreak"), ("O06", "short_memory"), ("O07", "logistic_map"), ("O08", "henon_map"), ("O09", "lorenz63")):
    query(f"{_k}_{_name}")(lambda spark, d, name=_name: synthetic.panel(by_supplier(spark, d, [name], [0.0])))


@query("O10_relative_noise")
def relative_noise(spark, d):
    return synthetic.panel(by_supplier(spark, d, ["noisy_seasonal", "spiky_outbreak"], [0.05, 0.2]))


@query("O19_panel")
def panel(spark, d):
    return synthetic.panel(by_supplier(spark, d, list(generators.ALIASES), [0.0, 0.1]), 120)


# -- designs ------------------------------------------------------------------------------------------------------------------

GENS = "(SELECT unnest([" + ", ".join(f"'{g}'" for g in design.GENERATORS) + "]) AS generator)"


@query("Q01_development_tasks", f"SELECT generator, dgp_seed, noise_level, count(*) AS n FROM {GENS}, range(1001, 1011) a(dgp_seed), (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS noise_level), range(5) b(i), range(7) c(j), range(3) e(k) GROUP BY 1, 2, 3")
def development_tasks(spark, d):
    return design.development_tasks(spark).groupBy("generator", F.col("dgp_seed").cast("bigint").alias("dgp_seed"), "noise_level").agg(F.countDistinct("run_id").alias("n"))


@query("Q02_final_tasks", f"SELECT generator, CAST(3 * 20 * (5 + CASE WHEN generator IN ('nonlinear_sine', 'noisy_seasonal') THEN 9 ELSE 8 END) AS BIGINT) AS n FROM {GENS}")
def final_tasks(spark, d):
    return design.final_tasks(spark).groupBy("generator").agg(F.countDistinct("run_id").alias("n"))


@query("Q03_task_summary", f"SELECT method = 'neuro_fuzzy' AS is_pc, sum(n)::BIGINT AS n FROM (SELECT 'neuro_fuzzy' AS method, 2700 AS n UNION ALL SELECT 'baseline', 4440) GROUP BY 1")
def task_summary(spark, d):
    return design.final_tasks(spark).groupBy((F.col("method") == "neuro_fuzzy").alias("is_pc")).agg(F.count(F.lit(1)).alias("n"))


@query("I11_run_id")
def run_id(spark, d):
    return design.development_tasks(spark).select("run_id", "generator", "dgp_seed", "radius", "alpha")


@query("D07_factor_product", "SELECT r_name, n_name, k FROM region, nation, range(3) g(k)")
def factor_product(spark, d):
    return design.product(read(spark, d, "region").select("r_name"), read(spark, d, "nation").select("n_name"), spark.range(3).select(F.col("id").alias("k")))


@query("D08_conditional_product", "SELECT n_name, method, seed FROM nation, (SELECT 'pc' AS method, unnest([1, 2, 3, 4, 5]) AS seed UNION ALL SELECT unnest(['naive_1', 'drift']), NULL UNION ALL SELECT 'seasonal_naive', NULL) WHERE method <> 'seasonal_naive' OR n_regionkey > 1")
def conditional_product(spark, d):
    n = read(spark, d, "nation").select("n_name", "n_regionkey")
    pc = design.product(n, design.values(spark, "seed", [1, 2, 3, 4, 5], "int")).withColumn("method", F.lit("pc"))
    base = design.product(n, design.values(spark, "method", ["naive_1", "drift", "seasonal_naive"], "string")).filter("method <> 'seasonal_naive' OR n_regionkey > 1")
    return pc.unionByName(base, allowMissingColumns=True).select("n_name", "method", "seed")


ORDERS = "range(3) p(p), range(2) d(d), range(3) q(q), range(2) sp(sp), range(2) sd(sd), range(2) sq(sq) WHERE p + q + sp + sq <= 4"


SERIES = f"WITH {FAMILIES_SQL}, k AS (SELECT series_id, CAST(max(m) AS INTEGER) AS m, CAST(max(n) AS INTEGER) AS n FROM families GROUP BY 1)"
USABLE = "n - d - sd * m >= 10 + p + q + m * (sp + sq)"


def _series_sizes(spark, d):
    """Of every series of the families its season and length."""
    return families(spark, d).groupBy("series_id").agg(F.max("m").cast("int").alias("m"), F.max("n").cast("int").alias("n"))


def _sarima_options(spark, d):
    """The orders that each series is long enough for."""
    c = spark.createDataFrame(forecasters.sarima_candidates(12), "p int, d int, q int, sp int, sd int, sq int")
    return _series_sizes(spark, d).crossJoin(F.broadcast(c)).filter(USABLE)


@query("N06_sarima_candidates", f"{SERIES} SELECT series_id, p::INTEGER AS p, d::INTEGER AS d, q::INTEGER AS q, sp::INTEGER AS sp, sd::INTEGER AS sd, sq::INTEGER AS sq, d + sd = 0 AS has_constant FROM k, {ORDERS} AND {USABLE}")
def sarima_candidates(spark, d):
    return _sarima_options(spark, d).select("series_id", "p", "d", "q", "sp", "sd", "sq", (F.col("d") + F.col("sd") == 0).alias("has_constant"))


@query("N07_sarima_tie_order", f"{SERIES} SELECT series_id, p::INTEGER AS p, d::INTEGER AS d, q::INTEGER AS q, sp::INTEGER AS sp, sd::INTEGER AS sd, sq::INTEGER AS sq, row_number() OVER (PARTITION BY series_id ORDER BY p + q + sp + sq, d + sd, sp + sq, p, d, q, sp, sd, sq)::INTEGER AS place FROM k, {ORDERS} AND {USABLE}")
def sarima_tie_order(spark, d):
    key = [F.expr(e) for e in ("p + q + sp + sq", "d + sd", "sp + sq")]
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(*key, "p", "d", "q", "sp", "sd", "sq"))
    return _sarima_options(spark, d).select("series_id", "p", "d", "q", "sp", "sd", "sq", place.alias("place"))


ETS_OPTIONS = "(SELECT unnest(['none', 'linear', 'damped']) AS trend), (SELECT unnest([false, true]) AS seasonal)"


def _ets_options(spark, d):
    """The smoothing models that each series is long enough for: two seasons and a value for seasonal ones."""
    c = spark.createDataFrame(smoothing.candidates(12), "trend string, seasonal boolean")
    return _series_sizes(spark, d).crossJoin(F.broadcast(c)).filter("NOT seasonal OR (m > 1 AND n >= 2 * m + 1)").select("series_id", "m", "trend", "seasonal")


@query("N08_ets_candidates", f"{SERIES} SELECT series_id, m, trend, seasonal FROM k, {ETS_OPTIONS} WHERE NOT seasonal OR (m > 1 AND n >= 2 * m + 1)")
def ets_candidates(spark, d):
    return _ets_options(spark, d)


@query("N09_ets_tie_order", f"{SERIES} SELECT series_id, trend, seasonal, row_number() OVER (PARTITION BY series_id ORDER BY (trend <> 'none')::INTEGER + (trend = 'damped')::INTEGER + seasonal::INTEGER, seasonal, trend)::INTEGER AS place FROM k, {ETS_OPTIONS} WHERE NOT seasonal OR (m > 1 AND n >= 2 * m + 1)")
def ets_tie_order(spark, d):
    size = (F.col("trend") != "none").cast("int") + (F.col("trend") == "damped").cast("int") + F.col("seasonal").cast("int")
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(size, "seasonal", "trend"))
    return _ets_options(spark, d).select("series_id", "trend", "seasonal", place.alias("place"))


N01 = """WITH s AS (SELECT l_returnflag AS g, month(l_shipdate) AS seed, l_linenumber % 5 AS r, l_suppkey % 7 AS a, l_extendedprice / 1000 AS mase FROM lineitem),
c AS (SELECT g, seed, r, a, median(mase) AS m FROM s GROUP BY 1, 2, 3, 4), p AS (SELECT r, a, median(m) AS statistic, count(*) AS n_conditions FROM c GROUP BY 1, 2)
SELECT CAST(r AS BIGINT) AS r, CAST(a AS BIGINT) AS a, round(statistic, 8) AS statistic, n_conditions FROM p ORDER BY statistic, r DESC, a DESC LIMIT 1"""


@query("N01_pair_selection", N01)
def pair_selection(spark, d):
    """Line items stand in for scores: conditions by flag and month of shipping, pairs by line and supplier, replicates within."""
    s = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.month("l_shipdate").alias("seed"), (F.col("l_linenumber") % 5).cast("bigint").alias("r"), (F.col("l_suppkey") % 7).cast("bigint").alias("a"), (F.col("l_extendedprice") / 1000).alias("mase"))
    best = selection.two_level_median(s, ["g", "seed"], ["r", "a"], "mase").withColumnsRenamed({"r": "radius", "a": "alpha"})
    return selection.best_pair(best).select(F.col("radius").alias("r"), F.col("alpha").alias("a"), r8("statistic").alias("statistic"), "n_conditions")


@query("N02_complete_gate", """WITH m AS (SELECT DISTINCT o_orderpriority AS g, date_trunc('month', o_orderdate) AS c, o_orderstatus AS s FROM orders)
SELECT s, count(DISTINCT g) * count(DISTINCT c) AS expected, count(*) AS found, count(DISTINCT g) * count(DISTINCT c) = count(*) AS open FROM m GROUP BY s""")
def complete_gate(spark, d):
    """By status of orders: whether every priority has every month; the gate opens only where nothing is missing."""
    m = read(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.trunc("o_orderdate", "month").alias("c"), F.col("o_orderstatus").alias("s")).distinct()
    sizes = m.groupBy("s").agg((F.countDistinct("g") * F.countDistinct("c")).alias("expected"), F.count(F.lit(1)).alias("found"))
    return sizes.withColumn("open", F.col("expected") == F.col("found"))


M26 = """SELECT CASE WHEN c AND r THEN 'PC' WHEN c THEN 'C' WHEN r THEN 'P' ELSE 'NEITHER' END AS variant, c AS constricted, r AS rejects, 0.5::DOUBLE AS w_fit, 0.001::DOUBLE AS w_sensitivity, 0.01::DOUBLE AS w_coverage
  FROM (SELECT unnest([true, false]) AS c), (SELECT unnest([true, false]) AS r)
UNION ALL SELECT name, true, true, CASE WHEN k = 1 THEN 0 ELSE 0.5 END, CASE WHEN k <= 2 THEN 0 ELSE 0.001 END, CASE WHEN k = 2 THEN 0.01 ELSE 0 END
  FROM (SELECT unnest(['VALIDATION_ONLY', 'NO_SENSITIVITY', 'NO_COVERAGE']) AS name, unnest([1, 2, 3]) AS k)
UNION ALL SELECT 'NF_BASE', NULL, NULL, NULL, NULL, NULL"""


@query("M26_variants", M26)
def variants(spark, d):
    """Dynamics, boundary and weights of the objective of each ablation; the base has no swarm."""
    usual = (fuzzy.W_FIT, fuzzy.W_VALIDATION, fuzzy.W_SENSITIVITY, fuzzy.W_COVERAGE)
    rows = []
    for name, (dynamics, boundary, weights) in neurofuzzy.VARIANTS.items():
        w = weights or usual
        rows.append((name, dynamics == "constricted", boundary == "feasible_rejection", w[0], w[2], w[3]) if dynamics else (name, *[None] * 5))
    return spark.createDataFrame(rows, "variant string, constricted boolean, rejects boolean, w_fit double, w_sensitivity double, w_coverage double")


@query("Q05_final_execution")
def final_execution(spark, d):
    """Tasks that have no result yet are run; the rest is left alone."""
    every = tasks(spark, d, ["naive_1", "theta", "PC"])
    done = every.filter("method = 'naive_1'").select("series_id", "method")
    return fitting.predictions(fitting.balanced(every.join(done, ["series_id", "method"], "left_anti")), M, dealt=True)


@query("Q17_experiment_grid")
def experiment_grid(spark, d):
    """Protocol x radius x seed."""
    every = tasks(spark, d, ["C", "NEITHER"], [1, 2]).crossJoin(design.values(spark, "radius", [0.55, 0.75, 1.0], "double"))

    def run(batches):
        for batch in batches:
            for task in batch.itertuples():
                y = np.asarray(task.y, float)
                got = neurofuzzy.fit(y[: task.n_train], forecasters.lags_for(M), radius=task.radius, seed=task.seed, variant=task.method)
                yield pd.DataFrame({"series_id": [task.series_id], "method": [task.method], "radius": [task.radius], "seed": [task.seed], "objective": [got.objective], "n_rules": [len(got.model.center)], "rmse": [fuzzy.rmse(y[task.n_train :], got.forecast(y[task.n_train :]))]})

    dealt = fitting.spread(every.select("series_id", "y", "n_train", "method", "seed", "radius"))
    return dealt.mapInPandas(run, "series_id string, method string, radius double, seed int, objective double, n_rules int, rmse double")


@query("Q23_series_manifest")
def series_manifest(spark, d):
    s = priority_monthly(spark, d)
    ok = selection.eligibility(s, M).filter("eligible_reason = 'eligible'").withColumn("source", F.lit("orders"))
    return selection.by_hash(ok, ["source"], ["source", "series_id"], 2, 3).select("series_id", "n", "split_index", "rank_sha256", "partition")


# -- checks, files, streams, reports -------------------------------------------------------------------------------------------


@query("B12_result_checks")
def result_checks(spark, d):
    from tidemark.operators.checks import violations

    return violations(fitting.predictions(tasks(spark, d, ["naive_1", "seasonal_naive", "ridge"]), M))


def _results_dir(spark, d) -> str:
    """Scores as a folder of JSON results, in the shared folder."""
    import uuid

    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    s = scores(spark, d)
    nested = s.select(F.lit("success").alias("status"), F.struct(*CONDITION, "method").alias("task"), F.struct("mae", "rmse", "mase").alias("metrics"))
    nested.write.json(path)
    return path


@query("A15_result_folder", f"{SCORES_SQL} SELECT family AS task_family, series AS task_series, rule AS task_rule, method AS task_method, mae AS metrics_mae, rmse AS metrics_rmse, mase AS metrics_mase FROM scores")
def result_folder(spark, d):
    flat = reporting.flatten(spark.read.json(_results_dir(spark, d)).filter("status = 'success'").drop("status"))
    return flat.select("task_family", "task_series", "task_rule", "task_method", "metrics_mae", "metrics_rmse", "metrics_mase")


@query("A16_result_matrix", f"{SCORES_SQL} SELECT concat_ws('|', family, series, rule) AS task_id, first(rmse) FILTER (WHERE method = 'drift') AS drift, first(rmse) FILTER (WHERE method = 'naive_1') AS naive_1, first(rmse) FILTER (WHERE method = 'seasonal_naive') AS seasonal_naive FROM scores GROUP BY 1")
def result_matrix(spark, d):
    r = spark.read.json(_results_dir(spark, d)).select(F.concat_ws("|", "task.family", "task.series", "task.rule").alias("task_id"), "task.method", "metrics.rmse")
    return r.groupBy("task_id").pivot("method", METHODS).agg(F.first("rmse"))


@query("A12_metrics_files", f"{SCORES_SQL} SELECT series AS dataset, method AS model, rmse FROM scores WHERE rule <> 'f70'")
def metrics_files(spark, d):
    import uuid

    path = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    s = scores(spark, d).select(F.col("series").alias("dataset"), F.col("method").alias("model"), "rmse", F.when(F.col("rule") == "f70", "FAILED").when(F.col("rule") == "f80", "OK").alias("status"))
    s.write.csv(path, header=True)
    return files.read_metrics(spark, path).select("dataset", "model", F.col("rmse").cast("double").alias("rmse"))


@query("A18_model_store")
def model_store(spark, d):
    import uuid

    path = f"{shared_folder(spark)}/rules-{uuid.uuid4().hex}"
    files.write_once(fitting.rules(tasks(spark, d, ["NF_BASE"], [0]), M), path)
    return spark.read.parquet(path)


@query("R01_predict_observe")
def predict_observe(spark, d):
    """The stream over the priority series; its forecasts equal the batch ones (see tests)."""
    from tidemark.streaming.run import over

    return over(priority_monthly(spark, d).select("series_id", F.col("t").cast("bigint").alias("t"), "y"), M)


@query("R02_ses_fold", f"{P} SELECT series_id, CAST(count(*) AS BIGINT) AS n, round(list_reduce(list(y ORDER BY t), lambda a, b: a + 0.3 * (b - a)), 8) AS level FROM series GROUP BY 1")
def ses_fold(spark, d):
    packed = files.gather(priority_monthly(spark, d), "series_id", "t", "y")
    level = F.aggregate(F.slice("y", 2, F.size("y")), F.element_at("y", 1), lambda a, b: a + 0.3 * (b - a))
    return packed.select("series_id", F.size("y").cast("bigint").alias("n"), r8(level).alias("level"))


@query("T05_performance_table", f"{SCORES_SQL} SELECT method, printf('%.4f', avg(rmse)) AS rmse, printf('%.4f', avg(mase)) AS mase FROM scores GROUP BY 1")
def performance_table(spark, d):
    s = scores(spark, d).groupBy("method").agg(F.avg("rmse").alias("rmse"), F.avg("mase").alias("mase"))
    return s.select("method", F.format_string("%.4f", "rmse").alias("rmse"), F.format_string("%.4f", "mase").alias("mase"))


@query("T10_collected_tables", f"{SCORES_SQL} SELECT 'rmse' AS metric, method, round(avg(rmse), 8) AS value FROM scores GROUP BY 2 UNION ALL SELECT 'mase', method, round(avg(mase), 8) FROM scores GROUP BY 2")
def collected_tables(spark, d):
    s = scores(spark, d).groupBy("method").agg(F.avg("rmse").alias("rmse"), F.avg("mase").alias("mase"))
    return s.unpivot("method", ["rmse", "mase"], "metric", "value").select("metric", "method", r8("value").alias("value"))
