"""Queries of the remaining operators: variants, state updates, selections with ties, reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import forecasters, fuzzy, neurofuzzy, rules
from tidemark.operators import fitting, inference, ranking, shaping, synthetic, tall
from tidemark.plans import design
from tidemark.plans.analytics_queries import PAIRS, S, pairs
from tidemark.plans.core import query, r8
from tidemark.plans.model_queries import M, SEED, UNIT, _each_series, _small_model, _train, by_supplier, tasks
from tidemark.plans.scores import CONDITION, METHODS, scores
from tidemark.sources import files
from tidemark.sources.tables import PRIORITY_SQL, priority_monthly, read

P = f"WITH {PRIORITY_SQL}"


@query("A04_filtered_wide_scan", f"{P} SELECT series_id, t, round(y, 8) AS y FROM series WHERE t < 24 AND series_id = '5-LOW'")
def filtered_wide_scan(spark, d):
    """The filter on the key goes below the unpivot, to the scan."""
    wide = priority_monthly(spark, d).filter("t < 24").groupBy("series_id").pivot("t", list(range(24))).agg(F.first("y"))
    return files.narrow(wide.filter("series_id = '5-LOW'"), "series_id").select("series_id", F.col("t").cast("int").alias("t"), r8("y").alias("y"))


@query("A07_fingerprints")
def fingerprints(spark, d):
    """Series whose stored SHA-256 is what their values give: task rows joined with a manifest."""
    import hashlib

    sha = F.pandas_udf(lambda ys: pd.Series([hashlib.sha256(np.asarray(y, "<f8").tobytes()).hexdigest() for y in ys]), "string")
    packed = files.gather(priority_monthly(spark, d), "series_id", "t", "y").withColumn("sha256", sha("y"))
    manifest = packed.select("series_id", F.col("sha256").alias("expected"))
    return packed.join(manifest, "series_id").select("series_id", F.size("y").alias("n"), (F.col("sha256") == F.col("expected")).alias("verified"))


@query("A28_import_metrics", f"{S} SELECT 'orders' AS dataset, 'imported' AS source, series, method, mase FROM scores WHERE rule = 'f80'")
def import_metrics(spark, d):
    return scores(spark, d).filter("rule = 'f80'").select(F.lit("orders").alias("dataset"), F.lit("imported").alias("source"), "series", "method", "mase")


@query("A29_attach_metadata", "SELECT l_orderkey, l_linenumber, o_orderpriority AS run_model FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1")
def attach_metadata(spark, d):
    meta = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("run_model"))
    return read(spark, d, "lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_linenumber").join(meta, "l_orderkey")


@query("B14_constraints", f"{S} SELECT method, count(*) FILTER (WHERE mase IS NULL OR mase < 0) AS bad_mase, count(*) FILTER (WHERE smape NOT BETWEEN 0 AND 200) AS bad_smape FROM scores GROUP BY 1")
def constraints(spark, d):
    return scores(spark, d).groupBy("method").agg(F.count_if(F.col("mase").isNull() | (F.col("mase") < 0)).alias("bad_mase"), F.count_if(~F.col("smape").between(0, 200)).alias("bad_smape"))


@query("C04_raw_lags", f"{P} SELECT * FROM (SELECT series_id, t, lag(y, 2) OVER w AS x1, lag(y, 1) OVER w AS x2, y AS target FROM series WINDOW w AS (PARTITION BY series_id ORDER BY t)) WHERE t >= 2")
def raw_lags(spark, d):
    return shaping.lag_columns(priority_monthly(spark, d), 2).select("series_id", "t", "x1", "x2", "target")


@query("C14_validation_rows", f"{P}, s AS (SELECT series_id, t, CAST(floor(0.8::DOUBLE * n) AS INTEGER) AS n FROM series), k AS (SELECT *, greatest(8, floor(0.2 * (n - 5))) AS tail FROM s) SELECT series_id, t FROM k WHERE t < n AND t >= n - tail AND n - 5 - tail >= 11")
def validation_rows(spark, d):
    s = priority_monthly(spark, d).withColumn("n", rules.floor_split(F.col("n")))
    return s.filter("t < n").filter(F.col("t") >= F.col("n") - rules.tail_size(F.col("n"), F.lit(5))).select("series_id", "t")


@query("D12_pairwise_signs", f"{S} SELECT count(*) FILTER (WHERE a.mase > b.mase) AS above, count(*) FILTER (WHERE a.mase < b.mase) AS below FROM scores a, scores b WHERE a.method = 'drift' AND b.method = 'seasonal_naive' AND a.family = b.family AND a.rule = b.rule")
def pairwise_signs(spark, d):
    s = scores(spark, d)
    a = s.filter("method = 'drift'").select("family", "rule", F.col("mase").alias("a"))
    b = s.filter("method = 'seasonal_naive'").select("family", "rule", F.col("mase").alias("b"))
    return a.join(b, ["family", "rule"]).agg(F.count_if(F.col("a") > F.col("b")).alias("above"), F.count_if(F.col("a") < F.col("b")).alias("below"))


@query("F09_first_and_last", f"{P} SELECT series_id, round(arg_min(y, t), 8) AS first, round(arg_max(y, t), 8) AS last, round(min(y), 8) AS low, round(max(y), 8) AS high FROM series GROUP BY 1")
def first_and_last(spark, d):
    return priority_monthly(spark, d).groupBy("series_id").agg(r8(F.min_by("y", "t")).alias("first"), r8(F.max_by("y", "t")).alias("last"), r8(F.min("y")).alias("low"), r8(F.max("y")).alias("high"))


@query("G04_criterion_choice", f"{S} SELECT family, series, rule, arg_min(method, (mase, method)) AS best FROM scores GROUP BY 1, 2, 3")
def criterion_choice(spark, d):
    return scores(spark, d).groupBy(*CONDITION).agg(F.min_by("method", F.struct("mase", "method")).alias("best"))


@query("G06_seeded_pick")
def seeded_pick(spark, d):
    """One of the sorted candidates, by a number that a seeded generator draws."""
    names = read(spark, d, "customer").select("c_custkey")
    at = int(np.random.default_rng(2026).integers(0, names.count()))
    return names.orderBy("c_custkey").offset(at).limit(1)


@query("I02_normal_p")
def normal_p(spark, d):
    z = pairs(spark, d).select(*CONDITION, ((F.col("a") - F.col("b")) * 3).alias("z"))
    return z.withColumn("p", inference.scalar(inference.normal_two_sided, F.col("z")))


@query("I04_membership", f"{UNIT} SELECT series_id, t, round(-0.5 * ((c - 0.5) / 0.2) ** 2, 8) AS log_membership FROM x WHERE t >= 1")
def membership(spark, d):
    u = shaping.unit(priority_monthly(spark, d)).withColumn("c", F.lag("unit").over(shaping.order())).filter("t >= 1")
    return u.select("series_id", "t", r8(-0.5 * F.pow((F.col("c") - 0.5) / 0.2, 2)).alias("log_membership"))


@query("I08_diameter", f"{S}, w AS (SELECT family, rule, series, avg(mase) AS x, avg(rmse) AS y FROM scores GROUP BY 1, 2, 3) SELECT a.family, a.rule, round(max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 8) AS diameter FROM w a JOIN w b USING (family, rule) GROUP BY 1, 2")
def diameter(spark, d):
    w = scores(spark, d).groupBy("family", "rule", "series").agg(F.avg("mase").alias("x"), F.avg("rmse").alias("y"))
    return tall.diameter(w, ["family", "rule"], "x", "y").withColumn("diameter", r8("diameter"))


def _sensitivity(y):
    model, near, far = _small_model(y)
    return {"sensitivity": [fuzzy.sensitivity(model, np.concatenate((near[0], far[0])))], "rows": [len(near[0]) + len(far[0])]}


def _initial(y):
    near, *_ = neurofuzzy.prepare(_train(y), 5)
    model = fuzzy.initial(*near, 0.55)
    return {"rule": np.arange(len(model.center), dtype=np.int32), "center": list(model.center), "sigma": list(model.sigma)}


def _limited_clusters(y):
    x, target = forecasters.lagged(y, 5)
    at, potential = fuzzy.subtractive(np.column_stack((x, target)), 0.55, most=4)
    return {"row": at.astype(np.int32), "potential": potential}


def _vectors(y):
    model, *_ = _small_model(y)
    v = model.vector()
    back = model.with_vector(v)
    return {"size": [len(v)], "same": [bool((back.center == model.center).all() and (back.sigma == model.sigma).all())]}


def _inner_errors(y):
    return {"method": ["ridge", "xgboost"], "validation_mase": [forecasters.LagRegression(_train(y), M, k).validation_mase for k in ("ridge", "xgboost")]}


for _id, _schema, _f in (
    ("J06_validation_mase", "method string, validation_mase double", _inner_errors),
    ("J09_sensitivity", "sensitivity double, rows int", _sensitivity),
    ("K02_limited_clusters", "row int, potential double", _limited_clusters),
    ("K10_antecedent_vector", "size int, same boolean", _vectors),
    ("K11_initial_rules", "rule int, center array<double>, sigma array<double>", _initial),
):
    query(_id)(_each_series(_schema, _f))


@query("J12_dynamic_fitness")
def dynamic_fitness(spark, d):
    p = fitting.predictions(tasks(spark, d, ["DYNAMIC"], SEED), M)
    return p.groupBy("series_id").agg(F.first("objective").alias("fitness"), F.first("n_rules").alias("n_rules"))


@query("M30_legacy_experiment")
def legacy_experiment(spark, d):
    """Both legacy protocols: nonconstricted swarm, projected, and the research variant with a validation objective."""
    return fitting.predictions(tasks(spark, d, ["NEITHER", "VALIDATION_ONLY"], [123]), M).groupBy("series_id", "method").agg(F.sqrt(F.avg(F.pow(F.col("actual") - F.col("predicted"), 2))).alias("rmse"))


for _k, _name, _n in (("O13", "ar", 120), ("O14", "sine", 240), ("O15", "regime", 120), ("O16", "spiky", 60), ("O17", "seasonal", 120), ("O18", "short", 50)):
    query(f"{_k}_{_name}_any_length")(lambda spark, d, name=_name, n=_n: synthetic.panel(by_supplier(spark, d, [name], [0.0, 0.1]), n))


@query("O11_noise_bundle")
def noise_bundle(spark, d):
    """All levels of a series share their noise draws."""
    levels = [0.05, 0.1, 0.2]
    p = synthetic.bundle(by_supplier(spark, d, ["linear_ar"], [0.0]).select("generator", "seed").distinct(), levels)
    shares = [F.abs((F.col("y")[i] - F.col("clean")) / F.lit(level)) for i, level in enumerate(levels)]
    return p.select("seed", "t", F.greatest(*shares).alias("high"), F.least(*shares).alias("low"))


@query("P08_report")
def report(spark, d):
    s = scores(spark, d)
    a = ranking.summarise(s, CONDITION, "method", "mase").withColumn("part", F.lit("summary"))
    b = inference.compare_to(s, CONDITION, "method", "mase", "seasonal_naive", METHODS).withColumnRenamed("model", "method").withColumn("part", F.lit("comparison"))
    return a.unionByName(b, allowMissingColumns=True)


@query("P11_ablation_ranks", f"{PAIRS}, d AS (SELECT abs(a - b) AS m, sign(a - b) AS s FROM pairs WHERE a <> b), r AS (SELECT s, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS r FROM d) SELECT least(coalesce(sum(r) FILTER (WHERE s > 0), 0.0), coalesce(sum(r) FILTER (WHERE s < 0), 0.0)) AS statistic, count(*) AS n FROM r")
def ablation_ranks(spark, d):
    return inference.signed_ranks(pairs(spark, d)).select("statistic", "n")


@query("Q11_ablation_grid", f"{P} SELECT DISTINCT series_id, variant FROM series, (SELECT unnest(['PC', 'P', 'C', 'NEITHER', 'VALIDATION_ONLY', 'NO_SENSITIVITY', 'NO_COVERAGE', 'NF_BASE']) AS variant)")
def ablation_grid(spark, d):
    return tasks(spark, d, list(neurofuzzy.VARIANTS)).select("series_id", F.col("method").alias("variant")).distinct()


@query("Q20_radius_sweep")
def radius_sweep(spark, d):
    packed = files.gather(priority_monthly(spark, d), "series_id", "t", "y").crossJoin(F.broadcast(design.values(spark, "radius", design.RADII, "double")))

    def run(batches):
        for batch in batches:
            for task in batch.itertuples():
                y = np.asarray(task.y, float)
                split = len(_train(y))
                got = neurofuzzy.fit(y[:split], 12, radius=task.radius, variant="NF_BASE")
                yield pd.DataFrame({"series_id": [task.series_id], "radius": [task.radius], "n_rules": [len(got.model.center)], "rmse": [fuzzy.rmse(y[split:], got.forecast(y[split:]))]})

    return fitting.spread(packed).mapInPandas(run, "series_id string, radius double, n_rules int, rmse double")


@query("Q21_seed_study")
def seed_study(spark, d):
    p = fitting.predictions(tasks(spark, d, ["PC"], [1, 2, 3]), M)
    by = p.groupBy("series_id", "seed").agg(F.sqrt(F.avg(F.pow(F.col("actual") - F.col("predicted"), 2))).alias("rmse"))
    return by.groupBy("series_id").agg(F.avg("rmse").alias("mean"), F.stddev_samp("rmse").alias("std"), F.min("rmse").alias("min"), F.max("rmse").alias("max"))


@query("R03_ring_state", f"{P} SELECT series_id, t, lag(y, 12) OVER (PARTITION BY series_id ORDER BY t) AS oldest FROM series")
def ring_state(spark, d):
    """The batch twin of a ring buffer of a season."""
    ring = F.collect_list("y").over(shaping.order().rowsBetween(-12, -1))
    return priority_monthly(spark, d).select("series_id", "t", F.when(F.size(ring) == 12, F.get(ring, F.lit(0))).alias("oldest"))


@query("R04_lag_buffer", f"{P} SELECT series_id, t, lag(y, 1) OVER w AS newest, CAST(least(t, 5) AS INTEGER) AS size FROM series WINDOW w AS (PARTITION BY series_id ORDER BY t)")
def lag_buffer(spark, d):
    ring = F.collect_list("y").over(shaping.order().rowsBetween(-5, -1))
    return priority_monthly(spark, d).select("series_id", "t", F.try_element_at(ring, F.lit(-1)).alias("newest"), F.size(ring).alias("size"))


def _stream(method):
    """Fitted on the training part, then a stream over the rest with the model in the state store."""

    def run(spark, d):
        from tidemark.streaming.fitted import over

        out = over(priority_monthly(spark, d), method, M)
        return out.select("series_id", F.col("t").cast("int").alias("t"), "predicted", "actual")

    return run


for _id, _kind in (("R02_theta_state", "theta"), ("R05_ets_state", "ets"), ("R06_sarima_state", "sarima"), ("M20_lag_regression_state", "ridge")):
    query(_id)(_stream(_kind))

TEST = f"{P}, s AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM series), k AS (SELECT *, CAST(floor(n * 0.8) AS BIGINT) AS split FROM s), f AS (SELECT series_id, min_by(y, t) AS first, max_by(y, t) AS last, count(*) AS n FROM k WHERE t < split GROUP BY 1)"
query("R03_naive_stream", f"{TEST} SELECT series_id, t::INTEGER AS t, predicted, y AS actual FROM (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS predicted FROM k) WHERE t >= split")(_stream("naive_1"))
query("R03_seasonal_stream", f"{TEST} SELECT series_id, t::INTEGER AS t, predicted, y AS actual FROM (SELECT *, lag(y, 12) OVER (PARTITION BY series_id ORDER BY t) AS predicted FROM k) WHERE t >= split")(_stream("seasonal_naive"))
query("R03_drift_stream", f"{TEST} SELECT series_id, t::INTEGER AS t, before + (last - first) / (n_train - 1) AS predicted, y AS actual FROM (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS before FROM k) JOIN (SELECT series_id, first, last, n AS n_train FROM f) USING (series_id) WHERE t >= split")(_stream("drift"))


@query("T06_best_models", f"{S}, m AS (SELECT family, series, method, mase, rank() OVER (PARTITION BY family, series, rule ORDER BY mase) AS r, rule FROM scores) SELECT family, series, rule, method AS best, printf('%.3f', mase) AS mase FROM m WHERE r = 1")
def best_models(spark, d):
    r = F.rank().over(Window.partitionBy(*CONDITION).orderBy("mase"))
    return scores(spark, d).withColumn("r", r).filter("r = 1").select(*CONDITION, F.col("method").alias("best"), F.format_string("%.3f", "mase").alias("mase"))


@query("T09_level_table", f"{S} SELECT method, printf('%.2f', avg(rmse) FILTER (WHERE rule = 'f70')) AS f70, printf('%.2f', avg(rmse) FILTER (WHERE rule = 'f85')) AS f85 FROM scores GROUP BY 1")
def level_table(spark, d):
    w = scores(spark, d).groupBy("method").pivot("rule", ["f70", "f85"]).agg(F.avg("rmse"))
    return w.select("method", *(F.format_string("%.2f", c).alias(c) for c in ("f70", "f85")))


@query("X33_random_walk_demo")
def random_walk_demo(spark, d):
    """Two methods side by side on a random walk of 200 steps."""
    walk = np.random.default_rng(42).normal(size=200).cumsum()
    s = spark.createDataFrame([("walk", t, float(v)) for t, v in enumerate(walk)], "series_id string, t int, y double")
    p = fitting.predictions(fitting.tasks(s, ["PC", "DYNAMIC"], [42]), 1)
    return p.groupBy("method").agg(F.sqrt(F.avg(F.pow(F.col("actual") - F.col("predicted"), 2))).alias("rmse"), F.first("status").alias("status"))
