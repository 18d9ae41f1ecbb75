"""Queries of runners, workspaces, parameter rules and stored models, and of models whose rules or starts are given."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import forecasters, fuzzy, generators, neurofuzzy, rules
from tidemark.operators import checks, fitting, metrics
from tidemark.plans import design
from tidemark.plans.analytics_queries import S
from tidemark.plans.core import query, r8
from tidemark.plans.model_queries import FIRED, K06, M, ORDERS, P, _map_series, _scored, _train, rule_outputs, tasks
from tidemark.plans.protocol_queries import _place
from tidemark.plans.scores import CONDITION, scores
from tidemark.sources import files
from tidemark.sources.tables import priority_monthly, read


def _texts(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# -- columns that are found -----------------------------------------------------------------------------------------------

CUSTOMER = ["c_name", "c_mktsegment", "c_acctbal", "c_custkey"]


@query("A02a_value_column", f"SELECT CASE {' '.join(f'WHEN count(TRY_CAST({c} AS DOUBLE)) >= 10 THEN {c!r}' for c in CUSTOMER)} END AS value_column FROM customer")
def value_column(spark, d):
    """No column has a known name: the first with enough readable numbers, in one pass over all of them."""
    df = read(spark, d, "customer").select(CUSTOMER)
    return spark.createDataFrame([(files.detect_value(df),)], "value_column string")


@query("A02b_date_column", f"SELECT columns, (SELECT c FROM (SELECT unnest(string_split(columns, ',')) AS c) WHERE list_contains([{_texts(files.DATE_NAMES)}], lower(c)) ORDER BY list_position([{_texts(files.DATE_NAMES)}], lower(c)) LIMIT 1) AS date_column FROM (VALUES ('value,Month,Date'), ('ds,y'), ('a,b')) t(columns)")
def date_column(spark, d):
    found = [(c, files.detect_date(spark.createDataFrame([], ", ".join(f"`{x}` string" for x in c.split(","))))) for c in ("value,Month,Date", "ds,y", "a,b")]
    return spark.createDataFrame(found, "columns string, date_column string")


# -- candidates -----------------------------------------------------------------------------------------------------------

GRIDS = """SELECT 'ridge' AS method, a, NULL::DOUBLE AS b, NULL::DOUBLE AS c, NULL::DOUBLE AS d FROM (SELECT unnest([0.001, 0.01, 0.1, 1, 10, 100, 1000]::DOUBLE[]) AS a)
UNION ALL SELECT 'svr_rbf', a, b, c, NULL FROM (SELECT unnest([0.1, 1, 10, 100]::DOUBLE[]) AS a), (SELECT unnest([0.2, 0.1, 0.01]::DOUBLE[]) AS b), (SELECT unnest([NULL, 0.01, 0.1]::DOUBLE[]) AS c)
UNION ALL SELECT 'xgboost', a, b, c, d FROM (SELECT unnest([50, 150]::DOUBLE[]) AS a), (SELECT unnest([2, 3]::DOUBLE[]) AS b), (SELECT unnest([0.05, 0.1]::DOUBLE[]) AS c), (SELECT unnest([5, 1]::DOUBLE[]) AS d)"""


@query("N12_grids", GRIDS)
def grids(spark, d):
    rows = [(k, *(None if v is None else float(v) for v in (*p, *[None] * (4 - len(p))))) for k in ("ridge", "svr_rbf", "xgboost") for p in forecasters.candidates(k, M)]
    return spark.createDataFrame(rows, "method string, a double, b double, c double, d double")


@query("M21_candidates_by_method", f"""WITH seasons AS (SELECT unnest([1, 12]) AS m), grids AS ({GRIDS}),
every AS (SELECT method, m FROM grids, seasons UNION ALL SELECT 'sarima', m FROM seasons, {ORDERS} AND (m > 1 OR sp + sd + sq = 0)
  UNION ALL SELECT 'ets', m FROM seasons, range(3), range(2) s(s) WHERE m > 1 OR s = 0
  UNION ALL SELECT method, m FROM seasons, (SELECT unnest(['naive_1', 'seasonal_naive', 'drift', 'theta']) AS method))
SELECT method, m, count(*) AS n FROM every GROUP BY 1, 2""")
def candidates_by_method(spark, d):
    rows = [(k, m, len(forecasters.candidates(k, m))) for k in design.BASELINES for m in (1, M)]
    return spark.createDataFrame(rows, "method string, m int, n bigint")


# -- parameters and lists -------------------------------------------------------------------------------------------------


@query("X05_parameters", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN least(5, p) ELSE p END AS particles FROM (SELECT *, coalesce(nullif(c_custkey % 20, 0), nullif(c_nationkey, 0), 12) AS p FROM customer)")
def parameters(spark, d):
    """Requested, else configured, else default; quick runs are capped."""
    quick = F.col("c_mktsegment") == "BUILDING"
    value = rules.resolved(F.nullif(F.col("c_custkey") % 20, F.lit(0)), F.nullif("c_nationkey", F.lit(0)), 12, quick)
    return read(spark, d, "customer").select("c_custkey", value.alias("particles"))


LISTS = [(" Naive , drift,absent", 12), ("persistence,naive_1,SEASONAL_NAIVE", 12), ("seasonal_naive,theta", 1), ("", 1)]


@query("X06_baseline_list", f"""SELECT names, array_to_string(list_sort(list_distinct([y FOR y IN [CASE WHEN lower(trim(x)) IN ('naive', 'persistence') THEN 'naive_1' ELSE lower(trim(x)) END FOR x IN string_split(names, ',')]
IF list_contains([{_texts(design.BASELINES)}], y) AND (y <> 'seasonal_naive' OR period > 1)])), ',') AS methods FROM (VALUES {", ".join(f"('{n}', {p})" for n, p in LISTS)}) t(names, period)""")
def baseline_list(spark, d):
    df = spark.createDataFrame(LISTS, "names string, period int")
    found = rules.method_list(F.col("names"), design.BASELINES, forecasters.ALIASES, F.col("period"))
    return df.select("names", F.concat_ws(",", F.array_sort(found)).alias("methods"))


LEVELS = [0.05, 0.1, 0.15, 0.2]


@query("X17_domain_faults", f"""SELECT generator, CASE generator WHEN 'nonlinear_sine' THEN 24 WHEN 'noisy_seasonal' THEN 12 ELSE 1 END AS period,
CASE WHEN generator = 'unknown' THEN 'generator' WHEN level NOT IN (0.05::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE) THEN 'noise_level' END AS fault, count(*) AS n
FROM (SELECT list_extract([{_texts([*design.GENERATORS, "unknown"])}], 1 + p_partkey % 10) AS generator, list_extract({LEVELS}::DOUBLE[], 1 + p_size % 4) AS level FROM part) GROUP BY ALL""")
def domain_faults(spark, d):
    """Tasks that lie outside the design are named, not repaired."""
    names = F.array(*map(F.lit, [*design.GENERATORS, "unknown"]))
    generator, level = F.element_at(names, (1 + F.col("p_partkey") % 10).cast("int")), F.element_at(F.array(*map(F.lit, LEVELS)), (1 + F.col("p_size") % 4).cast("int"))
    df = read(spark, d, "part").select(generator.alias("generator"), level.alias("level"))
    fault = design.domain_fault(F.col("generator"), F.col("level"))
    return df.groupBy("generator", design.period_of(F.col("generator")).alias("period"), fault.alias("fault")).agg(F.count(F.lit(1)).alias("n"))


SPOILT = "CASE WHEN method = 'drift' AND rule = 'f70' THEN NULL WHEN method = 'naive_1' AND rule = 'f85' THEN -mase WHEN method = 'drift' AND rule = 'f85' THEN CAST('Infinity' AS DOUBLE) ELSE mase END"


@query("X18_score_faults", f"{S}, spoilt AS (SELECT *, {SPOILT} AS v FROM scores) SELECT CASE WHEN v IS NULL THEN 'missing' WHEN isinf(v) THEN 'not finite' WHEN v < 0 THEN 'negative' END AS fault, count(*) AS n, min(family || ' | ' || series || ' | ' || rule || ' | ' || method) AS first_key FROM spoilt GROUP BY 1")
def score_faults(spark, d):
    """Records that break a rule, with the least of their condition keys."""
    spoilt = scores(spark, d).withColumn("v", F.expr(SPOILT))
    key = rules.row_key(*(F.col(c) for c in (*CONDITION, "method")))
    return spoilt.groupBy(checks.score_fault(F.col("v")).alias("fault")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"))


@query("X20_final_task_ids", f"""WITH units AS (SELECT generator, dgp_seed, noise, CASE generator WHEN 'nonlinear_sine' THEN 24 WHEN 'noisy_seasonal' THEN 12 ELSE 1 END AS period
  FROM (SELECT unnest([{_texts(design.GENERATORS)}]) AS generator), range(2001, 2021) s(dgp_seed), (SELECT unnest(['0.05', '0.1', '0.2']) AS noise)),
runs AS (SELECT units.*, 'neuro_fuzzy' AS method, CAST(o AS VARCHAR) AS seed FROM units, range(41001, 41006) o(o)
  UNION ALL SELECT units.*, method, 'null' FROM units, (SELECT unnest([{_texts(design.BASELINES)}]) AS method) WHERE method <> 'seasonal_naive' OR period > 1)
SELECT sha256('{{"dgp_seed":' || dgp_seed || ',"domain":"synthetic","generator":"' || generator || '","method":"' || method || '","n_lags":' || least(12, greatest(5, period)) || ',"namespace":"final","noise_level":"' || noise || '","optimizer_seed":' || seed || ',"seasonal_period":' || period || '}}') AS run_id, generator, method FROM runs""")
def final_task_ids(spark, d):
    return design.final_tasks(spark).select("run_id", "generator", "method")


# -- runners ----------------------------------------------------------------------------------------------------------------


@query("Q07_bounded_batches", f"{P} SELECT method, count(DISTINCT series_id) AS n, count(*) AS steps FROM series, (SELECT unnest(['naive_1', 'drift', 'theta']) AS method) WHERE t >= floor(0.8::DOUBLE * n) GROUP BY 1")
def bounded_batches(spark, d):
    """All tasks in batches of a bounded number; a second start finds them done and runs nothing."""
    path, every = _place(spark, "batches"), tasks(spark, d, ["naive_1", "drift", "theta"])
    fitting.in_batches(every, path, M, 6)
    return fitting.in_batches(every, path, M, 6).groupBy("method").agg(F.countDistinct("series_id").alias("n"), F.count(F.lit(1)).alias("steps"))


@query("Q08_fail_fast")
def fail_fast(spark, d):
    """No batch starts after one with a failed task; that one is the last and is whole."""
    done = fitting.in_batches(tasks(spark, d, ["naive_1", "absent"]), _place(spark, "batches"), M, 2)
    return done.groupBy("batch").agg(F.countDistinct("run_id").alias("tasks"), F.max(F.col("status") == "failed").alias("failed"))


@query("Q09_workspace", "WITH r AS (SELECT DISTINCT o_custkey FROM orders) SELECT CASE WHEN c_custkey IS NULL THEN 'orphan' WHEN o_custkey IS NULL THEN 'missing' ELSE 'matched' END AS state, count(*) AS n FROM customer FULL JOIN r ON c_custkey = o_custkey GROUP BY 1")
def workspace(spark, d):
    """A frozen manifest, verified as it's read, against the results that are there."""
    path = _place(spark, "workspace")
    files.write_manifest(read(spark, d, "customer").select(F.col("c_custkey").alias("run_id")), f"{path}/manifest")
    files.write_batch(read(spark, d, "orders").select(F.col("o_custkey").alias("run_id")).distinct(), f"{path}/results", 0)
    state = design.reconcile(files.read_manifest(spark, f"{path}/manifest"), spark.read.parquet(f"{path}/results"))
    return state.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


FINAL = ("mae", "rmse", "mase", "smape", "rmsse")


@query("Q16_baselines_runner", f"{S} SELECT series AS series_id, method, {', '.join(f'round({c}, 6) AS {c}' for c in FINAL)} FROM scores WHERE family = 'priority' AND rule = 'f80'")
def baselines_runner(spark, d):
    """The fitted path of the simple methods, a task a series, gives what their window expressions give."""
    done = _scored(spark, d, ["naive_1", "seasonal_naive", "drift"])
    return done.select("series_id", "method", *(F.round(c, 6).alias(c) for c in FINAL))


@query("Q22_fcm_experiment")
def fcm_experiment(spark, d):
    done = fitting.predictions(tasks(spark, d, ["FCM"]), M).filter("status = 'success'")
    scale = metrics.scales(priority_monthly(spark, d), M, F.col("t") < F.floor(F.col("n") * 0.8))
    return metrics.short_series(done.join(scale, "series_id"), "series_id")


@query("R08_expanding_refit", f"""{P}, w AS (SELECT series_id, t, y, CAST(round_even(n * 0.85::DOUBLE, 0) AS INTEGER) AS start, lag(y, 1) OVER q AS naive_1, lag(y, 12) OVER q AS seasonal_naive,
  lag(y, 1) OVER q + (lag(y, 1) OVER q - first_value(y) OVER q) / greatest(t - 1, 1) AS drift FROM series WINDOW q AS (PARTITION BY series_id ORDER BY t))
SELECT series_id, method, t, round(y, 6) AS actual, round(predicted, 6) AS predicted, 0 AS failed_steps FROM w UNPIVOT (predicted FOR method IN (naive_1, seasonal_naive, drift)) WHERE t >= start""")
def expanding_refit(spark, d):
    """A new fit before each step: the simple methods, whose fits are known in closed form."""
    done = fitting.refit(priority_monthly(spark, d), ["naive_1", "seasonal_naive", "drift"], M)
    return done.withColumn("actual", F.round("actual", 6)).withColumn("predicted", F.round("predicted", 6))


# -- models -------------------------------------------------------------------------------------------------------------------


def _rolled(series_id: str, y: np.ndarray) -> pd.DataFrame:
    train, lags = _train(y), forecasters.lags_for(M)
    test = y[len(train) :]
    fitted = {"PC": neurofuzzy.fit(train, lags), "NF_BASE": neurofuzzy.fit(train, lags, variant="NF_BASE"), "DYNAMIC": neurofuzzy.fit_dynamic(train, lags), "FCM": neurofuzzy.fit_fcm(train)}
    rows = [(series_id, k, len(test), bool(np.allclose(f.forecast(test), neurofuzzy.step_by_step(f, test), rtol=1e-9))) for k, f in fitted.items()]
    return pd.DataFrame(rows, columns=["series_id", "method", "steps", "equal"])


@query("R07_rolling_rules", f"{P} SELECT series_id, method, count(*)::INTEGER AS steps, true AS equal FROM series, (SELECT unnest(['PC', 'NF_BASE', 'DYNAMIC', 'FCM']) AS method) WHERE t >= n * 4 // 5 GROUP BY 1, 2")
def rolling_rules(spark, d):
    """Predict, then observe with a buffer of lags: as the whole test part at once."""
    return _map_series(priority_monthly(spark, d), _rolled, "series_id string, method string, steps int, equal boolean")


def _stages(series_id: str, y: np.ndarray) -> pd.DataFrame:
    train, lags = _train(y), forecasters.lags_for(M)
    near, _, low, high = neurofuzzy.prepare(train, lags)
    parts = [(series_id, stage, k, low, high, c, s, b) for stage, model in (("initial", fuzzy.initial(*near, 1.0)), ("final", neurofuzzy.fit(train, lags).model)) for k, (c, s, b) in enumerate(zip(model.center, model.sigma, model.coef, strict=True))]
    return pd.DataFrame(parts, columns=["series_id", "stage", "rule", "low", "high", "center", "sigma", "coef"])


@query("A19_model_sink")
def model_sink(spark, d):
    """The rules a fit starts from and those it ends with, and its scaler, a row a rule; written once and read again."""
    path = _place(spark, "model")
    schema = "series_id string, stage string, rule int, low double, high double, center array<double>, sigma array<double>, coef array<double>"
    files.write_once(_map_series(priority_monthly(spark, d), _stages, schema), path)
    return spark.read.parquet(path)


@query("M24_given_rules", f"{FIRED}, o AS ({K06}), b AS (SELECT series_id, min(y) AS low, max(y) AS high FROM series GROUP BY 1) SELECT series_id, t, round(low + predicted * (high - low), 6) AS predicted, round(y, 6) AS actual FROM o JOIN b USING (series_id) JOIN series USING (series_id, t) WHERE t >= floor(0.8::DOUBLE * n)")
def given_rules(spark, d):
    """Test forecasts of given rules on the unit scale, put back on the series' own: no fit, so that SQL can follow."""
    s = priority_monthly(spark, d)
    bounds = s.groupBy("series_id").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    test = s.filter(F.col("t") >= F.floor(F.col("n") * 0.8)).select("series_id", "t", "y")
    out = rule_outputs(spark, d).join(test, ["series_id", "t"]).join(bounds, "series_id")
    return out.select("series_id", "t", F.round(F.col("low") + F.col("predicted") * (F.col("high") - F.col("low")), 6).alias("predicted"), F.round("y", 6).alias("actual"))


GIVEN = fuzzy.Tsk(np.array([[0.2] * 3, [0.8] * 3]), np.array([[0.3] * 3, [0.4] * 3]), np.array([[0.5, 0.2, 0.1, 0.05], [0.1, 0.2, 0.5, 0.1]]))
WHOLE = K06.replace("round(sum(", "(sum(").replace(", 8) AS predicted", ") AS predicted")


@query("R07_given_rules", f"{FIRED}, o AS ({WHOLE}), b AS (SELECT series_id, min(y) AS low, max(y) AS high FROM series GROUP BY 1) SELECT series_id, t, round(low + predicted * (high - low), 6) AS predicted, round(y, 6) AS actual FROM o JOIN b USING (series_id) JOIN series USING (series_id, t) WHERE t >= floor(0.8::DOUBLE * n)")
def rolled_given_rules(spark, d):
    """Predict, then observe with a buffer of lags, by given rules on the unit scale: what SQL gets from whole rows."""

    def each(series_id: str, y: np.ndarray) -> pd.DataFrame:
        n, span = len(_train(y)), float(np.ptp(y))
        low = float(y.min()) + neurofuzzy.LOW * span
        fitted = neurofuzzy.Fitted(GIVEN, low, low + (neurofuzzy.HIGH - neurofuzzy.LOW) * span, 3, y[n - 3 : n])
        return pd.DataFrame({"series_id": series_id, "t": np.arange(n, len(y)), "predicted": neurofuzzy.step_by_step(fitted, y[n:]).round(6), "actual": y[n:].round(6)})

    return _map_series(priority_monthly(spark, d), each, "series_id string, t int, predicted double, actual double")


@query("O07_logistic_orbits", "WITH RECURSIVE o(start, t, x) AS (SELECT k::DOUBLE / 10, 0, k::DOUBLE / 10 FROM range(1, 10) r(k) UNION ALL SELECT start, t + 1, 4.0::DOUBLE * x * (1.0::DOUBLE - x) FROM o WHERE t < 679) SELECT start, CAST(t - 500 AS INTEGER) AS t, round(x, 8) AS y FROM o WHERE t >= 500")
def logistic_orbits(spark, d):
    """The logistic map from given starts."""

    def run(batches):
        for batch in batches:
            for start in batch["start"]:
                y = generators.logistic_orbit(start)
                yield pd.DataFrame({"start": start, "t": np.arange(len(y), dtype=np.int32), "y": y})

    starts = spark.range(1, 10).select((F.col("id") / 10).alias("start"))
    return starts.mapInPandas(run, "start double, t int, y double").withColumn("y", r8("y"))
