"""Experiment designs as DataFrames: candidate grids, task manifests with stable keys, pending and completed tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the protocol.
RADII = [0.25, 0.35, 0.55, 0.75, 1.0]
ALPHAS = [1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 0.05, 0.1]
GENERATORS = ["linear_ar", "nonlinear_sine", "regime_switching", "spiky_outbreak", "noisy_seasonal", "short_memory", "logistic_map", "henon_map", "lorenz63"]
PERIODS = {"nonlinear_sine": 24, "noisy_seasonal": 12}
NOISE_LEVELS = [0.05, 0.10, 0.20]
DEVELOPMENT_SEEDS = list(range(1001, 1011))
FINAL_SEEDS = list(range(2001, 2021))
DEVELOPMENT_OPTIMIZER_SEEDS = [31001, 31002, 31003]
FINAL_OPTIMIZER_SEEDS = [41001, 41002, 41003, 41004, 41005]
BASELINES = ["naive_1", "seasonal_naive", "drift", "theta", "sarima", "ets", "ridge", "svr_rbf", "xgboost"]


def values(spark: SparkSession, name: str, of: list, kind: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in of], f"{name} {kind}")


def product(*parts: DataFrame) -> DataFrame:
    """All combinations of small tables of factors."""
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


def shortest(c: Column) -> Column:
    """A double as the shortest text that reads back the same, with an exponent of two digits under 0.0001 only."""
    text = c.cast("string")
    parts = F.split(text, "E")
    tiny = F.concat(F.regexp_replace(parts[0], r"\.0$", ""), F.lit("e-"), F.lpad(F.regexp_replace(parts[1], "-", ""), 2, "0"))
    plain = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when(text.contains("E-") & (F.abs(c) < 1e-4), tiny).when(text.contains("E"), plain).otherwise(text)


def run_id(df: DataFrame, *cols: str, namespace: str) -> Column:
    """SHA-256 of the row as JSON with sorted keys and no spaces; numbers with a fraction go in as their shortest text.

    ``namespace`` tells the ids of different designs apart.
    """
    kinds = dict(df.dtypes)
    fields = {c: shortest(F.col(c)) if kinds[c] == "double" else F.col(c) for c in cols} | {"namespace": F.lit(namespace)}
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def candidate_grid(spark: SparkSession) -> DataFrame:
    return product(values(spark, "radius", RADII, "double"), values(spark, "alpha", ALPHAS, "double"))


def development_tasks(spark: SparkSession, namespace: str = "development") -> DataFrame:
    """28,350 tasks: generators x seeds x noise x candidate pairs x optimizer seeds."""
    cols = ["generator", "dgp_seed", "noise_level", "optimizer_seed", "radius", "alpha"]
    tasks = product(
        values(spark, "generator", GENERATORS, "string"),
        values(spark, "dgp_seed", DEVELOPMENT_SEEDS, "int"),
        values(spark, "noise_level", NOISE_LEVELS, "double"),
        candidate_grid(spark),
        values(spark, "optimizer_seed", DEVELOPMENT_OPTIMIZER_SEEDS, "int"),
    )
    return tasks.select(run_id(tasks, *cols, namespace=namespace).alias("run_id"), *cols)


def period_of(generator: Column) -> Column:
    """Seasonal period of a generator, 1 without one."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in PERIODS.items() for x in kv))[generator], F.lit(1))


def domain_fault(generator: Column, noise_level: Column) -> Column:
    """Which part of a task lies outside the design: 'generator', 'noise_level' or null."""
    return F.when(~F.coalesce(generator.isin(GENERATORS), F.lit(False)), "generator").when(~F.coalesce(noise_level.isin(NOISE_LEVELS), F.lit(False)), "noise_level")


def final_tasks(spark: SparkSession, real: DataFrame | None = None, namespace: str = "final") -> DataFrame:
    """Synthetic tasks (7,140) and, with a table of real series (source, frequency, series_id, seasonal_period), theirs.

    The neuro-fuzzy method has a task for each optimizer seed, baselines one each; seasonal naive needs a season.
    """
    synthetic = product(values(spark, "generator", GENERATORS, "string"), values(spark, "dgp_seed", FINAL_SEEDS, "int"), values(spark, "noise_level", NOISE_LEVELS, "double"))
    synthetic = synthetic.withColumn("seasonal_period", period_of(F.col("generator"))).withColumn("domain", F.lit("synthetic"))
    units = synthetic if real is None else synthetic.unionByName(real.withColumn("domain", F.lit("real")), allowMissingColumns=True)
    pc = units.crossJoin(F.broadcast(values(spark, "optimizer_seed", FINAL_OPTIMIZER_SEEDS, "int"))).withColumn("method", F.lit("neuro_fuzzy"))
    base = units.crossJoin(F.broadcast(values(spark, "method", BASELINES, "string"))).filter("method <> 'seasonal_naive' OR seasonal_period > 1")
    tasks = pc.unionByName(base, allowMissingColumns=True).withColumn("n_lags", F.least(F.lit(12), F.greatest(F.lit(5), "seasonal_period")))
    return tasks.select(run_id(tasks, *tasks.columns, namespace=namespace).alias("run_id"), *tasks.columns)


def pending(tasks: DataFrame, results: DataFrame, key: str = "run_id") -> DataFrame:
    return tasks.join(results.select(key), key, "left_anti")


def completed(tasks: DataFrame, results: DataFrame, key: str = "run_id") -> DataFrame:
    return tasks.join(results.select(key), key, "left_semi")


def reconcile(tasks: DataFrame, results: DataFrame, key: str = "run_id") -> DataFrame:
    """key, state: 'matched', 'missing' (no result) or 'orphan' (no task)."""
    t, r = tasks.select(key).distinct().withColumn("_t", F.lit(1)), results.select(key).distinct().withColumn("_r", F.lit(1))
    return t.join(r, key, "full").select(key, F.when(F.col("_r").isNull(), "missing").when(F.col("_t").isNull(), "orphan").otherwise("matched").alias("state"))
