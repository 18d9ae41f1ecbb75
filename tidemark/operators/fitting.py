"""Fitting of many series: one task row is a series and a method (and a seed), and Spark spreads the rows.

A series arrives packed as one array, so that a task needs one row of it; the longest series bounds a task's memory, not
the number of series. Failures become rows with a status. Results are written as batches, and pending tasks are an anti-join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import forecasters, neurofuzzy
from tidemark.operators.packing import cost, packed, to_and_fro
from tidemark.sources.files import exists, gather, remove, write_batch
from tidemark.sources.shared import cut, shared_folder

PREDICTIONS = "series_id string, method string, seed int, t int, actual double, predicted double, status string, failure string, objective double, n_rules int"
NEURO = tuple(neurofuzzy.VARIANTS) + ("DYNAMIC", "FCM", "HYBRID")


def tasks(series: DataFrame, methods: list[str], seeds: list[int] | None = None, split: float = 0.8) -> DataFrame:
    """A row for each series, method and (for the neuro-fuzzy ones) seed: series_id, y, n_train, method, seed."""
    spark = series.sparkSession
    packed = gather(series, "series_id", "t", "y").withColumn("n_train", F.floor(F.size("y") * F.lit(split)).cast("int"))
    rows = [(m, s) for m in methods for s in (seeds or [0] if m in NEURO and m not in ("NF_BASE", "FCM") else [0])]
    return packed.crossJoin(F.broadcast(spark.createDataFrame(rows, "method string, seed int")))


def spread(work: DataFrame) -> DataFrame:
    """Rows dealt out in turn over the cluster. Each is long work on little data: with a number of partitions given, adaptive
    execution doesn't put them together by their size."""
    return work.repartition(int(work.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _spread(work: DataFrame) -> DataFrame:
    return spread(work.select("series_id", "y", "n_train", "method", "seed"))


def predict_one(y: np.ndarray, n_train: int, method: str, seed: int, m: int, budget: dict) -> tuple[np.ndarray, str, str | None, float, int]:
    train, test = y[:n_train], y[n_train:]
    if method not in NEURO:
        return *forecasters.run(method, train, test, m), float("nan"), 0
    try:
        lags = forecasters.lags_for(m)
        if method == "HYBRID":
            return neurofuzzy.hybrid(train, test, lags, seed), "success", None, float("nan"), 2
        if method == "FCM":
            got = neurofuzzy.fit_fcm(train)
        elif method == "DYNAMIC":
            got = neurofuzzy.fit_dynamic(train, lags, seed, **budget)
        else:
            got = neurofuzzy.fit(train, lags, seed=seed, variant=method, **budget)
        return got.forecast(test), "success", None, got.objective, len(got.model.center)
    except (ValueError, np.linalg.LinAlgError) as e:
        return np.full(len(test), np.nan), "failed", f"fit: {e}", float("nan"), 0


def balanced(work: DataFrame) -> DataFrame:
    """The tasks in partitions of about equal estimated cost; worth its two small jobs where methods differ and tasks are many."""
    return packed(work, cost("method", F.col("n_train")), ["series_id", "method", "seed"])


def predictions(work: DataFrame, m: int, dealt: bool = False, **budget: int) -> DataFrame:
    """Predictions of all tasks, long; NaN never stands for a value (it becomes null).

    ``dealt``: the rows are in the partitions that they are to stay in (see ``balanced``); else they're dealt out in turn.
    ``budget``: particles and rounds, where they aren't the method's own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for task in batch.itertuples():
                y = np.asarray(task.y, float)
                p, status, failure, objective, rules = predict_one(y, task.n_train, task.method, task.seed, m, budget)
                yield pd.DataFrame(
                    {
                        "series_id": task.series_id, "method": task.method, "seed": task.seed, "t": np.arange(task.n_train, len(y), dtype=np.int32),
                        "actual": y[task.n_train :], "predicted": p, "status": status, "failure": failure, "objective": objective, "n_rules": rules,
                    }
                )

    work = work.select("series_id", "y", "n_train", "method", "seed")
    out = (work if dealt else spread(work)).mapInPandas(run, PREDICTIONS)
    return out.withColumn("predicted", F.nanvl("predicted", F.lit(None))).withColumn("objective", F.nanvl("objective", F.lit(None)))


def in_batches(work: DataFrame, path: str, m: int, size: int, fail_fast: bool = True, **budget: int) -> DataFrame:
    """Predictions of all tasks, in batches of about ``size`` tasks: each is written whole before the next one starts.

    A batch is the tasks with the same remainder of a hash of their key, so that a second start finds the batches of the
    first and goes on after them. With ``fail_fast`` no batch starts after one with a failed task. The rows have run_id.

    Tasks are worked out once; those of the batches that are still to do are written to a table with a folder for each batch,
    placed by cost within it, and a batch reads its own folder only.
    """
    spark = work.sparkSession
    bins = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run_id = F.concat_ws("|", "series_id", "method", "seed")
    every = cut(work)
    parts = max(1, -(-every.count() // size))
    todo = [k for k in range(parts) if not exists(spark, f"{path}/batch={k}/_SUCCESS")]
    at = f"{shared_folder(spark)}/tasks-{uuid.uuid4().hex}"
    if todo:
        marked = every.withColumn("_batch", F.pmod(F.xxhash64(run_id), F.lit(parts)).cast("int")).filter(F.col("_batch").isin(todo))
        place = F.row_number().over(Window.partitionBy("_batch").orderBy(-cost("method", F.col("n_train")), "series_id", "method", "seed")) - 1  # a batch is of bounded size
        marked.withColumn("_bin", to_and_fro(place, bins)).write.partitionBy("_batch").parquet(at)
    schema = every.withColumn("_bin", F.lit(0)).schema
    for k in range(parts):
        if k in todo:
            own = spark.read.schema(schema).parquet(f"{at}/_batch={k}") if exists(spark, f"{at}/_batch={k}") else spark.createDataFrame([], schema)
            write_batch(predictions(own.repartitionById(bins, "_bin"), m, dealt=True, **budget).withColumn("run_id", run_id), path, k)
        if fail_fast and not spark.read.parquet(f"{path}/batch={k}").filter("status = 'failed'").isEmpty():
            break
    remove(spark, at)
    return spark.read.parquet(path)


def refit(series: DataFrame, methods: list[str], m: int) -> DataFrame:
    """Predictions with a new fit before each step from the initial training part on, and the number of steps where the last
    value was taken instead. Series that are too short for such a part have no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for task in batch.itertuples():
                y = np.asarray(task.y, float)
                if (start := forecasters.initial_train(len(y))) is None:
                    continue
                p, failed = forecasters.rolling_refit(task.method, y, start, m)
                yield pd.DataFrame({"series_id": task.series_id, "method": task.method, "t": np.arange(start, len(y), dtype=np.int32), "actual": y[start:], "predicted": p, "failed_steps": failed})

    work = spread(tasks(series, methods).select("series_id", "y", "method"))
    return work.mapInPandas(run, "series_id string, method string, t int, actual double, predicted double, failed_steps int")


def rules(work: DataFrame, m: int, rounds: int = 40) -> DataFrame:
    """Fitted rules, a row each: series_id, method, seed, rule, center, sigma, coef. These rows are a model's stored form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for task in batch.itertuples():
                got = neurofuzzy.fit(np.asarray(task.y, float)[: task.n_train], forecasters.lags_for(m), seed=task.seed, variant=task.method, rounds=rounds)
                model = got.model
                yield pd.DataFrame({"series_id": task.series_id, "method": task.method, "seed": task.seed, "rule": range(len(model.center)), "center": list(model.center), "sigma": list(model.sigma), "coef": list(model.coef), "low": got.low, "high": got.high})

    schema = "series_id string, method string, seed int, rule int, center array<double>, sigma array<double>, coef array<double>, low double, high double"
    return _spread(work).mapInPandas(run, schema)


def history(work: DataFrame, m: int, rounds: int = 40) -> DataFrame:
    """Swarm history of each fit, a row a round."""
    from tidemark.functions.swarm import HISTORY

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for task in batch.itertuples():
                got = neurofuzzy.fit(np.asarray(task.y, float)[: task.n_train], forecasters.lags_for(m), seed=task.seed, variant=task.method, rounds=rounds)
                yield pd.DataFrame(got.history).assign(series_id=task.series_id, method=task.method, seed=task.seed)[["series_id", "method", "seed", "iteration", *HISTORY]]

    schema = "series_id string, method string, seed int, iteration int, " + ", ".join(f"{c} double" for c in HISTORY)
    return _spread(work).mapInPandas(run, schema)


def clusters(rows: DataFrame, radius: float) -> DataFrame:
    """Subtractive clustering of the points (array x) of each series: series_id, center number, potential, center."""
    from tidemark.functions import fuzzy

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("t")["x"].to_numpy())
        at, potential = fuzzy.subtractive(x, radius)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "number": np.arange(len(at), dtype=np.int32), "potential": potential, "center": list(x[at])})

    return rows.select("series_id", "t", "x").groupBy("series_id").applyInPandas(run, "series_id string, number int, potential double, center array<double>")


def fire(rows: DataFrame, rule_rows: DataFrame, key: str = "series_id") -> DataFrame:
    """Rule activations as expressions: for each row (t, x) and rule: log strength, normalised weight, output."""
    z = F.zip_with(F.zip_with("x", "center", lambda a, c: a - c), "sigma", lambda d, s: (d / s) * (d / s))
    strength = -0.5 * F.aggregate(z, F.lit(0.0), lambda a, b: a + b)
    linear = F.aggregate(F.zip_with("x", F.slice("coef", 1, F.size("x")), lambda a, c: a * c), F.lit(0.0), lambda a, b: a + b) + F.element_at("coef", -1)
    fired = rows.join(rule_rows, key).withColumn("log_strength", strength).withColumn("output", linear)
    from pyspark.sql import Window

    w = Window.partitionBy(key, "t")
    top = F.max("log_strength").over(w)
    return fired.withColumn("weight", F.exp(F.col("log_strength") - top) / F.sum(F.exp(F.col("log_strength") - top)).over(w))
