"""Streams of fitted forecasters: stopped half way and started again, they equal the fold over arrays."""

import time

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import forecasters
from tidemark.streaming import fitted


def values(n_series, n, m, seed=0):
    rng = np.random.default_rng(seed)
    y = 20 + rng.normal(size=(n_series, n)).cumsum(1) + 3 * np.sin(np.arange(n) * 2 * np.pi / m) + rng.normal(size=(n_series, n))
    return {f"s{k:04d}": y[k] for k in range(n_series)}


def fold(series, method, m, n_train):
    out = {}
    for key, y in series.items():
        model = forecasters.METHODS[method](y[:n_train], m)
        for t in range(n_train, len(y)):
            out[key, t] = float(model.forecast())
            model.observe(float(y[t]))
    return out


def frame(spark, series, first=0, last=None):
    rows = pd.DataFrame([(k, t, float(v)) for k, y in series.items() for t, v in enumerate(y) if t >= first and (last is None or t < last)], columns=["series_id", "t", "y"])
    return spark.createDataFrame(rows, "series_id string, t bigint, y double")


@pytest.mark.parametrize("method, n_series, m", [("theta", 1000, 4), ("ridge", 1000, 1), ("ets", 12, 4), ("sarima", 6, 4), ("arima_110", 40, 1), ("seasonal_naive", 50, 4), ("drift", 50, 1)])
def test_a_stopped_stream_goes_on_and_equals_the_fold(spark, tmp_path, method, n_series, m):
    n, n_train = 60, 48
    series = values(n_series, n, m)
    models = fitted.fitted(frame(spark, series), method, m).checkpoint()
    assert models.count() == n_series
    at = str(tmp_path)
    for t in range(n_train, n, 3):
        frame(spark, series, t, t + 3).repartition(2, "series_id").write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema("series_id string, t bigint, y double").option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    query = fitted.start(stream, models, method, at, once=False)
    until = time.time() + 60
    while (query.lastProgress is None or query.lastProgress["batchId"] < 1) and time.time() < until and query.isActive:
        time.sleep(0.1)
    query.stop()
    before = spark.read.schema(fitted.OUT).parquet(f"{at}/out").count()
    assert before > 0
    fitted.start(stream, models, method, at).awaitTermination()
    got = {(r["series_id"], r["t"]): r["predicted"] for r in spark.read.schema(fitted.OUT).parquet(f"{at}/out").collect()}
    want = fold(series, method, m, n_train)
    assert got.keys() == want.keys()
    assert np.allclose([got[k] for k in want], list(want.values()), rtol=1e-9, atol=1e-9)


def test_late_repeated_and_missing_values(spark, tmp_path):
    """Late values and nulls give no row; of values for one time the least counts; a series without a model has no forecast."""
    at = str(tmp_path)
    models = spark.createDataFrame([("a", 9, [], [1.5], [10.0], [])], fitted.MODEL)
    schema = "series_id string, t bigint, y double"
    batches = [[("a", 10, 12.0), ("a", 8, 99.0), ("b", 1, 1.0)], [("a", 12, 14.0), ("a", 12, 13.0), ("a", 11, None)], [("a", 12, 50.0), ("a", 13, 1.0), ("b", 2, 2.0)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    before = spark.conf.get(fitted.PROVIDER)
    fitted.start(stream, models, "drift", at).awaitTermination()
    assert spark.conf.get(fitted.PROVIDER) == before
    got = sorted(map(tuple, spark.read.schema(fitted.OUT).parquet(f"{at}/out").collect()))
    assert got == [("a", 10, 12.0, 11.5), ("a", 12, 13.0, 13.5), ("a", 13, 1.0, 14.5), ("b", 1, 1.0, None), ("b", 2, 2.0, None)]


@pytest.mark.parametrize("method", sorted(forecasters.STATES))
def test_packed_models_come_back_whole(method):
    y = values(1, 70, 4, seed=3)["s0000"]
    model = forecasters.state_of(method, y[:50], 4)
    for t in range(50, 70):
        again = forecasters.STATES[method].of(*model.packed())
        assert again.forecast() == pytest.approx(model.forecast(), rel=1e-12)
        again.observe(float(y[t]))
        model.observe(float(y[t]))
        assert again.forecast() == pytest.approx(model.forecast(), rel=1e-12)


def test_no_series(spark):
    empty = spark.createDataFrame([], "series_id string, t bigint, y double")
    assert fitted.over(empty, "theta", 4).count() == 0
