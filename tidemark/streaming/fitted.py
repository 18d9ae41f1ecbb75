"""Fitted forecasters as keyed streams: predict, then observe, with the model of a series in the state store.

A model is fitted once in a batch job over the training part; its numbers are the stream's initial state. A micro-batch brings
the next values of any series. For each value the forecast made before it is a row, then the state takes a step; nothing is
fitted again, and no history is kept but the few last values that a model needs. A stopped stream goes on from its checkpoint.

State of a series: ``fixed`` (what the fit gave, written once), ``latent`` (time of the last value, number of values, level,
slope, or mean and covariance of a filter), ``buffer`` (a list: last values, or seasonal figures with the next one first).

Defined results: values that don't come after the last one seen are late: no row, and the state stays. Of values for the same
time in one batch the least counts. A null value gives no row. A series without a fitted model has rows without a forecast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import forecasters
from tidemark.operators.fitting import spread
from tidemark.sources.files import gather
from tidemark.sources.shared import cut, shared_folder

MODEL = "series_id string, last_t bigint, shape array<int>, fixed array<double>, latent array<double>, buffer array<double>"
OUT = "series_id string, t bigint, actual double, predicted double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fitted(series: DataFrame, method: str, m: int, split: float = 0.8) -> DataFrame:
    """A row for each series with what its model keeps after the training part; a series that can't be fitted has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                y = np.asarray(row.y, float)
                n = int(len(y) * split)
                try:
                    shape, fixed, latent, buffer = forecasters.state_of(method, y[:n], m).packed()
                except (ValueError, ArithmeticError, np.linalg.LinAlgError, IndexError):
                    continue
                yield pd.DataFrame({"series_id": [row.series_id], "last_t": [row.ts[n - 1]], "shape": [[int(v) for v in shape]], "fixed": [[float(v) for v in fixed]], "latent": [[float(v) for v in latent]], "buffer": [[float(v) for v in buffer]]})

    times = series.groupBy("series_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    packed = gather(series, "series_id", "t", "y").join(times, "series_id")
    return spread(packed.select("series_id", "y", "ts")).mapInPandas(run, MODEL)


class _Forecasts(StatefulProcessor):
    def __init__(self, method: str):
        self.method = method

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fixed = handle.getValueState("fixed", "shape array<int>, numbers array<double>")
        self.latent = handle.getValueState("latent", "last_t bigint, n bigint, numbers array<double>")
        self.buffer = handle.getListState("buffer", "value double")

    def _keep(self, last_t: int, n: int, latent: list, buffer: list) -> None:
        self.latent.update((last_t, n, [float(v) for v in latent]))
        if len(buffer):  # the store takes no empty list
            self.buffer.put([(float(v),) for v in buffer])

    def handleInitialState(self, key, rows: pd.DataFrame, timers) -> None:
        row = rows.iloc[0]
        self.fixed.update(([int(v) for v in row["shape"]], [float(v) for v in row["fixed"]]))
        self._keep(int(row["last_t"]), 0, row["latent"], row["buffer"])

    def handleInputRows(self, key, batches: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).dropna(subset=["t", "y"]).sort_values(["t", "y"])
        last_t, n, numbers = self.latent.get() if self.latent.exists() else (None, 0, [])
        model = None
        if self.fixed.exists():
            shape, fixed = self.fixed.get()
            model = forecasters.STATES[self.method].of(list(shape), list(fixed), list(numbers), [v[0] for v in self.buffer.get()] if self.buffer.exists() else [])
        out = []
        for t, y in zip(rows["t"].tolist(), rows["y"].tolist(), strict=True):
            if last_t is not None and t <= last_t:
                continue
            out.append((key[0], t, y, model.forecast() if model else None))
            if model:
                model.observe(y)
            last_t, n = t, n + 1
        if out:
            _, _, latent, buffer = model.packed() if model else ([], [], [], [])
            self._keep(last_t, n, latent, buffer)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def forecast_stream(stream: DataFrame, models: DataFrame, method: str) -> DataFrame:
    """series_id, t, y (a stream) and fitted models -> each value with the forecast made before it was seen."""
    return stream.groupBy("series_id").transformWithStateInPandas(_Forecasts(method), OUT, "Append", "None", models.groupBy("series_id"))


@contextmanager
def state_store(spark: SparkSession):
    """The state store that typed states need, for streams started inside; the session's own setting comes back after."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def start(stream: DataFrame, models: DataFrame, method: str, at: str, once: bool = True):
    """Start (or go on with) the stream into ``at``/out, with its checkpoint in ``at``/state. ``once``: end when all is read."""
    with state_store(stream.sparkSession):
        writer = forecast_stream(stream, models, method).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="0 seconds")).start()


def over(series: DataFrame, method: str, m: int, split: float = 0.8, steps: int = 3) -> DataFrame:
    """series_id, t, y -> rows of the test part with the forecasts of a stream over it (an empty table gives no rows).

    The test part is written in ``steps`` ranges of t, one after another; the stream takes files in the order they were written.
    """
    spark = series.sparkSession
    at = f"{shared_folder(spark)}/fitted-{uuid.uuid4().hex}"
    source = cut(series.select("series_id", F.col("t").cast("bigint").alias("t"), F.col("y").cast("double").alias("y")))
    models = cut(fitted(source, method, m, split))
    test = cut(source.join(models.select("series_id", "last_t"), "series_id").filter("t > last_t").drop("last_t"))
    low, high = test.selectExpr("coalesce(min(t), 0)", "coalesce(max(t), 0) + 1").first()
    for k in range(steps):
        part = test.filter((test.t >= low + k * (high - low) / steps) & (test.t < low + (k + 1) * (high - low) / steps))
        part.repartition("series_id").write.mode("append").parquet(f"{at}/in")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stream = spark.readStream.schema(test.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in")
    start(stream, models, method, at).awaitTermination()
    return spark.read.schema(OUT).parquet(f"{at}/out")
