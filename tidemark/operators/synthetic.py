"""Synthetic panels: a row of factors gives a series. Generation is a table function, spread over rows.

Series are dealt to tasks of a bounded number of values, and made and handed on in batches of bounded size, so that neither a
task's memory nor its time grows with the number of series; the longest series bounds both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import generators

#: Values (about) of a task, of the series made together in it, and of an Arrow batch handed on.
TASK, TOGETHER, BATCH = 1 << 21, 1 << 20, 1 << 16
#: Fewer series (about) than these aren't worth a task of their own: steps are taken for all series of a task at once.
LEAST = 64


def _dealt(factors: DataFrame, values: int) -> DataFrame:
    """Factors over tasks by generator and seed, so that the levels of a series meet and its clean form is made once.
    ``values``: of each row. Tasks are as many as shuffle partitions, fewer for few rows, and more where they would grow too long."""
    rows = factors.count()
    most = int(factors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(most, -(-rows // LEAST)), -(-rows * values // TASK))
    # By number: a partitioning by the columns themselves is left out after a shuffle by them, whose partitions are put together by size.
    place = F.pmod(F.xxhash64("generator", "seed"), F.lit(tasks)).cast("int")
    return factors.withColumn("_task", place).repartitionById(tasks, "_task").drop("_task")


def _together(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Factors of one generator, ordered by seed, with their clean series (rows)."""
    step = max(1, TOGETHER // max(1, length))
    for batch in batches:
        rows = batch.to_pandas()
        for name in rows["generator"].unique():
            own = rows[rows["generator"] == name].sort_values("seed", kind="stable")
            for at in range(0, len(own), step):
                part = own.iloc[at : at + step]
                seeds, place = np.unique(part["seed"].to_numpy(), return_inverse=True)
                yield part, generators.clean_many(name, seeds, length)[place]


def _handed(part: pd.DataFrame, length: int) -> Iterator[tuple[slice, np.ndarray, pd.DataFrame]]:
    """Some series at a time: where they are in ``part``, the place of each of their values' series among them, their factors."""
    step = max(1, BATCH // max(1, length))
    for at in range(0, len(part), step):
        some = part.iloc[at : at + step]
        yield slice(at, at + step), np.repeat(np.arange(len(some)), length), some


def panel(factors: DataFrame, length: int = generators.LENGTH) -> DataFrame:
    """generator, seed, noise_level (one row a series) -> long rows with panel_id, t, clean, y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, clean in _together(batches, length):
            for at, series, some in _handed(part, length):
                name = part["generator"].iloc[0]
                y = generators.observed_many(name, clean[at], some["seed"], some["noise_level"])
                names = pa.array([f"{name}_n{length}_noise{level:g}_seed{seed}" for seed, level in zip(some["seed"], some["noise_level"])])
                columns = {
                    "panel_id": names.take(pa.array(series)), "generator": pa.repeat(name, len(series)), "seed": pa.array(some["seed"].to_numpy(np.int32)[series]),
                    "noise_level": pa.array(some["noise_level"].to_numpy()[series]), "t": pa.array(np.tile(np.arange(length, dtype=np.int32), len(some))),
                    "clean": pa.array(clean[at].ravel()), "y": pa.array(y.ravel()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    dealt = _dealt(factors.select("generator", "seed", "noise_level"), length)
    return dealt.mapInArrow(run, "panel_id string, generator string, seed int, noise_level double, t int, clean double, y double")


def bundle(factors: DataFrame, levels: list[float], length: int = generators.LENGTH) -> DataFrame:
    """generator, seed (one row a series) -> long rows with t, clean and an array y: the series at each of ``levels``, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, clean in _together(batches, length):
            for at, series, some in _handed(part, length):
                name = part["generator"].iloc[0]
                ys = np.stack([generators.observed_many(name, clean[at], some["seed"], [level] * len(some)) for level in levels], axis=-1)
                offsets = pa.array(np.arange(len(series) + 1, dtype=np.int32) * np.int32(len(levels)))
                columns = {
                    "generator": pa.repeat(name, len(series)), "seed": pa.array(some["seed"].to_numpy(np.int32)[series]), "t": pa.array(np.tile(np.arange(length, dtype=np.int32), len(some))),
                    "clean": pa.array(clean[at].ravel()), "y": pa.ListArray.from_arrays(offsets, pa.array(ys.ravel())),
                }
                yield pa.RecordBatch.from_pydict(columns)

    dealt = _dealt(factors.select("generator", "seed"), length * len(levels))
    return dealt.mapInArrow(run, "generator string, seed int, t int, clean double, y array<double>")


def sine(t: Column) -> Column:
    """The sine series at t as an expression."""
    s = F.sin(2 * F.pi() * t / 24)
    return 10 * s + 3.5 * s * s + 0.03 * t


def seasonal(t: Column) -> Column:
    """The seasonal series at t as an expression."""
    a = 2 * F.pi() * t / 12
    return 50 + 0.04 * t + 8 * F.sin(a) + 2.8 * F.cos(2 * a)
