"""Checks of results: rules that a row of predictions breaks, as an array; never repaired, only named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(predictions: DataFrame) -> DataFrame:
    """Per task: n, status, broken (names of broken rules): of success and failure, lengths and missing values."""
    keys = ["series_id", "method", "seed"]
    g = predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.first("status").alias("status"),
        F.countDistinct("status").alias("_states"),
        F.count_if(F.col("predicted").isNull()).alias("_missing"),
        F.max("failure").alias("failure"),
        (F.max("t") - F.min("t") + 1).alias("_span"),
    )
    broken = F.array_compact(
        F.array(
            F.when(F.col("_states") > 1, "more than one status"),
            F.when(~F.col("status").isin("success", "failed"), "unknown status"),
            F.when((F.col("status") == "success") & (F.col("_missing") > 0), "missing values on success"),
            F.when((F.col("status") == "failed") & F.col("failure").isNull(), "no reason on failure"),
            F.when((F.col("status") == "success") & F.col("failure").isNotNull(), "reason on success"),
            F.when(F.col("_span") != F.col("n"), "steps missing or twice"),
        )
    )
    return g.select(*keys, "n", "status", broken.alias("broken"))


def score_fault(score: Column) -> Column:
    """Why a score record can't be used: 'missing', 'not finite', 'negative' or null."""
    finite = ~F.isnan(score) & (F.abs(score) < float("inf"))
    return F.when(score.isNull(), "missing").when(~finite, "not finite").when(score < 0, "negative")


def accepted(predictions: DataFrame) -> DataFrame:
    """The successful predictions, if no rule is broken anywhere."""
    if not violations(predictions).filter(F.size("broken") > 0).isEmpty():
        raise ValueError("results break a rule: see violations")
    return predictions.filter("status = 'success'")
