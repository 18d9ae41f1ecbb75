"""Eligibility of series, preparation of pre-test data, choice by hash, and choice of parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.operators import metrics, shaping


def eligibility(series: DataFrame, m: int, low: int = 40, high: int = 180, least_test: int = 8, least_rows: int = 20) -> DataFrame:
    """series_id, n, split_index, scale, eligible_reason: the first rule that a series fails, or 'eligible'."""
    split = rules.floor_split(F.col("n"))
    lags = min(12, max(5, m))
    scale = metrics.scales(series, m, F.col("t") < split)
    facts = series.groupBy("series_id").agg(F.max("n").alias("n")).withColumn("split_index", split).join(scale, "series_id", "left")
    reason = F.when(~F.col("n").between(low, high), "length").when(F.col("n") - F.col("split_index") < least_test, "test_size")
    reason = reason.when(F.col("split_index") - lags < least_rows, "supervised_rows").when(F.col("scale").isNull() | (F.col("scale") <= rules.TINY), "scale").otherwise("eligible")
    return facts.withColumn("eligible_reason", reason)


def pretest(series: DataFrame, split: Column, lags: int) -> DataFrame:
    """Supervised pre-test rows: scaled by the fit part alone (its lags included), with part 'fit' or 'validation'."""
    s = series.withColumn("split", split)
    s = s.withColumn("fit_end", F.col("split") - rules.tail_size(F.col("split"), F.lit(lags)))
    scaled = shaping.min_max(s, F.col("t") < F.col("fit_end"))
    return scaled.filter((F.col("t") >= lags) & (F.col("t") < F.col("split"))).withColumn("part", F.when(F.col("t") < F.col("fit_end"), "fit").otherwise("validation"))


def by_hash(df: DataFrame, strata: list[str], key: list[str], first: int, second: int) -> DataFrame:
    """The first ``first`` of each stratum by SHA-256 of the key are 'development', the next ``second`` 'final'."""
    ranked = df.withColumn("rank_sha256", rules.key_hash(*(F.col(k).cast("string") for k in key)))
    number = F.row_number().over(Window.partitionBy(*strata).orderBy("rank_sha256", *key))
    ranked = ranked.withColumn("rn", number).filter(F.col("rn") <= first + second)
    return ranked.withColumn("partition", F.when(F.col("rn") <= first, "development").otherwise("final"))


def two_level_median(scores: DataFrame, condition: list[str], pair: list[str], value: str) -> DataFrame:
    """Median over replicates within a condition, then over conditions, for each parameter pair."""
    inner = scores.groupBy(*condition, *pair).agg(F.median(value).alias("_m"))
    return inner.groupBy(*pair).agg(F.median("_m").alias("statistic"), F.count(F.lit(1)).alias("n_conditions"))


def best_pair(summary: DataFrame) -> DataFrame:
    """Smallest statistic; of ties the larger radius, then the larger alpha."""
    return summary.orderBy("statistic", F.desc("radius"), F.desc("alpha")).limit(1)


def covered(scores: DataFrame, condition: list[str], pair: list[str]) -> bool:
    """Whether every pair has every condition."""
    full = scores.select(*condition).distinct().crossJoin(scores.select(*pair).distinct())
    return full.join(scores.select(*condition, *pair).distinct(), [*condition, *pair], "left_anti").isEmpty()


def estimable(scores: DataFrame, unit: list[str], level: str, value: str, replicates: int, levels: int) -> DataFrame:
    """Median over replicates, then mean over levels; only units with all replicates of all levels."""
    inner = scores.groupBy(*unit, level).agg(F.median(value).alias("_m"), F.count(value).alias("_c")).filter(F.col("_c") == replicates)
    out = inner.groupBy(*unit).agg(F.avg("_m").alias("value"), F.count(F.lit(1)).alias("_levels"))
    return out.filter(F.col("_levels") == levels).drop("_levels")
