"""Forecast errors by group, in three definitions that differ on purpose. One aggregation each.

Input rows have ``actual``, ``predicted`` and, for the scaled errors, a constant ``scale`` (mean absolute season step of
the training part) and ``scale_sq`` (mean squared one) in each group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def scales(series: DataFrame, m: int, train: Column) -> DataFrame:
    """series_id, scale, scale_sq from the rows of ``train``."""
    from tidemark.operators.naive import season_step

    d = series.withColumn("_d", season_step(m)).filter(train & F.col("_d").isNotNull())
    return d.groupBy("series_id").agg(F.avg(F.abs("_d")).alias("scale"), F.avg(F.col("_d") * F.col("_d")).alias("scale_sq"))


def _error() -> Column:
    return F.col("actual") - F.col("predicted")


def core(df: DataFrame, *keys: str) -> DataFrame:
    """mse, rmse, mae, mape, smape, r2, pearson_r, error_mean, error_std, mase; denominators are kept from 0 by EPS."""
    e, a, p = _error(), F.col("actual"), F.col("predicted")
    total = F.var_pop(a) * F.count(a)
    return df.groupBy(*keys).agg(
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(F.when(F.abs(a) > EPS, F.abs(e / a))).alias("mape"),
        F.avg(2 * F.abs(e) / (F.abs(a) + F.abs(p) + EPS)).alias("smape"),
        F.when(total > EPS, 1 - F.sum(e * e) / total).alias("r2"),
        F.corr(a, p).alias("pearson_r"),
        F.avg(e).alias("error_mean"),
        F.coalesce(F.stddev_samp(e), F.lit(0.0)).alias("error_std"),
        (F.avg(F.abs(e)) / F.greatest(F.max("scale"), F.lit(EPS))).alias("mase"),
    )


def rolling(df: DataFrame, *keys: str) -> DataFrame:
    """As ``core`` without the correlation; undefined terms are skipped, an undefined scale gives null; 3 rows at least."""
    e, a, p = _error(), F.col("actual"), F.col("predicted")
    total = F.var_pop(a) * F.count(a)
    size = F.abs(a) + F.abs(p)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(F.when(F.abs(a) > EPS, F.abs(e / a))).alias("mape"),
        F.avg(F.when(size > EPS, 2 * F.abs(e) / size)).alias("smape"),
        F.when(total > EPS, 1 - F.sum(e * e) / total).alias("r2"),
        F.avg(e).alias("error_mean"),
        F.coalesce(F.stddev_samp(e), F.lit(0.0)).alias("error_std"),
        F.when(F.max("scale") > 0, F.avg(F.abs(e)) / F.max("scale")).alias("mase"),
    )
    return out.filter("n_test >= 3")


def final(df: DataFrame, *keys: str) -> DataFrame:
    """mase, mae, rmse, smape (0 to 200; 0/0 is 0), rmsse and status: 'failed' where a scale is too small or a value isn't finite."""
    e = _error()
    size = F.abs("actual") + F.abs("predicted")
    out = df.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.when(size > 0, 200 * F.abs(e) / size).otherwise(0.0)).alias("smape"),
        F.max("scale").alias("_s"),
        F.max("scale_sq").alias("_q"),
    )
    ok = (F.col("_s") > 1e-12) & (F.col("_q") > 1e-24) & ~F.isnan("mae") & (F.col("rmse") < float("inf"))
    out = out.withColumn("status", F.when(ok, "success").otherwise("failed"))
    mase, rmsse = F.when(ok, F.col("mae") / F.col("_s")), F.when(ok, F.sqrt(F.col("rmse") * F.col("rmse") / F.col("_q")))
    return out.withColumn("mase", mase).withColumn("rmsse", rmsse).drop("_s", "_q")


def short_series(df: DataFrame, *keys: str) -> DataFrame:
    """mae, rmse and mae over the scale plus EPS."""
    e = _error()
    return df.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(F.abs(e)) / (F.max("scale") + EPS)).alias("mase"))
