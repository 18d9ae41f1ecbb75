"""Time-series shaping: long tables (series_id, t, y) in, long tables out. Every window is partitioned by series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(key: str = "series_id", t: str = "t"):
    return Window.partitionBy(key).orderBy(t)


def whole(key: str = "series_id"):
    return Window.partitionBy(key)


def index(df: DataFrame, key: str = "series_id", ts: str = "ts") -> DataFrame:
    """Adds t (0, 1, ... by time) and n (length). Missing periods are not filled."""
    return df.withColumn("t", (F.row_number().over(order(key, ts)) - 1).cast("int")).withColumn("n", F.count(F.lit(1)).over(whole(key)).cast("int"))


def finite_only(df: DataFrame, y: str = "y") -> DataFrame:
    c = F.col(y)
    return df.filter(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def lag_columns(df: DataFrame, lags: int, newest_first: bool = False, y: str = "y") -> DataFrame:
    """Supervised rows: x1..xL (oldest first unless newest_first) and target; rows without full history are dropped."""
    w = order()
    ks = range(1, lags + 1) if newest_first else range(lags, 0, -1)
    cols = [F.lag(y, k).over(w).alias(f"x{i}") for i, k in enumerate(ks, 1)]
    return df.select("*", *cols, F.col(y).alias("target")).filter(F.col("t") >= lags)


def lag_array(df: DataFrame, lags: int, y: str = "y") -> DataFrame:
    """Supervised rows with the lags as one array x, oldest first."""
    frame = order().rowsBetween(-lags, -1)
    return df.withColumn("x", F.collect_list(y).over(frame)).withColumn("target", F.col(y)).filter(F.col("t") >= lags)


def min_max(df: DataFrame, fit: Column, low: float = 0.1, high: float = 0.9, y: str = "y") -> DataFrame:
    """Adds y_min, y_max (over the rows of ``fit``) and scaled; values outside are extrapolated, not clipped."""
    w = whole()
    out = df.withColumn("y_min", F.min(F.when(fit, F.col(y))).over(w)).withColumn("y_max", F.max(F.when(fit, F.col(y))).over(w))
    return out.withColumn("scaled", F.lit(low) + (F.col(y) - F.col("y_min")) * (F.lit(high - low) / (F.col("y_max") - F.col("y_min"))))


def min_max_inverse(df: DataFrame, scaled: str, low: float = 0.1, high: float = 0.9) -> Column:
    return F.col("y_min") + (F.col(scaled) - F.lit(low)) * ((F.col("y_max") - F.col("y_min")) / F.lit(high - low))


def unit(df: DataFrame, y: str = "y") -> DataFrame:
    """Adds unit: (y - min) / span, the span taken as 1 where it is 0."""
    w = whole()
    span = F.max(y).over(w) - F.min(y).over(w)
    return df.withColumn("unit", (F.col(y) - F.min(y).over(w)) / F.when(span > 0, span).otherwise(1.0))


def z_score(df: DataFrame, y: str = "y") -> DataFrame:
    w = whole()
    return df.withColumn("z", (F.col(y) - F.avg(y).over(w)) / (F.stddev_pop(y).over(w) + F.lit(1e-8)))


def difference(df: DataFrame, y: str = "y") -> DataFrame:
    return df.withColumn("diff", F.col(y) - F.lag(y).over(order())).filter(F.col("t") >= 1)


def linear_trend(df: DataFrame, fit: Column, y: str = "y") -> DataFrame:
    """Adds slope, intercept (least squares on t over the rows of ``fit``), trend and residual for all rows."""
    w = whole()
    t, v = F.when(fit, F.col("t").cast("double")), F.when(fit, F.col(y))
    mt, mv = F.avg(t).over(w), F.avg(v).over(w)
    slope = F.covar_pop(t, v).over(w) / F.var_pop(t).over(w)
    out = df.withColumn("slope", slope).withColumn("intercept", mv - F.col("slope") * mt)
    out = out.withColumn("trend", F.col("intercept") + F.col("slope") * F.col("t"))
    return out.withColumn("residual", F.col(y) - F.col("trend"))
