"""One-step forecasts that are window expressions. At t only values before t are seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.shaping import order, whole


def last_value(y: str = "y") -> Column:
    return F.lag(y, 1).over(order())


def seasonal(m: int, y: str = "y", fall_back: bool = True) -> Column:
    """The value a season ago; with fall_back the last value where the history is no longer than a season."""
    ago = F.lag(y, m).over(order())
    return F.when(F.col("t") <= m, F.lag(y, 1).over(order())).otherwise(ago) if fall_back else ago


def drift(y: str = "y") -> Column:
    """Last value plus the mean step of the history so far."""
    last, first = F.lag(y, 1).over(order()), F.first(y).over(order())
    return last + (last - first) / F.greatest(F.col("t") - 1, F.lit(1))


def frozen_drift(split: Column, y: str = "y") -> Column:
    """Last value plus the mean step of the training part alone."""
    w = whole()
    first = F.max(F.when(F.col("t") == 0, F.col(y))).over(w)
    last = F.max(F.when(F.col("t") == split - 1, F.col(y))).over(w)
    return F.lag(y, 1).over(order()) + (last - first) / (split - 1)


def forecasts(series: DataFrame, split: Column, m: int, frozen: bool = True) -> DataFrame:
    """series_id, t, n, split, is_test, y, scale, scale_sq, method, predicted: the three simple methods, from one window pass.

    scale and scale_sq are the mean absolute and mean squared season step of the training part.
    """
    wide = series.withColumn("split", split).withColumn("is_test", F.col("t") >= F.col("split")).withColumn("_step", season_step(m))
    step = F.when(~F.col("is_test"), F.col("_step"))
    wide = wide.withColumn("scale", F.avg(F.abs(step)).over(whole())).withColumn("scale_sq", F.avg(step * step).over(whole())).drop("_step")
    wide = wide.withColumn("naive_1", last_value()).withColumn("seasonal_naive", seasonal(m, fall_back=not frozen)).withColumn("drift", frozen_drift(F.col("split")) if frozen else drift())
    return wide.unpivot([c for c in wide.columns if c not in ("naive_1", "seasonal_naive", "drift")], ["naive_1", "seasonal_naive", "drift"], "method", "predicted")


def season_step(m: int, y: str = "y") -> Column:
    """Value less the value a season ago; null in the first season."""
    return F.col(y) - F.lag(y, m).over(Window.partitionBy("series_id").orderBy("t"))
