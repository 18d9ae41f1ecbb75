"""Queries of the simple forecasters and of the error metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.operators import metrics, naive
from tidemark.plans.core import query, r8
from tidemark.sources.tables import PRIORITY_SQL, priority_monthly

P = f"WITH {PRIORITY_SQL}"
W = "WINDOW w AS (PARTITION BY series_id ORDER BY t)"
ROLLING = f"""{P}, f AS (
  SELECT series_id, t, n, y, lag(y, 1) OVER w AS naive_1, CASE WHEN t <= 12 THEN lag(y, 1) OVER w ELSE lag(y, 12) OVER w END AS seasonal_naive,
         lag(y, 1) OVER w + (lag(y, 1) OVER w - first_value(y) OVER w) / greatest(t - 1, 1) AS drift FROM series {W})"""
FROZEN = f"""{P}, ends AS (SELECT series_id, max(y) FILTER (WHERE t = 0) AS y0, max(y) FILTER (WHERE t = floor(0.8 * n) - 1) AS y1 FROM series GROUP BY 1),
f AS (SELECT series_id, t, n, y, CAST(floor(0.8 * n) AS INTEGER) AS split, lag(y, 1) OVER w AS naive_1, lag(y, 12) OVER w AS seasonal_naive,
         lag(y, 1) OVER w + (y1 - y0) / (floor(0.8 * n) - 1) AS drift FROM series JOIN ends USING (series_id) {W}),
long AS (SELECT series_id, t, split, y AS actual, method, predicted FROM f UNPIVOT (predicted FOR method IN (naive_1, seasonal_naive, drift)) WHERE t >= split),
steps AS (SELECT series_id, t, floor(0.8 * n) AS split, y - lag(y, 12) OVER w AS d FROM series {W}),
scales AS (SELECT series_id, avg(abs(d)) AS scale, avg(d * d) AS scale_sq FROM steps WHERE t < split AND d IS NOT NULL GROUP BY 1),
p AS (SELECT long.*, scale, scale_sq FROM long JOIN scales USING (series_id))"""


def split():
    return rules.floor_split(F.col("n"))


def predictions(spark, d):
    """series_id, t, method, actual, predicted, scale, scale_sq of the test part, for the frozen simple methods."""
    test = naive.forecasts(priority_monthly(spark, d), split(), 12).filter("is_test")
    return test.select("series_id", "t", "method", F.col("y").alias("actual"), "predicted", "scale", "scale_sq")


def _rounded(df, *keys):
    return df.select(*keys, *(r8(c).alias(c) if t == "double" else c for c, t in df.dtypes if c not in keys))


@query("F04_naive", f"{ROLLING} SELECT series_id, t, round(naive_1, 8) AS predicted FROM f WHERE t >= 1")
def naive_1(spark, d):
    return priority_monthly(spark, d).select("series_id", "t", r8(naive.last_value()).alias("predicted")).filter("t >= 1")


@query("F05_seasonal_naive", f"{ROLLING} SELECT series_id, t, round(seasonal_naive, 8) AS predicted FROM f WHERE t >= 1")
def seasonal(spark, d):
    return priority_monthly(spark, d).select("series_id", "t", r8(naive.seasonal(12)).alias("predicted")).filter("t >= 1")


@query("F06_drift", f"{ROLLING} SELECT series_id, t, round(drift, 8) AS predicted FROM f WHERE t >= 1")
def drift(spark, d):
    return priority_monthly(spark, d).select("series_id", "t", r8(naive.drift()).alias("predicted")).filter("t >= 1")


@query("F07_rolling_origin", f"{P} SELECT series_id, t, round(avg(y) OVER v, 8) AS history_mean, round(max(y) OVER v, 8) AS history_max FROM series WINDOW v AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def rolling_origin(spark, d):
    frame = naive.order().rowsBetween(-(2**31), -1)
    return priority_monthly(spark, d).select("series_id", "t", r8(F.avg("y").over(frame)).alias("history_mean"), r8(F.max("y").over(frame)).alias("history_max"))


@query("F08_season_scale", f"{FROZEN} SELECT series_id, round(scale, 8) AS scale, round(scale_sq, 8) AS scale_sq FROM scales")
def season_scale(spark, d):
    return _rounded(metrics.scales(priority_monthly(spark, d), 12, F.col("t") < split()), "series_id")


@query("M01_rolling_simple", f"{ROLLING} SELECT series_id, t, method, round(predicted, 8) AS predicted FROM f UNPIVOT (predicted FOR method IN (naive_1, seasonal_naive, drift)) WHERE t >= floor(0.8 * n)")
def rolling_simple(spark, d):
    return naive.forecasts(priority_monthly(spark, d), split(), 12, frozen=False).filter("is_test").select("series_id", "t", "method", r8("predicted").alias("predicted"))


for _id, _method in (("M11_frozen_naive", "naive_1"), ("M12_frozen_seasonal", "seasonal_naive"), ("M13_frozen_drift", "drift")):

    def _frozen(spark, d, method=_method):
        return predictions(spark, d).filter(F.col("method") == method).select("series_id", "t", r8("predicted").alias("predicted"))

    query(_id, f"{FROZEN} SELECT series_id, t, round(predicted, 8) AS predicted FROM long WHERE method = '{_method}'")(_frozen)

ERR = "actual - predicted"
CORE = f"""avg(({ERR}) * ({ERR})) AS mse, sqrt(avg(({ERR}) * ({ERR}))) AS rmse, avg(abs({ERR})) AS mae,
  avg(abs(({ERR}) / actual)) FILTER (WHERE abs(actual) > 1e-12) AS mape, avg({{smape}}) AS smape,
  1 - sum(({ERR}) * ({ERR})) / (var_pop(actual) * count(*)) AS r2, avg({ERR}) AS error_mean, coalesce(stddev_samp({ERR}), 0) AS error_std, {{mase}} AS mase"""


def _all_rounded(inner: str, keys: str, cols: str) -> str:
    return f"SELECT {keys}, " + ", ".join(f"round({c}, 8) AS {c}" for c in cols.split()) + f" FROM ({inner})"


@query("J01_core_metrics", FROZEN + _all_rounded("SELECT series_id, method, " + CORE.format(smape=f"2 * abs({ERR}) / (abs(actual) + abs(predicted) + 1e-12)", mase=f"avg(abs({ERR})) / greatest(max(scale), 1e-12)") + ", corr(actual, predicted) AS pearson_r FROM p GROUP BY 1, 2", "series_id, method", "mse rmse mae mape smape r2 pearson_r error_mean error_std mase"))
def core_metrics(spark, d):
    return _rounded(metrics.core(predictions(spark, d), "series_id", "method"), "series_id", "method")


@query("J02_rolling_metrics", FROZEN + _all_rounded("SELECT series_id, method, count(*) AS n_test, " + CORE.format(smape=f"2 * abs({ERR}) / (abs(actual) + abs(predicted))", mase=f"avg(abs({ERR})) / max(scale)") + " FROM p GROUP BY 1, 2", "series_id, method, n_test", "mse rmse mae mape smape r2 error_mean error_std mase"))
def rolling_metrics(spark, d):
    return _rounded(metrics.rolling(predictions(spark, d), "series_id", "method"), "series_id", "method")


FINAL = f"SELECT series_id, method, avg(abs({ERR})) AS mae, sqrt(avg(({ERR}) * ({ERR}))) AS rmse, avg(200 * abs({ERR}) / (abs(actual) + abs(predicted))) AS smape, avg(abs({ERR})) / max(scale) AS mase, sqrt(avg(({ERR}) * ({ERR})) / max(scale_sq)) AS rmsse FROM p GROUP BY 1, 2"


@query("J03_final_metrics", FROZEN + _all_rounded(FINAL, "series_id, method, 'success' AS status", "mae rmse smape mase rmsse"))
def final_metrics(spark, d):
    return _rounded(metrics.final(predictions(spark, d), "series_id", "method"), "series_id", "method")


@query("J04_mase", FROZEN + _all_rounded(FINAL, "series_id, method", "mase"))
def mase(spark, d):
    return metrics.final(predictions(spark, d), "series_id", "method").select("series_id", "method", r8("mase").alias("mase"))


@query("J05_short_series_metrics", FROZEN + _all_rounded(f"SELECT series_id, method, avg(abs({ERR})) AS mae, sqrt(avg(({ERR}) * ({ERR}))) AS rmse, avg(abs({ERR})) / (max(scale) + 1e-12) AS mase FROM p GROUP BY 1, 2", "series_id, method", "mae rmse mase"))
def short_metrics(spark, d):
    return _rounded(metrics.short_series(predictions(spark, d), "series_id", "method"), "series_id", "method")


@query("J08_rmse", FROZEN + _all_rounded(FINAL, "series_id, method", "rmse"))
def rmse(spark, d):
    return metrics.final(predictions(spark, d), "series_id", "method").select("series_id", "method", r8("rmse").alias("rmse"))


@query("M09_metrics_frame", FROZEN + f"SELECT method, round(avg(mae), 8) AS mae, round(avg(rmse), 8) AS rmse, count(*) AS n FROM ({FINAL}) GROUP BY 1")
def metrics_frame(spark, d):
    return metrics.final(predictions(spark, d), "series_id", "method").groupBy("method").agg(r8(F.avg("mae")).alias("mae"), r8(F.avg("rmse")).alias("rmse"), F.count(F.lit(1)).alias("n"))


@query("M10_fallback", f"{ROLLING} SELECT series_id, t, round(coalesce(CASE WHEN t % 5 <> 0 THEN seasonal_naive END, naive_1), 8) AS predicted, t % 5 = 0 AS substituted FROM f WHERE t >= 1")
def fallback(spark, d):
    s = priority_monthly(spark, d)
    failed = F.col("t") % 5 == 0
    return s.select("series_id", "t", r8(F.coalesce(F.when(~failed, naive.seasonal(12)), naive.last_value())).alias("predicted"), failed.alias("substituted")).filter("t >= 1")
