"""The score table on which the analytics are shown: three methods on ten series with three split rules (90 rows).

rule, family, series_id and method identify a row; values are rounded so that ranks don't depend on last bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import metrics, naive
from tidemark.sources.tables import PRIORITY_SQL, SEGMENT_SQL, priority_monthly, segment_monthly

RULES = {"f70": 0.7, "f80": 0.8, "f85": 0.85}
METHODS = ["drift", "naive_1", "seasonal_naive"]
CONDITION = ["family", "series", "rule"]


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family, series, rule, method, mae, rmse, mase, smape, rmsse."""
    series = priority_monthly(spark, sf_dir).withColumn("family", F.lit("priority")).unionByName(segment_monthly(spark, sf_dir).withColumn("family", F.lit("segment")))
    rules = F.broadcast(spark.createDataFrame(list(RULES.items()), "rule string, fraction double"))
    every = series.crossJoin(rules).withColumn("series", F.col("series_id")).withColumn("series_id", F.concat_ws("|", "family", "series_id", "rule"))
    split = F.floor(F.col("fraction") * F.col("n")).cast("int")
    test = naive.forecasts(every, split, 12).filter("is_test").select(*CONDITION, "method", F.col("y").alias("actual"), "predicted", "scale", "scale_sq")
    final = metrics.final(test, *CONDITION, "method")
    return final.select(*CONDITION, "method", *(F.round(c, 8).alias(c) for c in ("mae", "rmse", "mase", "smape", "rmsse")))


SCORES_SQL = f"""WITH {PRIORITY_SQL}, {SEGMENT_SQL},
rules AS (SELECT 'f70' AS rule, CAST(0.7 AS DOUBLE) AS fraction UNION ALL SELECT 'f80', CAST(0.8 AS DOUBLE) UNION ALL SELECT 'f85', CAST(0.85 AS DOUBLE)),
every AS (SELECT family, series_id AS series, rule, t, n, y, CAST(floor(fraction * n) AS INTEGER) AS split
  FROM (SELECT 'priority' AS family, * FROM series UNION ALL SELECT 'segment', * FROM segments), rules),
ends AS (SELECT family, series, rule, max(y) FILTER (WHERE t = 0) AS y0, max(y) FILTER (WHERE t = split - 1) AS y1 FROM every GROUP BY ALL),
wide AS (SELECT family, series, rule, t, split, y, lag(y, 12) OVER w AS ago, lag(y, 1) OVER w AS naive_1, lag(y, 12) OVER w AS seasonal_naive,
  lag(y, 1) OVER w + (y1 - y0) / (split - 1) AS drift FROM every JOIN ends USING (family, series, rule) WINDOW w AS (PARTITION BY family, series, rule ORDER BY t)),
scales AS (SELECT family, series, rule, avg(abs(y - ago)) AS scale, avg((y - ago) * (y - ago)) AS scale_sq FROM wide WHERE t < split AND ago IS NOT NULL GROUP BY ALL),
long AS (SELECT family, series, rule, y, method, predicted, abs(y - predicted) AS e FROM wide UNPIVOT (predicted FOR method IN (naive_1, seasonal_naive, drift)) WHERE t >= split),
scores AS (SELECT family, series, rule, method, round(avg(e), 8) AS mae, round(sqrt(avg(e * e)), 8) AS rmse, round(avg(e) / max(scale), 8) AS mase,
  round(avg(200 * e / (abs(y) + abs(predicted))), 8) AS smape, round(sqrt(avg(e * e) / max(scale_sq)), 8) AS rmsse FROM long JOIN scales USING (family, series, rule) GROUP BY ALL)"""
