"""Queries of joins, aggregations, ranks, sorting, set operations and tests, over the score table and the base tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import inference, ranking, tall
from tidemark.plans.core import query, r8
from tidemark.plans.scores import CONDITION, METHODS, SCORES_SQL, scores
from tidemark.sources.tables import read

S = SCORES_SQL
WIDE = f"""{S}, wide_scores AS (SELECT family, series, rule, avg(mase) FILTER (WHERE method = 'drift') AS drift, avg(mase) FILTER (WHERE method = 'naive_1') AS naive_1,
  avg(mase) FILTER (WHERE method = 'seasonal_naive') AS seasonal_naive FROM scores GROUP BY ALL)"""
RANKED = f"""{S}, ranked AS (SELECT *, rank() OVER (PARTITION BY family, series, rule ORDER BY mase) + (count(*) OVER (PARTITION BY family, series, rule, mase) - 1) / 2.0 AS r FROM scores)"""
PAIRS = f"{S}, pairs AS (SELECT family, series, rule, a.mase AS a, b.mase AS b FROM scores a JOIN scores b USING (family, series, rule) WHERE a.method = 'seasonal_naive' AND b.method = 'naive_1')"


def pairs(spark, d, a="seasonal_naive", b="naive_1"):
    return ranking.paired(scores(spark, d), CONDITION, "method", "mase", a, b)


def _r(df, *keep):
    return df.select(*keep, *(r8(c).alias(c) for c in df.columns if c not in keep))


# -- filters and projections ------------------------------------------------------------------------------------------


@query("B03_status_ok", "SELECT o_orderkey, o_orderstatus FROM orders WHERE lower(coalesce(nullif(o_orderstatus, 'P'), 'ok')) = 'ok'")
def status_ok(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return o.filter(F.lower(F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("ok"))) == "ok")


@query("B04_domain", f"{S} SELECT family, series, rule, method, mase FROM scores WHERE family = 'segment'")
def domain(spark, d):
    return scores(spark, d).filter("family = 'segment'").select(*CONDITION, "method", "mase")


@query("B05_available_metrics", f"{S} SELECT 'mae' AS metric, count(mae) AS n FROM scores UNION ALL SELECT 'rmse', count(rmse) FROM scores UNION ALL SELECT 'mase', count(mase) FROM scores")
def available(spark, d):
    s = scores(spark, d)
    wanted = [m for m in ("mae", "rmse", "mase", "absent") if m in s.columns]
    return s.agg(*(F.count(m).alias(m) for m in wanted)).unpivot([], wanted, "metric", "n").filter("n > 0")


@query("B10_seed_firewall", "SELECT o_orderkey AS seed, o_orderkey BETWEEN 1001 AND 1010 AS development, o_orderkey BETWEEN 2001 AND 2020 AS final FROM orders")
def firewall(spark, d):
    from tidemark.plans.design import DEVELOPMENT_SEEDS, FINAL_SEEDS

    seed = F.col("o_orderkey")
    return read(spark, d, "orders").select(seed.alias("seed"), seed.isin(DEVELOPMENT_SEEDS).alias("development"), seed.isin(FINAL_SEEDS).alias("final"))


@query("B11_method_support", f"{S} SELECT family, series, rule, method FROM scores WHERE method <> 'seasonal_naive' OR (CASE family WHEN 'priority' THEN 12 ELSE 1 END) > 1")
def method_support(spark, d):
    m = F.when(F.col("family") == "priority", 12).otherwise(1)
    return scores(spark, d).filter((F.col("method") != "seasonal_naive") | (m > 1)).select(*CONDITION, "method")


@query("B16_rename", f"{S} SELECT family AS FAMILY, series AS SERIES, rule AS RULE, method AS VARIANT, mase AS MASE FROM scores")
def rename(spark, d):
    s = scores(spark, d).select(*CONDITION, "method", "mase")
    up = s.toDF(*(c.upper() for c in s.columns))
    return up.withColumnRenamed("METHOD", "VARIANT") if "VARIANT" not in up.columns else up


# -- joins --------------------------------------------------------------------------------------------------------------


@query("D01_paired_inner", f"{PAIRS} SELECT * FROM pairs")
def paired_inner(spark, d):
    s = scores(spark, d)
    a = s.filter("method = 'seasonal_naive'").select(*CONDITION, F.col("mase").alias("a"))
    return a.join(s.filter("method = 'naive_1'").select(*CONDITION, F.col("mase").alias("b")), CONDITION)


@query("D02_paired_pivot", f"{PAIRS} SELECT family, series, rule, a, b, round(a - b, 8) AS d FROM pairs")
def paired_pivot(spark, d):
    return pairs(spark, d).withColumn("d", r8(F.col("a") - F.col("b")))


@query("D03_lookup", "SELECT o_orderkey, c_mktsegment AS domain FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("domain"))
    return read(spark, d, "orders").join(c, "o_custkey", "left").filter("domain IS NOT NULL").select("o_orderkey", "domain")


@query("D04_orphans", "SELECT coalesce(c_custkey, o_custkey) AS key, CASE WHEN o_custkey IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'orphan' ELSE 'matched' END AS state FROM (SELECT DISTINCT o_custkey FROM orders) o FULL JOIN customer ON o_custkey = c_custkey")
def orphans(spark, d):
    from tidemark.plans.design import reconcile

    tasks = read(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return reconcile(tasks, read(spark, d, "orders").select(F.col("o_custkey").alias("key")), "key")


@query("D05_pending", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def pending(spark, d):
    done = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


@query("D06_completed", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def completed(spark, d):
    done = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").join(done, "c_custkey", "left_semi").select("c_custkey")


@query("D09_candidate_grid", "SELECT radius, alpha FROM (SELECT unnest([0.25, 0.35, 0.55, 0.75, 1.0])::DOUBLE AS radius), (SELECT unnest([0.000001, 0.00001, 0.0001, 0.001, 0.01, 0.05, 0.1])::DOUBLE AS alpha)")
def candidate_grid(spark, d):
    from tidemark.plans.design import candidate_grid as op

    return op(spark)


@query("D10_job_product", f"{S} SELECT DISTINCT family, rule, method, seed FROM scores, (SELECT unnest([1, 2, 3, 4, 5]) AS seed)")
def job_product(spark, d):
    seeds = spark.createDataFrame([(i,) for i in range(1, 6)], "seed int")
    return scores(spark, d).select("family", "rule", "method").distinct().crossJoin(F.broadcast(seeds))


@query("D11_pair_distances", f"{WIDE} SELECT a.series, b.series AS other, round(sqrt((a.drift - b.drift) ** 2 + (a.naive_1 - b.naive_1) ** 2), 8) AS distance FROM wide_scores a JOIN wide_scores b ON a.family = b.family AND a.rule = b.rule AND a.series < b.series WHERE a.rule = 'f80'")
def pair_distances(spark, d):
    w = ranking.pivot(scores(spark, d).filter("rule = 'f80'"), CONDITION, "method", "mase", METHODS)
    b = w.select("family", F.col("series").alias("other"), F.col("drift").alias("d2"), F.col("naive_1").alias("n2"))
    dist = F.sqrt(F.pow(F.col("drift") - F.col("d2"), 2) + F.pow(F.col("naive_1") - F.col("n2"), 2))
    return w.join(b, "family").filter("series < other").select("series", "other", r8(dist).alias("distance"))


@query("D13_coverage", f"{S} SELECT method, count(DISTINCT (family, series, rule)) AS n, count(DISTINCT (family, series, rule)) = (SELECT count(*) FROM (SELECT DISTINCT family, series, rule FROM scores)) AS complete FROM scores GROUP BY 1")
def coverage(spark, d):
    s = scores(spark, d)
    total = s.select(*CONDITION).distinct().agg(F.count(F.lit(1)).alias("total"))
    return s.groupBy("method").agg(F.countDistinct(*CONDITION).alias("n")).crossJoin(F.broadcast(total)).select("method", "n", (F.col("n") == F.col("total")).alias("complete"))


# -- aggregations ---------------------------------------------------------------------------------------------------------


@query("E01_group_mean", f"{S} SELECT family, method, round(avg(mase), 8) AS mean, round(median(mase), 8) AS median FROM scores GROUP BY 1, 2")
def group_mean(spark, d):
    return scores(spark, d).groupBy("family", "method").agg(r8(F.avg("mase")).alias("mean"), r8(F.median("mase")).alias("median"))


@query("E02_pivot", f"{WIDE} SELECT * FROM wide_scores")
def pivot(spark, d):
    return ranking.pivot(scores(spark, d), CONDITION, "method", "mase", METHODS)


@query("E03_complete_cases", f"{WIDE} SELECT family, series, rule, drift, naive_1 FROM wide_scores WHERE drift IS NOT NULL AND naive_1 IS NOT NULL AND rule <> 'f70'")
def complete_cases(spark, d):
    gone = F.when((F.col("rule") == "f70") & (F.col("method") == "drift"), None).otherwise(F.col("mase"))
    w = ranking.pivot(scores(spark, d).withColumn("mase", gone), CONDITION, "method", "mase", ["drift", "naive_1"])
    return ranking.complete(w, ["drift", "naive_1"])


@query("E04_model_summary", f"{RANKED} SELECT method, count(mase) AS n, round(avg(mase), 8) AS mean, round(stddev_samp(mase), 8) AS std, round(median(mase), 8) AS median, min(mase) AS min, max(mase) AS max, round(avg(r), 8) AS rank_mean, round(median(r), 8) AS rank_median FROM ranked GROUP BY 1")
def model_summary(spark, d):
    return _r(ranking.summarise(scores(spark, d), CONDITION, "method", "mase"), "method", "n")


@query("E05_numeric_means", f"{S} SELECT family, rule, method, round(avg(mae), 8) AS mae, round(avg(rmse), 8) AS rmse, round(avg(smape), 8) AS smape FROM scores GROUP BY 1, 2, 3")
def numeric_means(spark, d):
    return scores(spark, d).groupBy("family", "rule", "method").agg(*(r8(F.avg(c)).alias(c) for c in ("mae", "rmse", "smape")))


@query("E06_replicate_median", f"{S} SELECT family, series, method, round(median(rmse), 8) AS rmse FROM scores GROUP BY 1, 2, 3")
def replicate_median(spark, d):
    return scores(spark, d).groupBy("family", "series", "method").agg(r8(F.median("rmse")).alias("rmse"))


@query("E07_pivot_mean", f"{S} SELECT family, series, round(avg(rmse) FILTER (WHERE method = 'drift'), 8) AS drift, round(avg(rmse) FILTER (WHERE method = 'naive_1'), 8) AS naive_1, round(avg(rmse) FILTER (WHERE method = 'seasonal_naive'), 8) AS seasonal_naive FROM scores GROUP BY 1, 2")
def pivot_mean(spark, d):
    return _r(ranking.pivot(scores(spark, d), ["family", "series"], "method", "rmse", METHODS), "family", "series")


@query("E08_summary_by_level", f"{S} SELECT rule, method, round(avg(rmse), 8) AS mean, round(median(rmse), 8) AS median, round(stddev_samp(rmse), 8) AS std, count(rmse) AS n FROM scores GROUP BY 1, 2")
def summary_by_level(spark, d):
    return _r(scores(spark, d).groupBy("rule", "method").agg(F.avg("rmse").alias("mean"), F.median("rmse").alias("median"), F.stddev_samp("rmse").alias("std"), F.count("rmse").alias("n")), "rule", "method", "n")


@query("E09_arg_min", f"{S} SELECT family, series, arg_min(method, rmse) AS best, min(rmse) AS rmse FROM scores WHERE rule = 'f80' GROUP BY 1, 2")
def arg_min(spark, d):
    return scores(spark, d).filter("rule = 'f80'").groupBy("family", "series").agg(F.min_by("method", "rmse").alias("best"), F.min("rmse").alias("rmse"))


@query("E10_best_with_ties", f"{S}, m AS (SELECT *, round(mase, 1) AS q, rank() OVER (PARTITION BY family, series, rule ORDER BY round(mase, 1)) AS r FROM scores) SELECT family, series, rule, string_agg(method, '/' ORDER BY method) AS best, min(q) AS q FROM m WHERE r = 1 GROUP BY 1, 2, 3")
def best_with_ties(spark, d):
    return ranking.best_with_ties(scores(spark, d).withColumn("q", F.round("mase", 1)), CONDITION, "method", "q")


@query("E11_budget_means", f"{S} SELECT family, rule, round(avg(rmse), 8) AS rmse_mean, round(stddev_samp(rmse), 8) AS rmse_std FROM scores GROUP BY 1, 2")
def budget_means(spark, d):
    return scores(spark, d).groupBy("family", "rule").agg(r8(F.avg("rmse")).alias("rmse_mean"), r8(F.stddev_samp("rmse")).alias("rmse_std"))


@query("E12_named_aggregates", f"{S} SELECT rule, round(avg(rmse), 8) AS rmse_mean, round(stddev_samp(rmse), 8) AS rmse_std, round(avg(mae), 8) AS mae_mean, round(avg(mase), 8) AS mase_mean, max(smape) AS smape_max FROM scores GROUP BY 1")
def named_aggregates(spark, d):
    return _r(scores(spark, d).groupBy("rule").agg(F.avg("rmse").alias("rmse_mean"), F.stddev_samp("rmse").alias("rmse_std"), F.avg("mae").alias("mae_mean"), F.avg("mase").alias("mase_mean"), F.max("smape").alias("smape_max")), "rule")


@query("E13_variant_means", f"{S} SELECT method AS VARIANT, round(avg(rmse), 8) AS RMSE_mean, round(stddev_samp(rmse), 8) AS RMSE_std FROM scores GROUP BY 1")
def variant_means(spark, d):
    return scores(spark, d).groupBy(F.col("method").alias("VARIANT")).agg(r8(F.avg("rmse")).alias("RMSE_mean"), r8(F.stddev_samp("rmse")).alias("RMSE_std"))


@query("E14_model_means", f"{S} SELECT method, round(avg(rmse), 8) AS rmse, round(avg(mae), 8) AS mae FROM scores GROUP BY 1 ORDER BY rmse")
def model_means(spark, d):
    return scores(spark, d).groupBy("method").agg(r8(F.avg("rmse")).alias("rmse"), r8(F.avg("mae")).alias("mae")).orderBy("rmse")


@query("E15_all_metrics", f"{S} SELECT method, " + ", ".join(f"round(avg({c}), 8) AS Mean_{c}, round(stddev_samp({c}), 8) AS Std_{c}" for c in ("mae", "rmse", "mase", "smape", "rmsse")) + ", count(*) AS Count FROM scores GROUP BY 1")
def all_metrics(spark, d):
    aggs = [a for c in ("mae", "rmse", "mase", "smape", "rmsse") for a in (r8(F.avg(c)).alias(f"Mean_{c}"), r8(F.stddev_samp(c)).alias(f"Std_{c}"))]
    return scores(spark, d).groupBy("method").agg(*aggs, F.count(F.lit(1)).alias("Count"))


@query("E16_robustness", f"{S} SELECT method, round(avg(rmse), 8) AS mean, round(median(rmse), 8) AS median, round(quantile_cont(rmse, 0.9), 8) AS p90, round(stddev_pop(rmse), 8) AS std FROM scores GROUP BY 1")
def robustness(spark, d):
    return _r(scores(spark, d).groupBy("method").agg(F.avg("rmse").alias("mean"), F.median("rmse").alias("median"), F.percentile("rmse", 0.9).alias("p90"), F.stddev_pop("rmse").alias("std")), "method")


WINS = "count(*) FILTER (WHERE b > a) AS wins, count(*) FILTER (WHERE b < a) AS losses, count(*) FILTER (WHERE b = a) AS ties, round(100.0 * count(*) FILTER (WHERE b > a) / count(*), 8) AS win_rate"


@query("E17_wins", f"{PAIRS} SELECT {WINS} FROM pairs")
def wins(spark, d):
    return ranking.wins(pairs(spark, d)).select("wins", "losses", "ties", r8("win_rate").alias("win_rate"))


@query("E18_wins_by_baseline", f"{S} SELECT b.method, {WINS} FROM (SELECT family, series, rule, mase AS a FROM scores WHERE method = 'drift') x JOIN (SELECT *, mase AS b FROM scores WHERE method <> 'drift') b USING (family, series, rule) GROUP BY 1")
def wins_by_baseline(spark, d):
    s = scores(spark, d)
    a = s.filter("method = 'drift'").select(*CONDITION, F.col("mase").alias("a"))
    both = s.filter("method <> 'drift'").select(*CONDITION, "method", F.col("mase").alias("b")).join(a, CONDITION)
    return ranking.wins(both, "method").select("method", "wins", "losses", "ties", r8("win_rate").alias("win_rate"))


@query("E19_improvement", f"{PAIRS} SELECT round(avg(b - a) FILTER (WHERE b > a), 8) AS mean_gain, round(avg(abs(b - a)) FILTER (WHERE b <= a), 8) AS mean_loss, round(avg(b - a), 8) AS mean_difference FROM pairs")
def improvement(spark, d):
    return _r(ranking.wins(pairs(spark, d)).select("mean_gain", "mean_loss", "mean_difference"))


@query("E20_wins_by_domain", f"{PAIRS} SELECT family, round(100.0 * count(*) FILTER (WHERE b > a) / count(*), 8) AS win_rate, count(*) AS n FROM pairs GROUP BY 1")
def wins_by_domain(spark, d):
    return ranking.wins(pairs(spark, d), "family").select("family", r8("win_rate").alias("win_rate"), (F.col("wins") + F.col("losses") + F.col("ties")).alias("n"))


@query("E21_correlation", f"{S} SELECT method, round(corr(mase, rmse), 8) AS r FROM scores GROUP BY 1")
def correlation(spark, d):
    return scores(spark, d).groupBy("method").agg(r8(F.corr("mase", "rmse")).alias("r"))


@query("E22_models_by_condition", f"{S} SELECT family, series, rule, count(DISTINCT method) AS n FROM scores GROUP BY 1, 2, 3")
def models_by_condition(spark, d):
    return scores(spark, d).groupBy(*CONDITION).agg(F.countDistinct("method").alias("n"))


@query("E23_histograms", "SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (WHERE o_totalprice IS NULL) AS missing FROM orders GROUP BY 1")
def histograms(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnull("o_totalprice")).alias("missing"))


@query("E24_balance", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def balance(spark, d):
    return read(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("E26_describe", f"{S} SELECT count(mase) AS n, round(avg(mase), 8) AS mean, round(stddev_samp(mase), 8) AS std, min(mase) AS min, round(quantile_cont(mase, 0.25), 8) AS q25, round(quantile_cont(mase, 0.5), 8) AS q50, round(quantile_cont(mase, 0.75), 8) AS q75, max(mase) AS max FROM scores")
def describe(spark, d):
    q = {f"q{p}": F.percentile("mase", p / 100) for p in (25, 50, 75)}
    return _r(scores(spark, d).agg(F.count("mase").alias("n"), F.avg("mase").alias("mean"), F.stddev_samp("mase").alias("std"), F.min("mase").alias("min"), *(v.alias(k) for k, v in q.items()), F.max("mase").alias("max")), "n")


@query("E27_two_level_median", f"{S} SELECT method, round(median(m), 8) AS statistic, count(*) AS n_conditions FROM (SELECT family, series, method, median(mase) AS m FROM scores GROUP BY 1, 2, 3) GROUP BY 1")
def two_level(spark, d):
    from tidemark.operators.selection import two_level_median

    return two_level_median(scores(spark, d), ["family", "series"], ["method"], "mase").select("method", r8("statistic").alias("statistic"), "n_conditions")


@query("E28_protocol_aggregation", f"{S}, inner_level AS (SELECT family, rule, method, median(mase) AS m, count(*) AS c FROM scores GROUP BY 1, 2, 3) SELECT family, method, round(avg(m), 8) AS value FROM inner_level WHERE c = 5 GROUP BY 1, 2 HAVING count(*) = 3")
def protocol_aggregation(spark, d):
    from tidemark.operators.selection import estimable

    return estimable(scores(spark, d), ["family", "method"], "rule", "mase", 5, 3).select("family", "method", r8("value").alias("value"))


@query("E29_noise_robustness", f"{S}, m AS (SELECT method, avg(rmse) FILTER (WHERE rule = 'f70') AS f70, avg(rmse) FILTER (WHERE rule = 'f85') AS f85 FROM scores GROUP BY 1) SELECT method, round(f70, 8) AS f70, round(f85, 8) AS f85, round((f85 - f70) / f70, 8) AS degradation FROM m")
def noise_robustness(spark, d):
    w = scores(spark, d).groupBy("method").pivot("rule", ["f70", "f85"]).agg(F.avg("rmse"))
    return _r(w.withColumn("degradation", (F.col("f85") - F.col("f70")) / F.col("f70")), "method")


@query("E30_difficulty_quarters", f"{PAIRS}, q AS (SELECT *, CAST(least(floor((row_number() OVER (ORDER BY b, family, series, rule) - 1) / floor(count(*) OVER () / 4)), 3) + 1 AS INTEGER) AS quarter FROM pairs) SELECT quarter, count(*) AS n, round(100.0 * count(*) FILTER (WHERE b > a) / count(*), 8) AS win_rate, round(avg(b - a), 8) AS mean_difference FROM q GROUP BY 1")
def difficulty(spark, d):
    q = ranking.quarters(pairs(spark, d), "b", *CONDITION)
    return ranking.wins(q, "quarter").select("quarter", (F.col("wins") + F.col("losses") + F.col("ties")).alias("n"), r8("win_rate").alias("win_rate"), r8("mean_difference").alias("mean_difference"))


@query("E33_rollup", f"{S} SELECT family, method, round(avg(rmse), 8) AS rmse, CAST(grouping(family) AS INTEGER) AS overall FROM scores GROUP BY GROUPING SETS ((family, method), (method))")
def rollup(spark, d):
    s = scores(spark, d)
    g = s.groupingSets([[F.col("family"), F.col("method")], [F.col("method")]], F.col("family"), F.col("method"))
    return g.agg(r8(F.avg("rmse")).alias("rmse"), F.grouping("family").cast("int").alias("overall"))


# -- ranks, sorting, sets ---------------------------------------------------------------------------------------------------


@query("F01_average_rank", f"{S} SELECT family, series, rule, method, rank() OVER (PARTITION BY family, series, rule ORDER BY round(mase, 1)) + (count(*) OVER (PARTITION BY family, series, rule, round(mase, 1)) - 1) / 2.0 AS r FROM scores")
def average_rank(spark, d):
    return scores(spark, d).select(*CONDITION, "method", ranking.average_rank(F.round("mase", 1), CONDITION).alias("r"))


@query("F02_mean_rank", f"{RANKED} SELECT method, round(avg(r), 8) AS mean_rank FROM ranked GROUP BY 1")
def mean_rank(spark, d):
    s = scores(spark, d).withColumn("r", ranking.average_rank("mase", CONDITION))
    return s.groupBy("method").agg(r8(F.avg("r")).alias("mean_rank"))


@query("F03_pooled_rank", f"{S} SELECT family, rule, series, method, rank() OVER (PARTITION BY family, rule ORDER BY rmse) + (count(*) OVER (PARTITION BY family, rule, rmse) - 1) / 2.0 AS r FROM scores")
def pooled_rank(spark, d):
    return scores(spark, d).select("family", "rule", "series", "method", ranking.average_rank("rmse", ["family", "rule"]).alias("r"))


@query("F10_hash_rank", "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(concat_ws('|', c_mktsegment, CAST(c_custkey AS VARCHAR)))) AS rn FROM customer")
def hash_rank(spark, d):
    h = F.sha2(F.concat_ws("|", "c_mktsegment", F.col("c_custkey").cast("string")), 256)
    return read(spark, d, "customer").select("c_mktsegment", "c_custkey", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(h)).cast("bigint").alias("rn"))


HOLM = f"""{PAIRS}, p AS (SELECT family, series, rule, least(1.0, a / (a + b) / 5) AS p FROM pairs), s AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS i, count(*) OVER (PARTITION BY family) AS m FROM p)"""


@query("F11_running_max", f"{HOLM} SELECT family, series, rule, round(max(least(1.0, (m - i + 1) * p)) OVER (PARTITION BY family ORDER BY p ROWS UNBOUNDED PRECEDING), 8) AS p_adjusted FROM s")
def running_max(spark, d):
    p = pairs(spark, d).select(*CONDITION, F.least(F.lit(1.0), F.col("a") / (F.col("a") + F.col("b")) / 5).alias("p_value"))
    return inference.holm(p, family=["family"]).select(*CONDITION, r8("p_adjusted").alias("p_adjusted"))


@query("P05_holm", f"{HOLM} SELECT family, series, rule, max(least(1.0, (m - i + 1) * p)) OVER (PARTITION BY family ORDER BY p ROWS UNBOUNDED PRECEDING) <= 0.05 AS reject FROM s")
def holm(spark, d):
    p = pairs(spark, d).select(*CONDITION, F.least(F.lit(1.0), F.col("a") / (F.col("a") + F.col("b")) / 5).alias("p_value"))
    return inference.holm(p, family=["family"]).select(*CONDITION, "reject")


@query("P05b_holm_plain", f"{HOLM} SELECT family, series, rule, round(least(1.0, (m - i + 1) * p), 8) AS p_adjusted FROM s")
def holm_plain(spark, d):
    p = pairs(spark, d).select(*CONDITION, F.least(F.lit(1.0), F.col("a") / (F.col("a") + F.col("b")) / 5).alias("p_value"))
    return inference.holm(p, family=["family"], monotone=False).select(*CONDITION, r8("p_adjusted").alias("p_adjusted"))


@query("G01_mixed_sort", f"{S} SELECT method, family, round(avg(mase), 8) AS mean FROM scores GROUP BY 1, 2 ORDER BY family, mean DESC")
def mixed_sort(spark, d):
    return scores(spark, d).groupBy("method", "family").agg(r8(F.avg("mase")).alias("mean")).orderBy("family", F.desc("mean"))


@query("G02_stratified_by_hash", "SELECT * FROM (SELECT c_mktsegment, c_custkey, CASE WHEN rn <= 10 THEN 'development' ELSE 'final' END AS part, rn FROM (SELECT c_mktsegment, c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(concat_ws('|', c_mktsegment, CAST(c_custkey AS VARCHAR)))) AS INTEGER) AS rn FROM customer)) WHERE rn <= 30")
def stratified_by_hash(spark, d):
    from tidemark.operators.selection import by_hash

    return by_hash(read(spark, d, "customer"), ["c_mktsegment"], ["c_mktsegment", "c_custkey"], 10, 20).select("c_mktsegment", "c_custkey", F.col("partition").alias("part"), "rn")


@query("G03_best_pair", "WITH p AS (SELECT list_extract([0.25, 0.35, 0.55, 0.75, 1.0]::DOUBLE[], 1 + l_linenumber % 5) AS radius, list_extract([0.000001, 0.00001, 0.0001, 0.001, 0.01, 0.05, 0.1]::DOUBLE[], CAST(1 + l_suppkey % 7 AS INTEGER)) AS alpha, l_quantity FROM lineitem) SELECT radius, alpha, median(l_quantity)::DOUBLE AS statistic FROM p GROUP BY 1, 2 ORDER BY 3, radius DESC, alpha DESC LIMIT 1")
def best_pair(spark, d):
    """Line items stand in for scores of pairs; medians of whole quantities tie often, so that the order of ties decides."""
    from tidemark.operators.selection import best_pair as op
    from tidemark.plans.design import ALPHAS, RADII

    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (1 + k % len(values)).cast("int"))
    p = read(spark, d, "lineitem").select(pick(RADII, F.col("l_linenumber")).alias("radius"), pick(ALPHAS, F.col("l_suppkey")).alias("alpha"), "l_quantity")
    return op(p.groupBy("radius", "alpha").agg(F.median("l_quantity").alias("statistic"))).select("radius", "alpha", "statistic")


@query("G05_limit_pending", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) ORDER BY c_custkey LIMIT 7")
def limit_pending(spark, d):
    done = read(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").join(done, "c_custkey", "left_anti").select("c_custkey").orderBy("c_custkey").limit(7)


@query("G08_significance", f"{HOLM} SELECT family, series, rule, round(p, 8) AS p_value, p < 0.05 AS significant FROM s ORDER BY p")
def significance(spark, d):
    p = F.least(F.lit(1.0), F.col("a") / (F.col("a") + F.col("b")) / 5)
    return pairs(spark, d).select(*CONDITION, r8(p).alias("p_value"), (p < 0.05).alias("significant")).orderBy("p_value")


@query("H01_union_by_name", "SELECT c_custkey AS key, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def union_by_name(spark, d):
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("H02_replace_subset", f"{S} SELECT family, series, rule, method, mase FROM scores WHERE method <> 'drift' UNION ALL SELECT family, series, rule, method, round(mase * 2, 8) FROM scores WHERE method = 'drift'")
def replace_subset(spark, d):
    s = scores(spark, d).select(*CONDITION, "method", "mase")
    return s.filter("method <> 'drift'").unionByName(s.filter("method = 'drift'").withColumn("mase", r8(F.col("mase") * 2)))


@query("H03_except", "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def except_(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("key")).subtract(read(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey"))


@query("H04_set_equality", "SELECT (SELECT count(*) FROM (SELECT c_mktsegment FROM customer EXCEPT ALL SELECT c_mktsegment FROM customer)) = 0 AS equal_sets, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS n_distinct")
def set_equality(spark, d):
    c = read(spark, d, "customer").select("c_mktsegment")
    missing = c.exceptAll(c).agg((F.count(F.lit(1)) == 0).alias("equal_sets"))
    return missing.crossJoin(c.agg(F.countDistinct("c_mktsegment").alias("n_distinct")))


@query("H05_duplicates", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicates(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("H06_disjoint", "SELECT count(*) AS shared FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def disjoint(spark, d):
    return read(spark, d, "customer").select("c_nationkey").intersect(read(spark, d, "supplier").select("s_nationkey")).agg(F.count(F.lit(1)).alias("shared"))


# -- tests --------------------------------------------------------------------------------------------------------------------

FRIEDMAN = f"""{RANKED}, sums AS (SELECT method, sum(r) AS s, count(*) AS n FROM ranked GROUP BY 1),
ties AS (SELECT coalesce(sum(c * c * c - c), 0) AS t FROM (SELECT count(*) AS c FROM scores GROUP BY family, series, rule, mase))
SELECT max(n) AS n, round((12.0 / (max(n) * 3 * 4) * sum(s * s) - 3.0 * max(n) * 4) / (1 - max(t) / (max(n) * 3 * 8.0)), 8) AS statistic FROM sums, ties"""


@query("P01_friedman", FRIEDMAN)
def friedman(spark, d):
    return inference.friedman(scores(spark, d), CONDITION, "method", "mase", METHODS).select("n", r8("statistic").alias("statistic"))


@query("P01_friedman_p")
def friedman_p(spark, d):
    return inference.friedman(scores(spark, d), CONDITION, "method", "mase", METHODS)


@query("P02_sign_counts", f"{PAIRS} SELECT count(*) FILTER (WHERE a > b) AS n_pos, count(*) FILTER (WHERE a < b) AS n_neg FROM pairs")
def sign_counts(spark, d):
    return inference.sign_test(pairs(spark, d)).select("n_pos", "n_neg")


@query("I03_sign_test_p")
def sign_test_p(spark, d):
    return inference.sign_test(pairs(spark, d), "family")


SIGNED = f"""{PAIRS}, d AS (SELECT family, a - b AS d, abs(a - b) AS m FROM pairs WHERE a <> b),
r AS (SELECT family, d, rank() OVER (PARTITION BY family ORDER BY m) + (count(*) OVER (PARTITION BY family, m) - 1) / 2.0 AS r FROM d)
SELECT family, count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0.0) AS w_plus, coalesce(sum(r) FILTER (WHERE d < 0), 0.0) AS w_minus FROM r GROUP BY 1"""


@query("P03_signed_ranks", SIGNED)
def signed_ranks(spark, d):
    return inference.signed_ranks(pairs(spark, d), "family").select("family", "n", "w_plus", "w_minus")


@query("P03_wilcoxon_p")
def wilcoxon_p(spark, d):
    return inference.wilcoxon(pairs(spark, d), "family")


@query("P04_bootstrap")
def bootstrap(spark, d):
    return inference.bootstrap(pairs(spark, d), ["family"])


@query("P06_against_reference")
def against_reference(spark, d):
    return inference.compare_to(scores(spark, d), CONDITION, "method", "mase", "seasonal_naive", METHODS)


@query("P07_critical_difference", f"{S} SELECT count(DISTINCT (family, series, rule)) AS n, round(2.343 * sqrt(3 * 4 / 6.0 / count(DISTINCT (family, series, rule))), 8) AS cd FROM scores")
def critical_difference(spark, d):
    return scores(spark, d).agg(F.countDistinct(*CONDITION).alias("n")).select("n", r8(inference.critical_difference(2.343, 3, F.col("n"))).alias("cd"))


@query("P09_cliffs_delta", f"{S} SELECT round(avg(CASE WHEN a.mase > b.mase THEN 1.0 WHEN a.mase < b.mase THEN -1.0 ELSE 0.0 END), 8) AS delta FROM scores a, scores b WHERE a.method = 'drift' AND b.method = 'seasonal_naive'")
def cliffs_delta(spark, d):
    return inference.cliffs_delta(scores(spark, d), "method", "mase", "drift", "seasonal_naive").select(r8("delta").alias("delta"))


@query("P10_wilcoxon_less")
def wilcoxon_less(spark, d):
    return inference.wilcoxon(pairs(spark, d), alternative="less")


@query("P12_median_ranks", f"{S}, m AS (SELECT family, series, method, median(mase) AS v FROM scores GROUP BY 1, 2, 3), r AS (SELECT *, rank() OVER (PARTITION BY family, series ORDER BY v) + (count(*) OVER (PARTITION BY family, series, v) - 1) / 2.0 AS r FROM m) SELECT method, round(avg(r), 8) AS mean_rank, count(*) AS n FROM r GROUP BY 1")
def median_ranks(spark, d):
    m = scores(spark, d).groupBy("family", "series", "method").agg(F.median("mase").alias("v"))
    m = m.withColumn("r", ranking.average_rank("v", ["family", "series"]))
    return m.groupBy("method").agg(r8(F.avg("r")).alias("mean_rank"), F.count(F.lit(1)).alias("n"))


RANK = """sizes AS (SELECT DISTINCT n FROM o), tails AS (SELECT n, k, sum(exp(lgamma(n + 1) - lgamma(k) - lgamma(n - k + 2) - n * ln(2))) OVER (PARTITION BY n ORDER BY k) AS tail FROM (SELECT n, unnest(range(1, n // 2 + 2)) AS k FROM sizes)),
ranks AS (SELECT n, coalesce(max(k) FILTER (WHERE 2 * tail <= 0.05), 0) AS k FROM tails GROUP BY n)"""


def _interval(df, keys, value):
    """The values whose ranks bound the median with 95 % confidence, and the median, by group, exactly and without sorting a group."""
    k = inference.scalar(inference.median_interval_rank, F.col("n").cast("double")).cast("bigint")
    got = tall.order_statistics(df, keys, value, {"low": k, "high": F.col("n") + 1 - F.nullif(k, F.lit(0)), **tall.median_ranks(F.col("n"))})
    return got.select(*keys, r8("low").alias("low"), r8((F.col("lower_median") + F.col("upper_median")) / 2).alias("median"), r8("high").alias("high"))


@query("P13_median_interval", f"{PAIRS}, o AS (SELECT a - b AS d, row_number() OVER (ORDER BY a - b) AS i, count(*) OVER () AS n FROM pairs), {RANK} SELECT round(max(d) FILTER (WHERE i = k), 8) AS low, round(median(d), 8) AS median, round(max(d) FILTER (WHERE i = n + 1 - k), 8) AS high FROM o JOIN ranks USING (n)")
def median_interval(spark, d):
    return _interval(pairs(spark, d).select((F.col("a") - F.col("b")).alias("d")), [], "d")


@query("P13_price_intervals", f"WITH o AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS d, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem), {RANK} SELECT l_returnflag, l_linestatus, round(max(d) FILTER (WHERE i = k), 8) AS low, round(median(d), 8) AS median, round(max(d) FILTER (WHERE i = n + 1 - k), 8) AS high FROM o JOIN ranks USING (n) GROUP BY 1, 2")
def price_intervals(spark, d):
    return _interval(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("P14_stratified_bootstrap")
def stratified_bootstrap(spark, d):
    return inference.bootstrap(pairs(spark, d), ["family", "rule"], seed=90210)


@query("P15_hypothesis_family", f"{S} SELECT b.method, count(*) AS n, count(*) FILTER (WHERE b > a) AS wins FROM (SELECT family, series, rule, mase AS a FROM scores WHERE method = 'drift') x JOIN (SELECT *, mase AS b FROM scores WHERE method <> 'drift') b USING (family, series, rule) GROUP BY 1")
def hypothesis_family(spark, d):
    s = scores(spark, d)
    a = s.filter("method = 'drift'").select(*CONDITION, F.col("mase").alias("a"))
    both = s.filter("method <> 'drift'").select(*CONDITION, "method", F.col("mase").alias("b")).join(a, CONDITION)
    return both.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("b") > F.col("a")).alias("wins"))
