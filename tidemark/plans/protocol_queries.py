"""Queries of readers, sinks, keys, dynamic models, runners and tables that the other modules don't show."""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import forecasters, fuzzy, generators, neurofuzzy, swarm
from tidemark.operators import fitting, metrics, ranking, reporting, selection, synthetic
from tidemark.plans import design
from tidemark.plans.analytics_queries import PAIRS, S
from tidemark.plans.core import query, r8
from tidemark.plans.model_queries import M, P, SEED, _each_series, _factors, _train, tasks
from tidemark.plans.scores import CONDITION, METHODS, scores
from tidemark.sources import files
from tidemark.sources.batch_sink import write_batch_once
from tidemark.sources.groups import groups
from tidemark.sources.shared import cut, shared_folder
from tidemark.sources.tables import FAMILIES, FAMILIES_SQL, families, priority_monthly, read


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _long(spark, d):
    return priority_monthly(spark, d).select("series_id", "ts", "t", "y")


# -- readers and sinks --------------------------------------------------------------------------------------------------


@query("A03_configured_loader", f"{P} SELECT series_id, count(*) AS n FROM series GROUP BY 1 HAVING count(*) >= 20")
def configured_loader(spark, d):
    """A table for each configured entry: one whose column is missing or that is too short is passed over."""
    path = _place(spark, "configured")
    _long(spark, d).write.partitionBy("series_id").csv(path, header=True)
    found = files.configured(spark, [{"path": path, "value": "y"}, {"path": path, "value": "absent"}, {"path": f"{path}-absent", "value": "y"}])
    return found.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20")


@query("A05_group_loader", f"{P} SELECT series_id AS unique_id, count(*) AS n, round(sum(y), 6) AS total FROM series GROUP BY 1")
def group_loader(spark, d):
    """Series stored by (source, frequency): only the wanted group's files are read."""
    path = _place(spark, "groups")
    both = _long(spark, d).withColumn("source", F.lit("orders")).withColumn("frequency", F.lit("Monthly"))
    both = both.unionByName(both.withColumn("frequency", F.lit("Quarterly")).withColumn("y", -F.col("y")))
    both.withColumnRenamed("series_id", "unique_id").write.partitionBy("source", "frequency").parquet(path)
    group = files.read_group(spark, path, "orders", "Monthly")
    return group.groupBy("unique_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 6).alias("total"))


@query("A06_coerced_group", f"{P} SELECT series_id AS unique_id, count(*) AS n FROM series GROUP BY 1")
def coerced_group(spark, d):
    """As A05 with values as text: what isn't a number is dropped."""
    path = _place(spark, "texts")
    text = _long(spark, d).select(F.col("series_id").alias("unique_id"), "ts", F.col("y").cast("string").alias("y"))
    bad = text.withColumn("y", F.lit("n/a"))
    text.unionByName(bad).withColumn("source", F.lit("orders")).withColumn("frequency", F.lit("Monthly")).write.partitionBy("source", "frequency").parquet(path)
    return files.read_group(spark, path, "orders", "Monthly").groupBy("unique_id").agg(F.count(F.lit(1)).alias("n"))


@query("A13_json_config", "SELECT 12 AS particles, 40 AS rounds, true AS missing_is_empty")
def json_config(spark, d):
    path = _place(spark, "config")
    spark.createDataFrame([(12, 40)], "particles int, rounds int").write.json(path)
    config = files.read_config(spark, path)
    return spark.createDataFrame([(int(config["particles"]), int(config["rounds"]), files.read_config(spark, f"{path}-absent") == {})], "particles int, rounds int, missing_is_empty boolean")


@query("A14_ablation_folder", f"{S} SELECT family, series, rule, method, rmse FROM scores")
def ablation_folder(spark, d):
    """A document a file, as a runner writes them."""
    path = _place(spark, "documents")
    nested = scores(spark, d).select(F.lit("success").alias("status"), F.struct(*CONDITION, "method").alias("task"), F.struct("rmse").alias("metrics"))
    nested.write.option("maxRecordsPerFile", 1).json(path)
    found = files.read_results(spark, path)
    return found.select("task.family", "task.series", "task.rule", "task.method", "metrics.rmse")


@query("A17_snapshot", "WITH f AS (SELECT n_regionkey AS name, sha256(string_agg(n_name || chr(10), '' ORDER BY n_name)) AS sha256, CAST(sum(length(n_name) + 1) AS BIGINT) AS size FROM nation GROUP BY 1) SELECT name, size, sha256, 0 AS differing, name = 0 AS found_when_changed FROM f")
def snapshot(spark, d):
    """Files (the nations of each region) by size and SHA-256 against a stored list; a changed entry is found."""
    path, stored = _place(spark, "snapshot"), _place(spark, "list")
    read(spark, d, "nation").select("n_regionkey", F.col("n_name").alias("value")).repartitionById(8, F.col("n_regionkey").cast("int")).sortWithinPartitions("n_regionkey", "value").write.partitionBy("n_regionkey").text(path)
    listed = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("n_regionkey").cast("int").alias("region"))
    listed.write.parquet(stored)
    expected = spark.read.parquet(stored)
    changed = expected.withColumn("sha256", F.when(F.col("region") == 0, "0").otherwise(F.col("sha256"))).drop("region")
    same, other = files.verify_files(spark, path, expected.drop("region")), files.verify_files(spark, path, changed)
    wrong = other.filter("sha256 = '0'").select("size", "name").join(expected, ["name", "size"]).select("region").distinct().withColumn("hit", F.lit(True))
    found = expected.join(wrong, "region", "left").select(F.col("region").alias("name"), "size", "sha256", F.coalesce("hit", F.lit(False)).alias("found_when_changed"))
    return found.crossJoin(same.agg(F.count(F.lit(1)).cast("int").alias("differing")))


@query("A20_csv_sinks", f"{P} SELECT series_id, t, round(y, 8) AS y FROM series")
def csv_sinks(spark, d):
    path = _place(spark, "csv")
    _long(spark, d).select("series_id", "t", "y").write.csv(path, header=True)
    return spark.read.schema("series_id string, t int, y double").csv(path, header=True).select("series_id", "t", r8("y").alias("y"))


@query("A21_summary_sink", f"{S} SELECT count(*) AS n, round(avg(rmse), 8) AS rmse FROM scores")
def summary_sink(spark, d):
    path = _place(spark, "summary")
    scores(spark, d).agg(F.count(F.lit(1)).alias("n"), F.avg("rmse").alias("rmse")).write.json(path)
    return spark.read.schema("n bigint, rmse double").json(path).select("n", r8("rmse").alias("rmse"))


@query("A22_metrics_sinks", f"{S} SELECT method, count(*) AS n, round(avg(rmse), 8) AS rmse FROM scores GROUP BY 1")
def metrics_sinks(spark, d):
    path = _place(spark, "metrics")
    scores(spark, d).write.csv(f"{path}/metrics", header=True)
    back = spark.read.schema("family string, series string, rule string, method string, mae double, rmse double, mase double, smape double, rmsse double").csv(f"{path}/metrics", header=True)
    return back.groupBy("method").agg(F.count(F.lit(1)).alias("n"), r8(F.avg("rmse")).alias("rmse"))


@query("A23_write_once_resume", f"{S} SELECT count(*) AS n, 2 AS batches, true AS refuses FROM scores")
def write_once_resume(spark, d):
    """Results in batches that are never written over; a second start does only what is pending."""
    path = _place(spark, "results")
    every = scores(spark, d).select(F.concat_ws("|", *CONDITION, "method").alias("run_id"), "rmse")
    files.write_batch(every.filter("run_id LIKE '%drift'"), path, 0)
    files.write_batch(design.pending(every, spark.read.parquet(f"{path}/batch=0")), path, 1)
    try:
        files.write_batch(every, path, 1)
        refuses = False
    except Exception as e:
        refuses = "ALREADY_EXISTS" in str(e) or "already exists" in str(e)
    done = spark.read.parquet(path)
    return done.agg(F.countDistinct("run_id").alias("n"), F.countDistinct("batch").cast("int").alias("batches")).withColumn("refuses", F.lit(refuses))


@query("A23_batch_commits", "SELECT CAST(c_custkey % 3 AS INTEGER) AS batch, count(*) AS n, sum(c_custkey) AS total, count(DISTINCT c_mktsegment) AS segments, c_custkey % 3 = 1 AS refused FROM customer GROUP BY 1, 5")
def batch_commits(spark, d):
    """Batches by the sink that commits: what each holds, and which one refused a second write."""
    path, refused = _place(spark, "commits"), []
    every = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    for k in (0, 1, 2, 1):
        try:
            write_batch_once(every.filter(F.col("c_custkey") % 3 == k), path, k)
        except Exception as e:
            if "already exists" not in str(e):
                raise
            refused.append(k)
    done = spark.read.parquet(path).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("total"), F.countDistinct("c_mktsegment").alias("segments"))
    return done.withColumn("refused", F.col("batch").isin(refused))


@query("A04_group_scan", f"WITH {FAMILIES_SQL} SELECT split_part(series_id, '|', 2) AS series, CAST(n AS BIGINT) AS n, round(avg(y), 8) AS mean, round(max(y) FILTER (WHERE t = n - 1), 8) AS last FROM families WHERE family IN ('orders_priority_monthly', 'orders_segment_monthly') GROUP BY series_id, n")
def group_scan(spark, d):
    """Groups of series as files, read back by the data source: filters on source and frequency choose the files."""
    path = _place(spark, "groups")
    families(spark, d).select("source", "frequency", "series_id", "t", "y").write.partitionBy("source", "frequency").csv(path, header=True)
    some = groups(spark, path).filter(F.col("source").isin("orders", "orders_customer") & (F.col("frequency") == "monthly"))
    by = some.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), r8(F.avg("y")).alias("mean"), r8(F.max_by("y", "t")).alias("last"))
    return by.select(F.split_part("series_id", F.lit("|"), F.lit(2)).alias("series"), "n", "mean", "last")


@query("A24_development_results", "SELECT count(*) AS pending FROM customer WHERE c_custkey % 3 <> 0")
def development_results(spark, d):
    path = _place(spark, "development")
    every = read(spark, d, "customer").select(F.col("c_custkey").alias("run_id"))
    files.write_batch(every.filter("run_id % 3 = 0"), path, 0)
    return design.pending(every, spark.read.parquet(path).select("run_id")).agg(F.count(F.lit(1)).alias("pending"))


@query("A25_verified_manifest", "SELECT count(*) AS n, true AS verified, true AS change_is_found FROM customer")
def verified_manifest(spark, d):
    path = _place(spark, "manifest")
    files.write_manifest(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), path)
    n = files.read_manifest(spark, path).count()
    spark.createDataFrame([(-1, "X")], "c_custkey bigint, c_mktsegment string").write.mode("append").parquet(f"{path}/rows")
    try:
        files.read_manifest(spark, path)
        found = False
    except ValueError:
        found = True
    return spark.createDataFrame([(n, True, found)], "n bigint, verified boolean, change_is_found boolean")


@query("A26_generated_csv", "SELECT 'sine' AS series_name, o_orderkey, i AS t, round(10 * sin(2 * pi() * i / 24) + 3.5 * sin(2 * pi() * i / 24) ** 2 + 0.03 * i, 6) AS value FROM (SELECT o_orderkey, CAST(o_orderkey % 180 AS INTEGER) AS i FROM orders)")
def generated_csv(spark, d):
    path = _place(spark, "generated")
    at = read(spark, d, "orders").select(F.lit("sine").alias("series_name"), "o_orderkey", (F.col("o_orderkey") % 180).cast("int").alias("t"))
    at.withColumn("value", synthetic.sine(F.col("t"))).write.csv(path, header=True)
    return spark.read.schema("series_name string, o_orderkey bigint, t int, value double").csv(path, header=True).withColumn("value", F.round("value", 6))


@query("A30_ablation_json", f"{S} SELECT family, series, rule, method, mase FROM scores")
def ablation_json(spark, d):
    path = _place(spark, "ablation")
    scores(spark, d).select(*CONDITION, "method", "mase").write.mode("errorifexists").json(path)
    return spark.read.schema("family string, series string, rule string, method string, mase double").json(path)


# -- small rules ----------------------------------------------------------------------------------------------------------


@query("B06_direction", f"{S}, by_name AS (SELECT method, name, avg(value) AS mean FROM (SELECT method, mae, mase, smape, -mase AS r2 FROM scores) UNPIVOT (value FOR name IN (mae, mase, smape, r2)) GROUP BY 1, 2) SELECT name AS metric, name <> 'r2' AS lower_is_better, CASE WHEN name <> 'r2' THEN min_by(method, mean) ELSE max_by(method, mean) END AS best FROM by_name GROUP BY 1")
def direction(spark, d):
    """Of each metric the better direction, and the method that is best by it (less the scaled error stands in for r2)."""
    long = scores(spark, d).withColumn("r2", -F.col("mase")).unpivot("method", ["mae", "mase", "smape", "r2"], "metric", "value").groupBy("method", "metric").agg(F.avg("value").alias("mean"))
    lower = F.col("metric").isin([m for m in ("mae", "mase", "smape", "r2") if ranking.lower_is_better(m)])
    by = long.groupBy("metric").agg(F.min_by("method", "mean").alias("least"), F.max_by("method", "mean").alias("most"))
    return by.select("metric", lower.alias("lower_is_better"), F.when(lower, F.col("least")).otherwise(F.col("most")).alias("best"))


@query("B13_quality_gate", "SELECT 10 AS kept, true AS refuses_bad")
def quality_gate(spark, d):
    """Tasks without a broken rule pass; a set with one is refused."""
    from tidemark.operators.checks import accepted

    p = fitting.predictions(tasks(spark, d, ["naive_1", "drift"]), M)
    kept = accepted(p)
    try:
        accepted(p.withColumn("status", F.when(F.col("t") % 2 == 0, "failed").otherwise(F.col("status"))))
        refuses = False
    except ValueError:
        refuses = True
    return kept.agg(F.countDistinct("series_id", "method").cast("int").alias("kept")).withColumn("refuses_bad", F.lit(refuses))


@query("G07_head", f"{S} SELECT family, series, rule, method, rmse FROM scores ORDER BY rmse, family, series, rule, method LIMIT 5")
def head(spark, d):
    return scores(spark, d).select(*CONDITION, "method", "rmse").orderBy("rmse", *CONDITION, "method").limit(5)


NUMBERS = "SELECT unnest(['1e-06', '1e-05', '0.0001', '0.001', '0.01', '0.05', '0.1']) AS alpha"


@query("I12_development_run_id", f"""SELECT sha256('{{"alpha":"' || alpha || '","dgp_seed":' || dgp_seed || ',"generator":"' || generator || '","namespace":"development","noise_level":"' || noise_level || '","optimizer_seed":' || optimizer_seed || ',"radius":"' || radius || '"}}') AS run_id, generator, CAST(dgp_seed AS INTEGER) AS dgp_seed, CAST(optimizer_seed AS INTEGER) AS optimizer_seed
FROM (SELECT unnest([{", ".join(f"'{g}'" for g in design.GENERATORS)}]) AS generator), range(1001, 1011) a(dgp_seed), (SELECT unnest(['0.05', '0.1', '0.2']) AS noise_level), (SELECT unnest(['0.25', '0.35', '0.55', '0.75', '1.0']) AS radius), ({NUMBERS}), range(31001, 31004) o(optimizer_seed)""")
def development_run_id(spark, d):
    return design.development_tasks(spark).select("run_id", "generator", "dgp_seed", "optimizer_seed")


@query("I14_file_fingerprint", "WITH f AS (SELECT r_name AS name, string_agg(n_name || chr(10), '' ORDER BY n_name) AS content FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1) SELECT sha256(string_agg(name || chr(0) || content || chr(0), '' ORDER BY name)) AS fingerprint FROM f")
def file_fingerprint(spark, d):
    """Names and contents of files, each with a zero byte after it, hashed in order of the names: the nations of each region in a file."""
    path = _place(spark, "inputs")
    both = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    both.select("r_name", F.col("n_name").alias("value")).repartition(1).sortWithinPartitions("r_name", "value").write.partitionBy("r_name").text(path)
    parts = spark.read.format("binaryFile").load(path).select(F.col("r_name").alias("name"), "content")
    one = F.concat(F.col("name").cast("binary"), F.lit(b"\0"), "content", F.lit(b"\0"))
    joined = parts.agg(F.array_sort(F.collect_list(F.struct("name", one.alias("bytes")))).alias("all"))
    return joined.select(F.sha2(F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, x["bytes"])), 256).alias("fingerprint"))


@query("I21_json_safe", f"{S} SELECT '{{\"method\":\"' || method || '\",\"n\":' || count(*) || '}}' AS line, count(*) FILTER (WHERE NOT isfinite(rmse)) AS refused FROM scores GROUP BY method")
def json_safe(spark, d):
    """Rows as JSON; rows with a number that isn't finite are counted instead."""
    s = scores(spark, d)
    bad = F.isnan("rmse") | (F.abs("rmse") == float("inf"))
    g = s.groupBy("method").agg(F.count_if(~bad).alias("n"), F.count_if(bad).alias("refused"))
    return g.select(F.to_json(F.struct("method", "n")).alias("line"), "refused")


@query("P17_condition_columns", "SELECT unnest(['family', 'rule', 'series']) AS condition")
def condition_columns(spark, d):
    found = ranking.condition_columns(scores(spark, d).withColumn("constant", F.lit(1)), ["family", "series", "rule", "constant", "absent"])
    return spark.createDataFrame([(c,) for c in found], "condition string")


@query("N13_reference_model", f"{S} SELECT method AS reference FROM scores GROUP BY 1 ORDER BY avg(mase), method LIMIT 1")
def reference_model(spark, d):
    """The wanted model where it's there, else the best one by the mean."""
    return ranking.reference_model(scores(spark, d), "method", "mase", wanted="absent")


@query("P16_report_per_metric", f"{S}, l AS (SELECT method, 'rmse' AS metric, rmse AS v FROM scores UNION ALL SELECT method, 'mase', mase FROM scores) SELECT metric, method, count(*) AS n, round(avg(v), 8) AS mean FROM l GROUP BY 1, 2")
def report_per_metric(spark, d):
    """One report over all metrics, as one aggregation of the long table."""
    s = scores(spark, d)
    return s.unpivot([*CONDITION, "method"], ["rmse", "mase"], "metric", "v").groupBy("metric", "method").agg(F.count("v").alias("n"), r8(F.avg("v")).alias("mean"))


# -- dynamic models -------------------------------------------------------------------------------------------------------


def _adaptive(y):
    x, _ = forecasters.lagged((y - y.mean()) / y.std(), 2)
    center, width = fuzzy.subtractive_adaptive(x, 0.8, 5)
    return {"number": np.arange(len(center), dtype=np.int32), "center": list(center), "width": width[:, 0]}


def _quality(y):
    x, _ = forecasters.lagged((y - y.mean()) / y.std(), 2)
    rows = [(r, fuzzy.cluster_quality(x, *fuzzy.subtractive_adaptive(x, r, 5))) for r in (0.4, 0.8, 1.2)]
    return pd.DataFrame(rows, columns=["radius", "quality"])


def _design(y):
    x, _ = forecasters.lagged((y - y.mean()) / y.std(), 2)
    phi = fuzzy.dynamic_design(x, *fuzzy.subtractive_raw(x, 0.8, 5))
    shares = phi.reshape(len(x), -1, 3)[:, :, 0].sum(axis=1)
    return {"row": np.arange(len(x), dtype=np.int32), "phi": list(phi), "shares": shares}


def _candidates(y):
    near, far, *_ = neurofuzzy.prepare(_train(y), 5)
    start = fuzzy.initial(*near, 1.0)
    rows = [(f, neurofuzzy.evaluate(start, start.vector() * f, near, far)[1]) for f in (0.8, 1.0, 1.2)]
    return pd.DataFrame(rows, columns=["factor", "objective"])


def _swarm_start(y):
    near, *_ = neurofuzzy.prepare(_train(y), 5)
    at, used = swarm.dynamic_start(near[0], 15, 12, 0.15, 1.2, np.random.default_rng(3))
    return {"particle": np.arange(12, dtype=np.int32), "position": list(at), "used": used}


def _decoded(y):
    near, *_ = neurofuzzy.prepare(_train(y), 5)
    at, used = swarm.dynamic_start(near[0], 15, 12, 0.15, 1.2, np.random.default_rng(3))
    parts = [swarm.decode(p, 15, 5, used) for p in at]
    return {"particle": np.arange(12, dtype=np.int32), "radius": [p[0] for p in parts], "centers": [p[1].ravel() for p in parts], "widths": [p[2].ravel() for p in parts]}


def _standardised(y):
    """A regressor behind a scaler that was fitted to the training rows alone."""
    x, target = forecasters.lagged(y, 5)
    split = len(_train(y)) - 5
    mean, sd = x[:split].mean(axis=0), x[:split].std(axis=0)
    model = forecasters.Ridge((x[:split] - mean) / sd, target[:split], 1.0)
    return {"t": np.arange(split + 5, len(y), dtype=np.int32), "predicted": model.predict((x[split:] - mean) / sd), "actual": target[split:]}


for _id, _schema, _f in (
    ("K03b_adaptive_clusters", "number int, center array<double>, width double", _adaptive),
    ("K03c_cluster_quality", "radius double, quality double", _quality),
    ("K15_dynamic_design", "row int, phi array<double>, shares double", _design),
    ("K16_candidates", "factor double, objective double", _candidates),
    ("L04_swarm_start", "particle int, position array<double>, used int", _swarm_start),
    ("L05_decoded_particles", "particle int, radius double, centers array<double>, widths array<double>", _decoded),
    ("M10b_standardised_regression", "t int, predicted double, actual double", _standardised),
):
    query(_id)(_each_series(_schema, _f))


@query("O12_stored_clean_series", "SELECT 3 AS levels, 1 AS distinct_clean, 540 AS n")
def stored_clean_series(spark, d):
    """A clean series is made once and joined with its noise levels; all levels share it."""
    p = synthetic.panel(_factors(spark, ["linear_ar"], [1001], [0.05, 0.1, 0.2]))
    packed = p.groupBy("noise_level").agg(F.array_sort(F.collect_list(F.struct("t", "clean"))).alias("all"))
    n = p.agg(F.count(F.lit(1)).cast("int").alias("n"))
    return packed.agg(F.count(F.lit(1)).cast("int").alias("levels"), F.countDistinct(F.xxhash64("all")).cast("int").alias("distinct_clean")).crossJoin(n)


@query("O20_relative_noise")
def relative_noise(spark, d):
    """Noise in shares of each series' own spread, one at least; level 0 is the series itself."""
    def noisy(y):
        return pd.concat([pd.DataFrame({"level": level, "t": np.arange(len(y), dtype=np.int32), "y": generators.with_noise(y, level, 7)}) for level in (0.0, 0.1)])

    return _each_series("level double, t int, y double", noisy)(spark, d)


# -- runners ----------------------------------------------------------------------------------------------------------------


@query("M07_aliases", "SELECT alias, 'naive_1' AS method FROM (SELECT unnest(['naive', 'persistence', 'naive_1']) AS alias)")
def aliases(spark, d):
    return spark.createDataFrame([(a, forecasters.method_name(a)) for a in ("naive", "persistence", "naive_1")], "alias string, method string")


@query("M08_many_models", f"{P} SELECT series_id, method, CASE method WHEN 'absent' THEN 'failed' ELSE 'success' END AS status, n - CAST(floor(0.8::DOUBLE * n) AS INTEGER) AS steps FROM (SELECT DISTINCT series_id, n FROM series), (SELECT unnest(['naive_1', 'drift', 'theta', 'absent']) AS method)")
def many_models(spark, d):
    """Many models at once; one that fails gives rows that say so and stops nothing."""
    p = fitting.predictions(tasks(spark, d, ["naive_1", "drift", "theta", "absent"]), M)
    return p.groupBy("series_id", "method", "status").agg(F.count(F.lit(1)).cast("int").alias("steps"))


@query("Q04_development_execution", f"{P} SELECT DISTINCT series_id, method, 'success' AS status FROM series, (SELECT unnest(['PC', 'NF_BASE']) AS method)")
def development_execution(spark, d):
    return fitting.predictions(tasks(spark, d, ["PC", "NF_BASE"], [31001]), M).select("series_id", "method", "status").distinct()


@query("Q06_pending_runner", f"{P} SELECT method, count(DISTINCT series_id) AS n FROM series, (SELECT unnest(['naive_1', 'drift', 'theta']) AS method) GROUP BY 1")
def pending_runner(spark, d):
    """Two starts: the second runs what the first left, and together they have every task once."""
    path = _place(spark, "runs")
    every = tasks(spark, d, ["naive_1", "drift", "theta"]).withColumn("run_id", F.concat_ws("|", "series_id", "method"))
    for batch, work in enumerate((every.filter("method = 'drift'"), every)):
        todo = work if batch == 0 else design.pending(work, spark.read.parquet(path).select("run_id"))
        done = fitting.predictions(todo, M).withColumn("run_id", F.concat_ws("|", "series_id", "method"))
        files.write_batch(done, path, batch)
    return spark.read.parquet(path).groupBy("method").agg(F.countDistinct("series_id").alias("n"))


@query("Q12_ablation_variant", f"{P} SELECT DISTINCT series_id, 'NO_COVERAGE' AS method, 'success' AS status FROM series")
def ablation_variant(spark, d):
    return fitting.predictions(tasks(spark, d, ["NO_COVERAGE"], SEED), M).select("series_id", "method", "status").distinct()


SEASONS = sorted({m for *_, m in FAMILIES})
ELIGIBLE_FAMILIES = f"""WITH {FAMILIES_SQL},
steps AS (SELECT *, y - CASE m {" ".join(f"WHEN {m} THEN lag(y, {m}) OVER w" for m in SEASONS)} END AS step, CAST(floor(0.8 * n) AS INTEGER) AS split
  FROM families WINDOW w AS (PARTITION BY series_id ORDER BY t)),
facts AS (SELECT family, m, series_id, max(n) AS n, max(split) AS split, avg(abs(step)) FILTER (WHERE t < split) AS scale FROM steps GROUP BY ALL),
judged AS (SELECT family, series_id, CAST(n AS INTEGER) AS n, CAST(split AS INTEGER) AS split_index,
  CASE WHEN n < 40 OR n > 180 THEN 'length' WHEN n - split < 8 THEN 'test_size' WHEN split - least(12, greatest(5, m)) < 20 THEN 'supervised_rows'
    WHEN scale IS NULL OR scale <= 1e-12 THEN 'scale' ELSE 'eligible' END AS eligible_reason FROM facts)"""


def judged(every):
    """series_id, n, split_index, scale, eligible_reason of all families, each with its own season."""
    out = None
    for m in SEASONS:
        part = selection.eligibility(every.filter(F.col("m") == m), m)
        out = part if out is None else out.unionByName(part)
    return out


def eligible(every):
    return every.join(judged(every).filter("eligible_reason = 'eligible'").select("series_id"), "series_id", "left_semi")


@query("B07_eligibility_of_families", f"{ELIGIBLE_FAMILIES} SELECT * FROM judged")
def eligibility_of_families(spark, d):
    """All families of real series; those of days are too short, on few orders those of nations as well."""
    family = F.element_at(F.split("series_id", r"\|"), 1).alias("family")
    return judged(cut(families(spark, d))).select(family, "series_id", "n", "split_index", "eligible_reason")


@query("Q14_real_benchmark")
def real_benchmark(spark, d):
    """Baselines on the eligible series of all real families, each with its own season; errors by family and method."""
    every, out = cut(eligible(cut(families(spark, d)))), None
    for m in SEASONS:
        mine = every.filter(F.col("m") == m)
        p = fitting.predictions(fitting.tasks(mine, ["naive_1", "seasonal_naive", "drift", "theta"]), m).filter("status = 'success'")
        scale = metrics.scales(mine, m, F.col("t") < F.floor(F.col("n") * 0.8))
        scored = metrics.final(p.join(scale, "series_id"), "series_id", "method")
        out = scored if out is None else out.unionByName(scored)
    return out.groupBy(F.element_at(F.split("series_id", r"\|"), 1).alias("family"), "method").agg(F.avg("mase").alias("mase"), F.avg("rmse").alias("rmse"), F.count(F.lit(1)).alias("n"))


@query("Q15_synthetic_benchmark")
def synthetic_benchmark(spark, d):
    p = synthetic.panel(_factors(spark, ["linear_ar", "noisy_seasonal"], [1001, 1002], [0.05, 0.1]))
    series = p.select(F.concat_ws("|", "generator", "seed", "noise_level").alias("series_id"), "t", "y")
    done = fitting.predictions(fitting.tasks(series, ["naive_1", "drift", "theta", "ridge"]), M)
    return done.groupBy(F.element_at(F.split("series_id", r"\|"), 1).alias("generator"), "method").agg(F.sqrt(F.avg(F.pow(F.col("actual") - F.col("predicted"), 2))).alias("rmse"), F.countDistinct("series_id").alias("n"))


@query("Q18_synthetic_grid")
def synthetic_grid(spark, d):
    """The neuro-fuzzy grid over generated series, put together with the baselines' rows."""
    p = synthetic.panel(_factors(spark, ["linear_ar", "noisy_seasonal"], [1001], [0.1]))
    series = p.select(F.concat_ws("|", "generator", "seed", "noise_level").alias("series_id"), "t", "y")
    nf, base = fitting.predictions(fitting.tasks(series, ["NF_BASE", "PC"], [1, 2]), M), fitting.predictions(fitting.tasks(series, ["naive_1"]), M)
    return nf.unionByName(base).groupBy("series_id", "method", "seed").agg(F.sqrt(F.avg(F.pow(F.col("actual") - F.col("predicted"), 2))).alias("rmse"))


@query("Q19_budget_sweep")
def budget_sweep(spark, d):
    """Particles x rounds x seeds: a plain product of tasks."""
    budgets = spark.createDataFrame([(6, 10), (12, 20), (12, 40)], "particles int, rounds int")
    every = tasks(spark, d, ["PC"], [1, 2]).crossJoin(F.broadcast(budgets))

    def run(batches):
        for batch in batches:
            for task in batch.itertuples():
                y = np.asarray(task.y, float)
                got = neurofuzzy.fit(y[: task.n_train], forecasters.lags_for(M), seed=task.seed, particles=task.particles, rounds=task.rounds)
                yield pd.DataFrame({"series_id": [task.series_id], "particles": [task.particles], "rounds": [task.rounds], "seed": [task.seed], "objective": [got.objective], "rmse": [fuzzy.rmse(y[task.n_train :], got.forecast(y[task.n_train :]))]})

    return fitting.spread(every).mapInPandas(run, "series_id string, particles int, rounds int, seed int, objective double, rmse double")


@query("Q24_short_series", f"{P}, ok AS (SELECT DISTINCT series_id, n FROM series WHERE n BETWEEN 40 AND 180) SELECT count(*) AS candidates, max(n) AS longest FROM ok")
def short_series(spark, d):
    """Candidates by length, of which a seeded generator then picks (G06)."""
    return priority_monthly(spark, d).filter("n BETWEEN 40 AND 180").select("series_id", "n").distinct().agg(F.count(F.lit(1)).alias("candidates"), F.max("n").alias("longest"))


@query("Q02_final_tasks_with_real", f"{ELIGIBLE_FAMILIES} SELECT domain, count(*) AS n FROM (SELECT 'synthetic' AS domain FROM range(7140) UNION ALL SELECT 'real' FROM judged, range(14) WHERE eligible_reason = 'eligible') GROUP BY 1")
def final_tasks_with_real(spark, d):
    """The final design over generated and eligible real series: five seeds and nine baselines a series, the season known."""
    real = eligible(cut(families(spark, d))).select("source", "frequency", "series_id", F.col("m").alias("seasonal_period")).distinct()
    return design.final_tasks(spark, real).groupBy("domain").agg(F.countDistinct("run_id").alias("n"))


# -- tables -------------------------------------------------------------------------------------------------------------------


@query("T04_latex_rows", f"{S} SELECT method, '  ' || replace(method, '_', '\\_') || ' & ' || printf('%.4f', avg(rmse)) || ' \\\\' AS line FROM scores GROUP BY 1")
def latex_rows(spark, d):
    s = scores(spark, d).groupBy("method").agg(F.avg("rmse").alias("rmse"))
    return s.select("method", F.concat(F.lit("  "), reporting.latex_cell("method"), F.lit(" & "), F.format_string("%.4f", "rmse"), F.lit(" \\\\")).alias("line"))


@query("T07_longtable_rows", f"{S} SELECT family, series, row_number() OVER (PARTITION BY family, series ORDER BY method) AS place, method, printf('%.3f', avg(rmse)) AS rmse, printf('%.3f', avg(mase)) AS mase FROM scores GROUP BY family, series, method")
def longtable_rows(spark, d):
    s = scores(spark, d).groupBy("family", "series", "method").agg(F.format_string("%.3f", F.avg("rmse")).alias("rmse"), F.format_string("%.3f", F.avg("mase")).alias("mase"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("family", "series").orderBy("method")).cast("bigint"))


@query("T08_series_table", f"{S} SELECT series, method, printf('%.4f', rmse) AS rmse, printf('%.2f', smape) AS smape FROM scores WHERE family = 'priority' AND rule = 'f80'")
def series_table(spark, d):
    s = scores(spark, d).filter("family = 'priority' AND rule = 'f80'")
    return s.select("series", "method", F.format_string("%.4f", "rmse").alias("rmse"), F.format_string("%.2f", "smape").alias("smape"))


@query("T11_sorted_summary", f"{S} SELECT method, round(avg(rmse), 8) AS mean, round(stddev_samp(rmse), 8) AS std, round(median(rmse), 8) AS median FROM scores GROUP BY 1 ORDER BY mean")
def sorted_summary(spark, d):
    return scores(spark, d).groupBy("method").agg(r8(F.avg("rmse")).alias("mean"), r8(F.stddev_samp("rmse")).alias("std"), r8(F.median("rmse")).alias("median")).orderBy("mean")


@query("P10_sums", f"{PAIRS}, d AS (SELECT a - b AS d, abs(a - b) AS m FROM pairs WHERE a <> b), r AS (SELECT d, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS r FROM d) SELECT count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0.0) AS w_plus, coalesce(sum(r) FILTER (WHERE d < 0), 0.0) AS w_minus FROM r")
def wilcoxon_sums(spark, d):
    from tidemark.operators import inference

    return inference.signed_ranks(ranking.paired(scores(spark, d), CONDITION, "method", "mase", "seasonal_naive", "naive_1")).select("n", "w_plus", "w_minus")
