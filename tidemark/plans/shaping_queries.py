"""Queries of sources, guards, shaping and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.operators import shaping
from tidemark.plans.core import query, r8
from tidemark.sources.tables import PRIORITY_SQL, SEGMENT_SQL, events_4h, priority_monthly, read, segment_monthly

P = f"WITH {PRIORITY_SQL} "
LAGS = "".join(f", lag(y, {k}) OVER w AS x{i}" for i, k in enumerate(range(5, 0, -1), 1))


@query("A01_validated_series", f"{P} SELECT series_id, ts AS date, round(y, 8) AS revenue FROM series WHERE y IS NOT NULL AND isfinite(y)")
def validated_series(spark, d):
    from tidemark.sources.files import validated

    raw = priority_monthly(spark, d).select("series_id", F.col("ts").cast("string").alias("date"), F.col("y").cast("string").alias("revenue"))
    return validated(raw, "date", "revenue", "series_id").select("series_id", "date", r8("revenue").alias("revenue"))


@query("A02_generic_series", f"{P} SELECT series_id, ts AS date, round(y, 8) AS value FROM series")
def generic_series(spark, d):
    from tidemark.sources.files import generic

    raw = priority_monthly(spark, d).select("series_id", F.col("ts").alias("month"), F.col("y").alias("amount"), F.lit("x").alias("note"))
    return generic(raw, key="series_id").select("series_id", F.col("date").cast("date").alias("date"), r8("value").alias("value"))


@query("A08_train_test", f"{P} SELECT series_id, t, t >= floor(0.8 * n) AS is_test FROM series")
def train_test(spark, d):
    return priority_monthly(spark, d).select("series_id", "t", (F.col("t") >= rules.floor_split(F.col("n"))).alias("is_test"))


@query("A09_long_scan", f"{P} SELECT series_id, count(*) AS n, round(sum(y * (t + 1)), 6) AS weighted FROM series GROUP BY 1 HAVING count(*) BETWEEN 40 AND 180")
def long_scan(spark, d):
    from tidemark.sources.files import gather

    packed = gather(priority_monthly(spark, d), "series_id", "ts", "y").filter("size(y) BETWEEN 40 AND 180")
    weighted = F.expr("aggregate(transform(y, (v, i) -> v * (i + 1)), 0D, (a, b) -> a + b)")
    return packed.select("series_id", F.size("y").cast("bigint").alias("n"), F.round(weighted, 6).alias("weighted"))


@query("A10_wide_scan", f"{P} SELECT series_id, t, round(y, 8) AS y FROM series WHERE t < 12")
def wide_scan(spark, d):
    from tidemark.sources.files import narrow

    wide = priority_monthly(spark, d).filter("t < 12").groupBy("series_id").pivot("t", list(range(12))).agg(F.first("y"))
    return narrow(wide, "series_id").select("series_id", F.col("t").cast("int").alias("t"), r8("y").alias("y"))


@query("A27_revenue_schema", f"{P} SELECT series_id, ts AS date, round(y, 8) AS value, round(y, 8) AS revenue_million_yer FROM series")
def revenue_schema(spark, d):
    out = priority_monthly(spark, d).select("series_id", F.col("ts").alias("date"), r8("y").alias("value"))
    return out.withColumn("revenue_million_yer", F.col("value"))


@query("B01_finite", f"{P} SELECT series_id, count(*) AS n FROM series WHERE y IS NOT NULL AND isfinite(y) GROUP BY 1 HAVING count(*) >= 3")
def finite(spark, d):
    return shaping.finite_only(priority_monthly(spark, d)).groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


@query("B02_finite_guard", "SELECT event_type, count(*) FILTER (WHERE value IS NULL OR NOT isfinite(value)) AS bad FROM events GROUP BY 1")
def finite_guard(spark, d):
    v = F.col("value")
    return read(spark, d, "events").groupBy("event_type").agg(F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("bad"))


ELIGIBLE = """
, steps AS (SELECT *, y - lag(y, 12) OVER (PARTITION BY series_id ORDER BY t) AS step, CAST(floor(0.8 * n) AS INTEGER) AS split FROM {series}),
facts AS (SELECT series_id, max(n) AS n, max(split) AS split, avg(abs(step)) FILTER (WHERE t < split) AS scale FROM steps GROUP BY 1)
SELECT series_id, CAST(n AS INTEGER) AS n, CAST(split AS INTEGER) AS split_index, CASE WHEN n < 40 OR n > 180 THEN 'length' WHEN n - split < 8 THEN 'test_size'
  WHEN split - 12 < 20 THEN 'supervised_rows' WHEN scale IS NULL OR scale <= 1e-12 THEN 'scale' ELSE 'eligible' END AS eligible_reason FROM facts"""


@query("B07_eligibility", f"WITH {SEGMENT_SQL} {ELIGIBLE.format(series='segments')}")
def eligibility(spark, d):
    from tidemark.operators.selection import eligibility as op

    return op(segment_monthly(spark, d), m=12).select("series_id", "n", "split_index", "eligible_reason")


@query("B08_short_series", f"WITH {SEGMENT_SQL} SELECT series_id, count(*) AS n FROM segments GROUP BY 1 HAVING count(*) BETWEEN 40 AND 180")
def short_series(spark, d):
    return shaping.finite_only(segment_monthly(spark, d)).groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).filter("n BETWEEN 40 AND 180")


@query("B09_exclusions", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'FURNITURE')")
def exclusions(spark, d):
    gone = spark.createDataFrame([("MACHINERY",), ("FURNITURE",)], "c_mktsegment string")
    return read(spark, d, "customer").join(F.broadcast(gone), "c_mktsegment", "left_anti").select("c_custkey", "c_mktsegment")


@query("B15_flatten", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k FROM events")
def flatten(spark, d):
    from tidemark.operators.reporting import flatten as op

    nested = read(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return op(nested)


@query("B17_label_map", "SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' ELSE o_orderpriority END AS label, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 999 END AS sort_key FROM orders GROUP BY 1")
def label_map(spark, d):
    from tidemark.operators.reporting import label

    names = read(spark, d, "orders").select("o_orderpriority").distinct()
    return label(names, "o_orderpriority", {"1-URGENT": "urgent", "2-HIGH": "high"})


@query("C01_lag_embedding", f"{P} SELECT * FROM (SELECT series_id, t{LAGS}, y AS target FROM series WINDOW w AS (PARTITION BY series_id ORDER BY t)) WHERE t >= 5")
def lag_embedding(spark, d):
    return shaping.lag_columns(priority_monthly(spark, d), 5).select("series_id", "t", *(f"x{i}" for i in range(1, 6)), "target")


@query("C01_lag_embedding_reversed", f"{P} SELECT * FROM (SELECT series_id, t, lag(y, 1) OVER w AS x1, lag(y, 2) OVER w AS x2, lag(y, 3) OVER w AS x3, y AS target FROM series WINDOW w AS (PARTITION BY series_id ORDER BY t)) WHERE t >= 3")
def lag_embedding_reversed(spark, d):
    return shaping.lag_columns(priority_monthly(spark, d), 3, newest_first=True).select("series_id", "t", "x1", "x2", "x3", "target")


@query("C02_lag_array", f"{P} SELECT * FROM (SELECT series_id, t, lag(y, 4) OVER w AS oldest, lag(y, 1) OVER w AS newest, CAST(4 AS INTEGER) AS size, y AS target FROM series WINDOW w AS (PARTITION BY series_id ORDER BY t)) WHERE t >= 4")
def lag_array(spark, d):
    x = shaping.lag_array(priority_monthly(spark, d), 4)
    return x.select("series_id", "t", F.get("x", F.lit(0)).alias("oldest"), F.get("x", F.lit(3)).alias("newest"), F.size("x").alias("size"), "target")


SPLIT = "CAST(floor(0.8::DOUBLE * n) AS INTEGER)"
SCALED = f""", bounds AS (SELECT *, min(y) FILTER (WHERE t < {SPLIT}) OVER (PARTITION BY series_id) AS lo, max(y) FILTER (WHERE t < {SPLIT}) OVER (PARTITION BY series_id) AS hi FROM series)"""


def _in_train():
    return F.col("t") < rules.floor_split(F.col("n"))


@query("C03_scaled_lags", f"{P} {SCALED}, scaled AS (SELECT series_id, t, 0.1 + (y - lo) * (0.8 / (hi - lo)) AS s FROM bounds) SELECT * FROM (SELECT series_id, t, round(lag(s, 2) OVER w, 8) AS x1, round(lag(s, 1) OVER w, 8) AS x2, round(s, 8) AS target FROM scaled WINDOW w AS (PARTITION BY series_id ORDER BY t)) WHERE t >= 2")
def scaled_lags(spark, d):
    s = shaping.min_max(priority_monthly(spark, d), _in_train())
    return shaping.lag_columns(s.select("series_id", "t", F.col("scaled").alias("y")), 2).select("series_id", "t", r8("x1").alias("x1"), r8("x2").alias("x2"), r8("target").alias("target"))


RULES = {
    "C05_lag_rule": ("least(12, greatest(5, m))", lambda n, m: rules.lags_for_period(m)),
    "C06_supervised_split": ("CAST(floor(0.85::DOUBLE * (n - 5) + 0.5) AS INTEGER)", lambda n, m: rules.supervised_split(n - 5)),
    "C07_round_half_up": ("CAST(floor(n / 2.0 + 0.5) AS INTEGER)", lambda n, m: rules.round_half_up(n / 2)),
    "C08_initial_train": ("CASE WHEN round_even(n * 0.85::DOUBLE, 0) BETWEEN 10 AND n - 1 THEN CAST(round_even(n * 0.85::DOUBLE, 0) AS INTEGER) END", lambda n, m: rules.initial_train_size(n)),
    "C09_floor_split": ("CAST(floor(0.8::DOUBLE * n) AS INTEGER)", lambda n, m: rules.floor_split(n)),
    "C10_truncated_split": ("CAST(trunc(0.8::DOUBLE * n) AS INTEGER)", lambda n, m: rules.truncated_split(n)),
    "C11_validation_tail": ("CASE WHEN n - 12 - greatest(8, floor(0.2 * (n - 12))) >= 11 THEN CAST(greatest(8, floor(0.2 * (n - 12))) AS INTEGER) END", lambda n, m: rules.tail_size(n, F.lit(12))),
    "C12_inner_validation": ("CASE WHEN least(greatest(5, ceil(0.2::DOUBLE * n)), n - 12 - 10) >= 5 THEN CAST(least(greatest(5, ceil(0.2::DOUBLE * n)), n - 12 - 10) AS INTEGER) END", lambda n, m: rules.inner_validation_size(n, F.lit(12))),
    "C25_effective_lags": ("CASE WHEN n < 25 THEN least(5, 2) ELSE 5 END", lambda n, m: rules.effective_lags(n, F.lit(5))),
}
for _name, (_sql, _rule) in RULES.items():

    def _rule_query(spark, d, rule=_rule):
        keys = read(spark, d, "orders").select((F.col("o_orderkey") + 1).cast("int").alias("n"), (1 + F.col("o_orderkey") % 24).cast("int").alias("m"))
        return keys.select("n", "m", rule(F.col("n"), F.col("m")).alias("size"))

    query(_name, f"SELECT n, m, {_sql} AS size FROM (SELECT CAST(o_orderkey + 1 AS INTEGER) AS n, CAST(1 + o_orderkey % 24 AS INTEGER) AS m FROM orders)")(_rule_query)


@query("C13_inner_split", f"{P}, s AS (SELECT series_id, t, {SPLIT} AS n FROM series) SELECT series_id, t, CASE WHEN t >= n - CASE WHEN least(greatest(5, ceil(0.2::DOUBLE * n)), n - 22) >= 5 THEN least(greatest(5, ceil(0.2::DOUBLE * n)), n - 22) END THEN 'validation' ELSE 'fit' END AS part FROM s WHERE t < n")
def inner_split(spark, d):
    s = priority_monthly(spark, d).withColumn("n", rules.floor_split(F.col("n"))).filter("t < n")
    return s.select("series_id", "t", F.when(F.col("t") >= F.col("n") - rules.inner_validation_size(F.col("n"), F.lit(12)), "validation").otherwise("fit").alias("part"))


@query("C15_min_max", f"{P} {SCALED} SELECT series_id, t, round(0.1 + (y - lo) * (0.8 / (hi - lo)), 8) AS scaled, round(y, 8) AS back FROM bounds")
def min_max(spark, d):
    s = shaping.min_max(priority_monthly(spark, d), _in_train())
    return s.select("series_id", "t", r8("scaled").alias("scaled"), r8(shaping.min_max_inverse(s, "scaled")).alias("back"))


@query("C16_leakage_modes", f"{P} SELECT series_id, round(min(y), 8) AS min_all, round(max(y), 8) AS max_all, round(min(y) FILTER (WHERE t < {SPLIT}), 8) AS min_train, round(max(y) FILTER (WHERE t < {SPLIT}), 8) AS max_train FROM series GROUP BY 1")
def leakage_modes(spark, d):
    train = F.when(_in_train(), F.col("y"))
    return priority_monthly(spark, d).groupBy("series_id").agg(r8(F.min("y")).alias("min_all"), r8(F.max("y")).alias("max_all"), r8(F.min(train)).alias("min_train"), r8(F.max(train)).alias("max_train"))


@query("C17_pretest_preparation", f"{P}, b AS (SELECT *, CAST(floor(0.8 * n) AS INTEGER) AS split FROM series), v AS (SELECT *, greatest(8, floor(0.2 * (split - 12))) AS tail FROM b), s AS (SELECT *, min(y) FILTER (WHERE t < split - tail) OVER w AS lo, max(y) FILTER (WHERE t < split - tail) OVER w AS hi FROM v WINDOW w AS (PARTITION BY series_id)) SELECT series_id, t, round(0.1 + (y - lo) * (0.8 / (hi - lo)), 8) AS scaled, CASE WHEN t < split - tail THEN 'fit' ELSE 'validation' END AS part FROM s WHERE t >= 12 AND t < split")
def pretest_preparation(spark, d):
    from tidemark.operators.selection import pretest

    return pretest(priority_monthly(spark, d), rules.floor_split(F.col("n")), 12).select("series_id", "t", r8("scaled").alias("scaled"), "part")


@query("C18_unit", f"{P} SELECT series_id, t, round((y - min(y) OVER w) / CASE WHEN max(y) OVER w > min(y) OVER w THEN max(y) OVER w - min(y) OVER w ELSE 1 END, 8) AS unit FROM series WINDOW w AS (PARTITION BY series_id)")
def unit(spark, d):
    return shaping.unit(priority_monthly(spark, d)).select("series_id", "t", r8("unit").alias("unit"))


@query("C19_z_score", f"{P} SELECT series_id, t, round((y - avg(y) OVER w) / (stddev_pop(y) OVER w + 1e-8), 8) AS z FROM series WINDOW w AS (PARTITION BY series_id)")
def z_score(spark, d):
    return shaping.z_score(priority_monthly(spark, d)).select("series_id", "t", r8("z").alias("z"))


@query("C20_difference", f"{P} SELECT series_id, t, round(step, 8) AS step FROM (SELECT series_id, t, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) AS step FROM series) WHERE t >= 1")
def difference(spark, d):
    return shaping.difference(priority_monthly(spark, d)).select("series_id", "t", r8("diff").alias("step"))


TREND = f"{P}, fit AS (SELECT series_id, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept FROM series WHERE t < {SPLIT} GROUP BY 1)"


@query("C21_linear_trend", f"{TREND} SELECT series_id, round(slope, 8) AS slope, round(intercept, 8) AS intercept FROM fit")
def linear_trend(spark, d):
    s = priority_monthly(spark, d).filter(_in_train()).groupBy("series_id").agg(F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("intercept"))
    return s.select("series_id", r8("slope").alias("slope"), r8("intercept").alias("intercept"))


@query("C22_residuals", f"{TREND} SELECT series_id, t, round(intercept + slope * t, 8) AS trend, round(y - intercept - slope * t, 8) AS residual FROM series JOIN fit USING (series_id)")
def residuals(spark, d):
    s = shaping.linear_trend(priority_monthly(spark, d), _in_train())
    return s.select("series_id", "t", r8("trend").alias("trend"), r8("residual").alias("residual"))


@query("C23_feature_ranges", "SELECT event_type, greatest(max(value) - min(value), 1e-3) AS span FROM events GROUP BY 1")
def feature_ranges(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.greatest(F.max("value") - F.min("value"), F.lit(1e-3)).alias("span"))


@query("C24_period_of_frequency", "SELECT c_mktsegment AS name, CASE WHEN lower(c_mktsegment) LIKE '%month%' THEN 12 WHEN lower(c_mktsegment) LIKE '%quarter%' THEN 4 ELSE 1 END AS m FROM customer GROUP BY 1 UNION ALL SELECT 'M4_Monthly', 12 UNION ALL SELECT 'Quarterly', 4")
def period_of_frequency(spark, d):
    names = read(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    names = names.union(spark.createDataFrame([("M4_Monthly",), ("Quarterly",)], "name string"))
    return names.select("name", rules.period_of_frequency(F.col("name")).alias("m"))


EVENTS = """WITH b AS (SELECT event_type AS series_id, CAST(floor(epoch(ts) / 14400) AS BIGINT) AS bucket, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / 1e3 AS y FROM events GROUP BY 1, 2)
SELECT series_id, bucket, round(y, 8) AS y, CAST(row_number() OVER (PARTITION BY series_id ORDER BY bucket) - 1 AS INTEGER) AS t FROM b"""


@query("S01_events_4h", EVENTS)
def events_series(spark, d):
    return events_4h(spark, d).select("series_id", F.col("ts").alias("bucket"), r8("y").alias("y"), "t")


# Scalar functions over columns of the tables.
SCALARS = {
    "I01_safe_divide": ("lineitem", "l_orderkey, l_linenumber", "CASE WHEN l_tax <> 0 THEN l_discount / l_tax END", lambda: rules.safe_divide(F.col("l_discount"), F.col("l_tax"))),
    "I06_constriction": ("lineitem", "l_orderkey, l_linenumber", "CASE WHEN 4 * (1 + l_tax) > 4 THEN round(2.0 / (4 * (1 + l_tax) - 2 + sqrt(4 * (1 + l_tax) * (4 * (1 + l_tax)) - 4 * (4 * (1 + l_tax)))), 8) END", lambda: r8(rules.constriction(4 * (1 + F.col("l_tax"))))),
    "I07_clip": ("customer", "c_custkey", "least(greatest(c_acctbal, 0.0), 5000.0)", lambda: rules.clip(F.col("c_acctbal"), 0.0, 5000.0)),
    "I09_percent": ("lineitem", "l_orderkey, l_linenumber", "l_discount * 100", lambda: F.col("l_discount") * 100),
    "I10_key_hash": ("customer", "c_custkey", "sha256(concat_ws('|', c_name, c_mktsegment))", lambda: rules.key_hash(F.col("c_name"), F.col("c_mktsegment"))),
    "I15_row_key": ("customer", "c_custkey", "concat_ws(' | ', c_mktsegment, CAST(c_nationkey AS VARCHAR))", lambda: rules.row_key(F.col("c_mktsegment"), F.col("c_nationkey"))),
    "I16_format_p": ("lineitem", "l_orderkey, l_linenumber", "CASE WHEN l_discount < 1e-3 THEN printf('%.2e', l_discount) ELSE printf('%.4f', l_discount) END", lambda: rules.format_p(F.col("l_discount"))),
    "I17_latex_escape": ("customer", "c_custkey", "replace(replace(replace(replace(c_name || '_a&b%', '&', '\\&'), '%', '\\%'), '_', '\\_'), '#', '\\#')", lambda: rules.latex_escape(F.concat("c_name", F.lit("_a&b%")))),
    "I18_iso_date": ("orders", "o_orderkey", "strftime(o_orderdate, '%Y-%m-%d')", lambda: F.date_format("o_orderdate", "yyyy-MM-dd")),
    "I20_labels": ("orders", "o_orderkey", "CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END", lambda: F.coalesce(F.create_map(*map(F.lit, ("F", "final", "O", "open")))[F.col("o_orderstatus")], F.col("o_orderstatus"))),
    "I22_first_value": ("part", "p_partkey", "split_part(p_type, ' ', 1)", lambda: F.element_at(F.split("p_type", " "), 1)),
    "I23_safe_name": ("customer", "c_custkey", "regexp_replace(c_name, '[^A-Za-z0-9_-]', '_', 'g')", lambda: rules.safe_name(F.col("c_name"))),
    "I24_dynamics": ("part", "p_partkey", "CASE WHEN p_size % 2 = 0 THEN round(2.0 / (4.1 - 2 + sqrt(4.1 * 4.1 - 4 * 4.1)), 8) ELSE 1.0 END", lambda: F.when(F.col("p_size") % 2 == 0, r8(rules.constriction(F.lit(4.1)))).otherwise(1.0)),
}
for _name, (_table, _keys, _sql, _expr) in SCALARS.items():

    def _scalar_query(spark, d, table=_table, keys=_keys, expr=_expr):
        return read(spark, d, table).select(*keys.split(", "), expr().alias("v"))

    query(_name, f"SELECT {_keys}, {_sql} AS v FROM {_table}")(_scalar_query)


@query("I19_split_list", "SELECT o_orderkey, CAST(x AS INTEGER) AS v FROM (SELECT o_orderkey, unnest(string_split('12,40,' || CAST(o_orderkey % 7 AS VARCHAR), ',')) AS x FROM orders)")
def split_list(spark, d):
    text = F.concat(F.lit("12,40,"), (F.col("o_orderkey") % 7).cast("string"))
    return read(spark, d, "orders").select("o_orderkey", F.explode(F.split(text, ",").cast("array<int>")).alias("v"))
