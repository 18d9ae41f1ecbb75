"""Series from relational tables. Amounts are summed as decimals, so that a sum doesn't depend on the order of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import shaping

#: The last month of orders is not complete.
CUT = "2001-08-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(amount: Column, unit: float) -> Column:
    return F.sum(amount.cast("decimal(18,2)")).cast("double") / F.lit(unit)


def priority_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, ts, y, t, n: order value (millions) by priority and month."""
    orders = read(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit(CUT).cast("timestamp"))
    month = F.trunc("o_orderdate", "month").alias("ts")
    y = exact_sum(F.col("o_totalprice"), 1e6).alias("y")
    return shaping.index(orders.groupBy(F.col("o_orderpriority").alias("series_id"), month).agg(y))


def segment_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by market segment: orders joined with customers."""
    orders = read(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit(CUT).cast("timestamp"))
    both = orders.join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    month = F.trunc("o_orderdate", "month").alias("ts")
    return shaping.index(both.groupBy(F.col("c_mktsegment").alias("series_id"), month).agg(exact_sum(F.col("o_totalprice"), 1e6).alias("y")))


def events_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event value by type and four hours (epoch buckets)."""
    events = read(spark, sf_dir, "events")
    bucket = F.floor(F.unix_timestamp("ts") / 14400).alias("ts")
    return shaping.index(events.groupBy(F.col("event_type").alias("series_id"), bucket).agg(exact_sum(F.col("value"), 1e3).alias("y")))


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event value by type and day."""
    bucket = F.floor(F.unix_timestamp("ts") / 86400).alias("ts")
    return shaping.index(read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), bucket).agg(exact_sum(F.col("value"), 1e3).alias("y")))


def nation_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value by the customer's nation and month; on few orders some months are missing."""
    orders = read(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit(CUT).cast("timestamp"))
    both = orders.join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    month = F.trunc("o_orderdate", "month").alias("ts")
    # Summed by key before the names are joined: the names then meet a row for each nation and month.
    sums = both.groupBy("c_nationkey", month).agg(exact_sum(F.col("o_totalprice"), 1e6).alias("y"))
    named = sums.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return shaping.index(named.select(F.col("n_name").alias("series_id"), "ts", "y"))


def flag_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounted value of line items (millions) by flag and status, and month of shipping."""
    lines = read(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") < F.lit(CUT).cast("timestamp"))
    value = F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1).cast("decimal(1,0)") - F.col("l_discount").cast("decimal(3,2)"))
    month = F.trunc("l_shipdate", "month").alias("ts")
    y = (F.sum(value).cast("double") / F.lit(1e6)).alias("y")
    return shaping.index(lines.groupBy(F.concat("l_returnflag", "l_linestatus").alias("series_id"), month).agg(y))


#: Families of real series: name, builder, source, frequency, season.
FAMILIES = (
    ("orders_priority_monthly", priority_monthly, "orders", "monthly", 12),
    ("orders_segment_monthly", segment_monthly, "orders_customer", "monthly", 12),
    ("orders_nation_monthly", nation_monthly, "orders_nation", "monthly", 12),
    ("lineitem_flag_monthly", flag_monthly, "lineitem", "monthly", 12),
    ("events_type_4h", events_4h, "events", "4h", 6),
    ("events_type_daily", events_daily, "events", "daily", 7),
)


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family, source, frequency, m, series_id (unique over the families), t, n, y of all families."""
    out = None
    for name, build, source, frequency, m in FAMILIES:
        labels = [F.lit(x).alias(c) for c, x in (("family", name), ("source", source), ("frequency", frequency), ("m", m))]
        part = build(spark, sf_dir).select(*labels, F.concat_ws("|", F.lit(name), "series_id").alias("series_id"), "t", "n", "y")
        out = part if out is None else out.unionByName(part)
    return out


#: The same in SQL, as a list of common table expressions.
PRIORITY_SQL = """
priority_sums AS (
  SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ts,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS y
  FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-01 00:00:00' GROUP BY 1, 2),
series AS (
  SELECT series_id, ts, y, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS INTEGER) AS t,
         CAST(count(*) OVER (PARTITION BY series_id) AS INTEGER) AS n FROM priority_sums)"""
SEGMENT_SQL = """
segment_sums AS (
  SELECT c_mktsegment AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ts,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS y
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '2001-08-01 00:00:00' GROUP BY 1, 2),
segments AS (
  SELECT series_id, ts, y, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS INTEGER) AS t,
         CAST(count(*) OVER (PARTITION BY series_id) AS INTEGER) AS n FROM segment_sums)"""
FAMILIES_SQL = """
family_sums AS (
  SELECT 'orders_priority_monthly' AS family, 12 AS m, o_orderpriority AS series_id, epoch(date_trunc('month', o_orderdate)) AS ts,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS y
  FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-01 00:00:00' GROUP BY ALL
  UNION ALL SELECT 'orders_segment_monthly', 12, c_mktsegment, epoch(date_trunc('month', o_orderdate)), CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '2001-08-01 00:00:00' GROUP BY ALL
  UNION ALL SELECT 'orders_nation_monthly', 12, n_name, epoch(date_trunc('month', o_orderdate)), CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate < TIMESTAMP '2001-08-01 00:00:00' GROUP BY ALL
  UNION ALL SELECT 'lineitem_flag_monthly', 12, l_returnflag || l_linestatus, epoch(date_trunc('month', l_shipdate)),
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(3,2)))) AS DOUBLE) / 1e6
  FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-08-01 00:00:00' GROUP BY ALL
  UNION ALL SELECT 'events_type_4h', 6, event_type, floor(epoch(ts) / 14400), CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / 1e3 FROM events GROUP BY ALL
  UNION ALL SELECT 'events_type_daily', 7, event_type, floor(epoch(ts) / 86400), CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / 1e3 FROM events GROUP BY ALL),
families AS (
  SELECT family, m, family || '|' || series_id AS series_id, y, CAST(row_number() OVER (PARTITION BY family, series_id ORDER BY ts) - 1 AS INTEGER) AS t,
         CAST(count(*) OVER (PARTITION BY family, series_id) AS INTEGER) AS n FROM family_sums)"""
