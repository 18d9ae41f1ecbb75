"""Analytics of score tables (condition columns, model, metric): pivots, ranks, summaries, wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import cut

#: Metrics for which larger is better (fixed value).
HIGHER_IS_BETTER = frozenset({"r2"})


def lower_is_better(metric: str) -> bool:
    return metric.lower() not in HIGHER_IS_BETTER


def pivot(df: DataFrame, condition: list[str], model: str, metric: str, models: list[str], how: str = "mean") -> DataFrame:
    """One row for each condition, a column for each model (given, sorted: no extra pass over the data)."""
    f = F.avg if how == "mean" else F.median
    return df.groupBy(*condition).pivot(model, sorted(models)).agg(f(metric))


def complete(wide: DataFrame, models: list[str]) -> DataFrame:
    return wide.dropna("any", subset=models)


def average_rank(value: Column | str, within: list[str], descending: bool = False) -> Column:
    """Rank in a group, ties sharing their mean; nulls have none."""
    c = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*within)
    rank = F.rank().over(w.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*within, c))
    return F.when(c.isNotNull(), rank + (ties - 1) / 2.0)


def summarise(df: DataFrame, condition: list[str], model: str, metric: str) -> DataFrame:
    """Per model: n, mean, std (0 for one value), median, min, max, mean and median rank over conditions."""
    ranked = df.withColumn("_rank", average_rank(metric, condition, not lower_is_better(metric)))
    return ranked.groupBy(model).agg(
        F.count(metric).alias("n"),
        F.avg(metric).alias("mean"),
        F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"),
        F.median(metric).alias("median"),
        F.min(metric).alias("min"),
        F.max(metric).alias("max"),
        F.avg("_rank").alias("rank_mean"),
        F.median("_rank").alias("rank_median"),
    )


def paired(df: DataFrame, condition: list[str], model: str, metric: str, a: str, b: str) -> DataFrame:
    """condition, a, b of the conditions that have both models (one pass, no self join)."""
    both = df.filter(F.col(model).isin(a, b)).groupBy(*condition).agg(F.avg(F.when(F.col(model) == a, F.col(metric))).alias("a"), F.avg(F.when(F.col(model) == b, F.col(metric))).alias("b"))
    return both.dropna(subset=["a", "b"])


def wins(pairs: DataFrame, *keys: str) -> DataFrame:
    """wins, losses, ties, win_rate (percent), mean gain where a wins, mean loss elsewhere, mean difference b - a."""
    d = F.col("b") - F.col("a")
    return pairs.groupBy(*keys).agg(
        F.count_if(d > 0).alias("wins"),
        F.count_if(d < 0).alias("losses"),
        F.count_if(d == 0).alias("ties"),
        (100.0 * F.count_if(d > 0) / F.count(F.lit(1))).alias("win_rate"),
        F.avg(F.when(d > 0, d)).alias("mean_gain"),
        F.avg(F.when(d <= 0, F.abs(d))).alias("mean_loss"),
        F.avg(d).alias("mean_difference"),
    )


def best_with_ties(df: DataFrame, within: list[str], model: str, metric: str) -> DataFrame:
    """Best models of each group, ties joined by '/'."""
    rank = F.rank().over(Window.partitionBy(*within).orderBy(metric))
    top = df.withColumn("_r", rank).filter("_r = 1")
    return top.groupBy(*within).agg(F.concat_ws("/", F.array_sort(F.collect_list(model))).alias("best"), F.min(metric).alias(metric))


def condition_columns(df: DataFrame, among: list[str]) -> list[str]:
    """Those of the columns that are there and have more than one value, sorted."""
    there = [c for c in among if c in df.columns]
    n = df.agg(*(F.min(c).alias(f"_low_{c}") for c in there), *(F.max(c).alias(f"_high_{c}") for c in there)).first()
    return sorted(c for c in there if n[f"_low_{c}"] != n[f"_high_{c}"])


def reference_model(df: DataFrame, model: str, metric: str, wanted: str | None = None) -> DataFrame:
    """One row, reference: the wanted model if it has rows, else the best mean, ties by name."""
    g = df.groupBy(model).agg(F.avg(metric).alias("_mean"))
    worth = F.col("_mean") if lower_is_better(metric) else -F.col("_mean")
    return g.orderBy(F.col(model) != F.lit(wanted or ""), worth, model).limit(1).select(F.col(model).alias("reference"))


def cumulative(df: DataFrame, order: list[str], **sums: str) -> DataFrame:
    """Adds for each name the sum of a column over all rows before this one in the order (null: 0).

    ``order`` must tell all rows apart. Rows are sorted into ranges, which are written once, so that the numbers of the ranges
    hold wherever they are used: sums within a range by a window, those of the ranges before it by a table of a row a range.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = cut(ranged)
    totals = ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    before = totals.select("_range", *(F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_in_{name}") for name, c in sums.items()))
    return out.join(before, "_range").select(*df.columns, *((F.col(f"_in_{name}") + F.col(f"_{name}")).alias(name) for name in sums))


def quarters(df: DataFrame, by: str, *ties: str) -> DataFrame:
    """Adds quarter 1 to 4 in order of ``by``, then ``ties``: n // 4 rows each, the last takes the rest; none for fewer than 4 rows.

    Rows are numbered by ranges, not by one window over everything. ``by`` and ``ties`` must tell the rows apart.
    """
    numbered = cumulative(df.withColumn("_one", F.lit(1)), [by, *ties], _before="_one")
    total = numbered.agg(F.count(F.lit(1)).alias("_total"))
    quarter = F.least(F.floor(F.col("_before") / F.floor(F.col("_total") / 4)), F.lit(3)) + 1
    return numbered.crossJoin(F.broadcast(total)).withColumn("quarter", quarter.cast("int")).select(*df.columns, "quarter")
