"""Tests on paired scores: statistics as aggregations, p-values by scalar functions on the few rows that result."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import average_rank, cumulative
from tidemark.sources.shared import cut


# -- distributions ---------------------------------------------------------------------------------------------------


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi_square_p(x: float, df: int) -> float:
    return gamma_upper(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def sign_test_p(n_pos: int, n_neg: int) -> float:
    """Exact and two-sided; zeros are left out before."""
    n, k = n_pos + n_neg, min(n_pos, n_neg)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def wilcoxon_p(w_plus: float, n: int, tie_term: float, alternative: str = "two-sided") -> float:
    """Of the signed-rank sum; exact for up to 50 differences without ties, else normal with the tie correction."""
    if n == 0:
        return 1.0
    mean = n * (n + 1) / 4
    if n <= 50 and tie_term == 0:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k]
        below, above = ways[: int(w_plus) + 1].sum() / 2**n, ways[int(math.ceil(w_plus)) :].sum() / 2**n
        return float({"less": below, "greater": above}.get(alternative, min(1.0, 2 * min(below, above))))
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48)
    if sd == 0:
        return 1.0
    z = (w_plus - mean) / sd
    return {"less": 0.5 * math.erfc(-z / math.sqrt(2)), "greater": 0.5 * math.erfc(z / math.sqrt(2))}.get(alternative, normal_two_sided(z))


def median_interval_rank(n: int, alpha: float = 0.05) -> int:
    """Largest k with 2 P(Binomial(n, 1/2) <= k - 1) <= alpha; 0 if there is none. Terms further out than 9 standard deviations
    are under 1e-18 together and left out."""
    n = int(n)
    k = max(0, int(n / 2 - 4.5 * math.sqrt(n)) - 1)
    total = 0.0
    while k < n // 2 + 1:
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
        if 2 * total > alpha * (1 + 1e-12):
            break
        k += 1
    return k


def scalar(f, *cols: Column) -> Column:
    """A Python function of numbers, for small tables of statistics, in Arrow batches."""

    @F.pandas_udf("double")
    def run(*args: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else float(f(*row)) for row in zip(*args, strict=True)], dtype="float64")

    return run(*cols)


# -- statistics ------------------------------------------------------------------------------------------------------


def friedman(df: DataFrame, condition: list[str], model: str, metric: str, models: list[str]) -> DataFrame:
    """One row: n (conditions that have all models), k, statistic (corrected for ties), p_value, kendall_w."""
    k = len(models)
    full = df.filter(F.col(model).isin(models) & F.col(metric).isNotNull()).select(*condition, model, metric)
    have = F.count(F.lit(1)).over(Window.partitionBy(*condition))
    full = cut(full.withColumn("_have", have).filter(F.col("_have") == k))
    ranked = full.withColumn("_rank", average_rank(metric, condition))
    ties = full.groupBy(*condition, metric).count().agg(F.coalesce(F.sum(F.col("count") * F.col("count") * F.col("count") - F.col("count")), F.lit(0)).alias("ties"))
    sums = ranked.groupBy(model).agg(F.sum("_rank").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    out = sums.agg(F.max("_n").alias("n"), F.sum(F.col("_sum") * F.col("_sum")).alias("_ss")).crossJoin(ties)
    n = F.col("n")
    raw = 12.0 / (n * k * (k + 1)) * F.col("_ss") - 3.0 * n * (k + 1)
    statistic = raw / (1 - F.col("ties") / (n * k * (k * k - 1.0)))
    out = out.select("n", F.lit(k).alias("k"), statistic.alias("statistic"))
    return out.withColumn("p_value", scalar(lambda x: chi_square_p(x, k - 1), F.col("statistic"))).withColumn("kendall_w", F.col("statistic") / (n * (k - 1)))


def signed_ranks(pairs: DataFrame, *keys: str) -> DataFrame:
    """Wilcoxon's sums for differences d = a - b by key: n, w_plus, w_minus, statistic (the smaller), tie_term, n_pos, n_neg.

    Distinct |d| are counted first (partial sums) and ranked in ranges over all keys; the place of a key's first one comes
    off within the sums. So no task gets all differences, with or without keys.
    """
    d = pairs.withColumn("_d", F.col("a") - F.col("b")).filter("_d <> 0")
    counts = d.groupBy(*keys, F.abs("_d").alias("_abs")).agg(F.count(F.lit(1)).alias("_c"), F.count_if(F.col("_d") > 0).alias("_p"))
    placed = cumulative(counts, [*keys, "_abs"], _before="_c")
    c, p = F.col("_c").cast("double"), F.col("_p").cast("double")
    rank = F.col("_before") + (c + 1) / 2  # over all keys
    out = placed.groupBy(*keys).agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(p * rank) - F.min("_before") * F.sum(p), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum((c - p) * rank) - F.min("_before") * F.sum(c - p), F.lit(0.0)).alias("w_minus"),
        F.sum(c * c * c - c).alias("tie_term"),
        F.coalesce(F.sum("_p"), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum(F.col("_c") - F.col("_p")), F.lit(0)).alias("n_neg"),
    )
    return out.withColumn("statistic", F.least("w_plus", "w_minus"))


def wilcoxon(pairs: DataFrame, *keys: str, alternative: str = "two-sided") -> DataFrame:
    out = signed_ranks(pairs, *keys)
    return out.withColumn("p_value", scalar(lambda w, n, t: wilcoxon_p(w, int(n), t, alternative), F.col("w_plus"), F.col("n"), F.col("tie_term")))


def sign_test(pairs: DataFrame, *keys: str) -> DataFrame:
    d = F.col("a") - F.col("b")
    out = pairs.groupBy(*keys).agg(F.count_if(d > 0).alias("n_pos"), F.count_if(d < 0).alias("n_neg"))
    return out.withColumn("p_value", scalar(lambda p, m: sign_test_p(int(p), int(m)), F.col("n_pos"), F.col("n_neg")))


def holm(df: DataFrame, p: str = "p_value", family: list[str] | None = None, monotone: bool = True, alpha: float = 0.05, m: int | None = None) -> DataFrame:
    """Adds p_adjusted and reject: step-down over a family (m hypotheses; the rows there are if not given).

    A row is a hypothesis, that is a model that is compared with another: a family is as large as the list of models.
    """
    within = Window.partitionBy(*(family or [F.lit(1)]))
    rank = F.row_number().over(within.orderBy(F.col(p).asc_nulls_last()))
    size = F.lit(m) if m else F.count(p).over(within)
    out = df.withColumn("_step", F.least(F.lit(1.0), (size - rank + 1) * F.col(p)))
    if monotone:
        out = out.withColumn("p_adjusted", F.max("_step").over(within.orderBy(F.col(p).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        out = out.withColumn("p_adjusted", F.col("_step"))
    return out.withColumn("reject", F.col("p_adjusted") <= alpha).drop("_step")


def cliffs_delta(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """One row: delta = P(a > b) - P(a < b), from the counts of each distinct value instead of all pairs, ranked in ranges."""
    counts = df.filter(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(group) == a).cast("double").alias("_a"), F.count_if(F.col(group) == b).cast("double").alias("_b"))
    placed = cumulative(counts, [value], _below="_b")
    sums = placed.agg(F.sum("_a").alias("n"), F.sum("_b").alias("m"), F.sum(F.col("_a") * F.col("_below")).alias("above"), F.sum(F.col("_a") * F.col("_b")).alias("ties"))
    return sums.select(((2 * F.col("above") + F.col("ties")) / (F.col("n") * F.col("m")) - 1).alias("delta"))


def critical_difference(q: float, k: int, n: Column) -> Column:
    return F.lit(q) * F.sqrt(F.lit(k * (k + 1) / 6.0) / n)


#: Differences that one task resamples.
BLOCK = 100_000


def bootstrap(pairs: DataFrame, keys: list[str], draws: int = 10_000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """keys, mean_difference, low, high: percentile interval of the mean of a - b, resampled within a group.

    A group's differences are dealt to blocks of about BLOCK. How many of a draw's picks fall in each block is multinomial,
    drawn alike in every block from the seed and the blocks' sizes; each block then sums its own picks, and a draw's mean is
    the sum over blocks. So a group of any size is resampled whole, and a task's memory has a bound.
    """
    types = dict(pairs.dtypes)
    named = ", ".join(f"{k} {types[k]}" for k in keys)
    d = cut(pairs.select(*keys, (F.col("a") - F.col("b")).alias("d"), F.monotonically_increasing_id().alias("_i")))
    facts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("d").alias("mean_difference"))
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    blocked = d.alias("x").join(facts.alias("y"), same).select(*(f"x.{k}" for k in keys), "d", F.pmod("_i", F.ceil(F.col("_n") / BLOCK)).cast("int").alias("_block"))
    sizes = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "_c"))).alias("_sizes"))
    sizes = sizes.select(*keys, F.col("_sizes._block").alias("_blocks"), F.col("_sizes._c").alias("_counts"))
    work = blocked.alias("x").join(sizes.alias("y"), same).select(*(f"x.{k}" for k in keys), "d", "_block", "_blocks", "_counts")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = np.sort(pdf["d"].to_numpy())
        counts = np.asarray(pdf["_counts"].iloc[0])
        at = list(pdf["_blocks"].iloc[0]).index(pdf["_block"].iloc[0])
        rng = np.random.default_rng(seed if len(counts) == 1 else [seed, at])
        n = int(counts.sum())
        if len(counts) == 1:
            sums = np.concatenate([d[rng.integers(0, n, (min(500, draws - k), n))].sum(axis=1) for k in range(0, draws, 500)]) if n < 20_000 else np.array([d[rng.integers(0, n, n)].sum() for _ in range(draws)])
        else:
            picks = np.random.default_rng(seed).multinomial(n, counts / n, size=draws)[:, at]
            sums = np.array([d[rng.integers(0, len(d), k)].sum() for k in picks])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * draws for k in keys}, "_draw": np.arange(draws, dtype=np.int32), "_sum": sums})

    drawn = work.groupBy(*keys, "_block").applyInPandas(run, f"{named}, _draw int, _sum double")
    means = drawn.groupBy(*keys, "_draw").agg(F.sum("_sum").alias("_sum")).alias("x").join(facts.alias("y"), same).select(*(f"x.{k}" for k in keys), (F.col("_sum") / F.col("_n")).alias("_mean"), "mean_difference")
    return means.groupBy(*keys).agg(F.first("mean_difference").alias("mean_difference"), F.percentile("_mean", F.lit(alpha / 2)).alias("low"), F.percentile("_mean", F.lit(1 - alpha / 2)).alias("high"))


def compare_to(df: DataFrame, condition: list[str], model: str, metric: str, reference: str, models: list[str], seed: int = 42) -> DataFrame:
    """Each other model against the reference: Wilcoxon, bootstrap interval, direction, Holm."""
    df = cut(df.filter(F.col(model).isin(models)).select(*condition, model, metric))
    ref = df.filter(F.col(model) == reference).select(*condition, F.col(metric).alias("a"))
    rest = df.filter(F.col(model) != reference).select(*condition, F.col(model).alias("model"), F.col(metric).alias("b"))
    pairs = cut(rest.join(ref, condition).dropna(subset=["a", "b"]))
    tests = wilcoxon(pairs, "model").join(bootstrap(pairs, ["model"], seed=seed), "model")
    tests = tests.withColumn("direction", F.when(F.col("mean_difference") < 0, "reference_better").when(F.col("mean_difference") > 0, "model_better").otherwise("equal"))
    return holm(tests)
