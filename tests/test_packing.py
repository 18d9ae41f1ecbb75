"""Costs over partitions, and batches that read each task once."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fitting, packing
from tidemark.plans import design
from tidemark.sources import files


def loads(df, by="cost"):
    return [r[0] for r in df.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.sum(by)).select(f"sum({by})").collect()]


def test_the_full_design_is_even(spark):
    """All 8,780 tasks: the longest of 64 partitions is within a quarter of the mean (dealt in turn by key it isn't)."""
    work = design.final_tasks(spark).select("run_id", "method", F.lit(1).alias("series_id"))
    work = work.withColumn("cost", packing.cost("method"))
    n = work.count()
    got = packing.packed(work, F.col("cost"), ["run_id"], 64)
    assert got.rdd.getNumPartitions() == 64 and got.count() == n and got.select("run_id").distinct().count() == n
    by = loads(got)
    most = max(r[0] for r in work.select("cost").collect())
    assert len(by) == 64 and max(by) <= sum(by) / 64 + most and max(by) <= 1.5 * sum(by) / 64


@pytest.mark.parametrize("bins", [1, 3, 8])
def test_no_partition_is_over_the_mean_by_more_than_a_task(spark, bins):
    work = spark.range(200).select("id", F.when(F.col("id") % 50 == 7, 40.0).when(F.col("id") % 9 == 0, F.lit(None).cast("double")).otherwise(F.rand(3)).alias("cost"), (F.col("id") % 3).alias("k")).unionByName(spark.range(4).select(F.lit(1).cast("bigint").alias("id"), F.lit(2.0).alias("cost"), F.lit(0).cast("bigint").alias("k"))).checkpoint()
    got = packing.packed(work, F.col("cost"), ["k"], bins)
    assert sorted(map(str, got.collect())) == sorted(map(str, work.collect()))
    by = [v or 0.0 for v in loads(got)]
    assert max(by) <= sum(by) / bins + 40.0


def test_unknown_and_long_tasks_have_a_cost(spark):
    df = spark.createDataFrame([("sarima", 63), ("naive_1", 126), ("new", 63), (None, 63)], "method string, n int")
    assert [r[0] for r in df.select(packing.cost("method", F.col("n"))).collect()] == [4.0, 0.002, 0.1, 0.1]


def test_batches_work_their_tasks_out_once(spark, tmp_path):
    """An accumulator counts how often the source's rows are made: once a start, however many batches there are."""
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            made.add(len(b))
            yield b

    series = spark.range(480).select((F.col("id") % 12).cast("string").alias("series_id"), (F.col("id") / 12).cast("int").alias("t"), F.sin("id").alias("y"))
    work = fitting.tasks(series, ["naive_1", "drift", "theta"]).mapInPandas(rows, "series_id string, y array<double>, n_train int, method string, seed int")
    done = fitting.in_batches(work, f"{tmp_path}/out", 12, 4)
    assert done.select("run_id").distinct().count() == 36 and done.select("batch").distinct().count() == 9
    assert made.value == 36
    files.remove(spark, f"{tmp_path}/out/batch=3")
    assert fitting.in_batches(work, f"{tmp_path}/out", 12, 4).select("run_id").distinct().count() == 36
    assert made.value == 72


def test_removing_what_is_not_there(spark, tmp_path):
    files.remove(spark, f"{tmp_path}/absent")
