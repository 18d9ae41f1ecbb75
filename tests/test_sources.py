"""The data source of series groups and the sink of batches."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources.batch_sink import write_batch_once
from tidemark.sources.groups import groups


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_long_and_wide_files(spark, tmp_path):
    put(f"{tmp_path}/long/m4/monthly/a.csv", 'series_id,t,y\nM1,0,1.5\nM1,1,\nM1,2,x\nM2,0,-2e3\n')
    put(f"{tmp_path}/long/source=m3/frequency=yearly/b.csv", "series_id,t,y\nY1,0,7\n")
    assert rows(groups(spark, f"{tmp_path}/long")) == [("m3", "yearly", "Y1", 0, 7.0), ("m4", "monthly", "M1", 0, 1.5), ("m4", "monthly", "M2", 0, -2000.0)]
    put(f"{tmp_path}/wide/m4/yearly/a.csv", '"V1","V2","V3","V4"\n"Y1",1,2.5,\n"Y2",3,,4\n')
    assert rows(groups(spark, f"{tmp_path}/wide", "wide")) == [("m4", "yearly", "Y1", 0, 1.0), ("m4", "yearly", "Y1", 1, 2.5), ("m4", "yearly", "Y2", 0, 3.0), ("m4", "yearly", "Y2", 2, 4.0)]


def test_filters_reach_the_files(spark, tmp_path):
    """A broken file outside of the group isn't opened; the plan names the pushed filters; lines of other series are dropped."""
    put(f"{tmp_path}/m4/monthly/a.csv", "series_id,t,y\n" + "".join(f"M{k},{t},{k + t}\n" for k in range(9) for t in range(3)))
    put(f"{tmp_path}/m4/yearly/broken.csv", "series_id,t,y\n1\n2,2,2,2,2\n")
    put(f"{tmp_path}/m3/monthly/broken.csv", "series_id,t,y\n1\n2,2,2,2,2\n")
    with pytest.raises(Exception, match="CSV|columns"):
        groups(spark, str(tmp_path)).collect()
    some = groups(spark, str(tmp_path)).filter("source = 'm4' AND frequency = 'monthly'")
    assert some.count() == 27
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "BatchScan series_groups" in plan  # none is left for Spark to apply
    assert "Filter (" in groups(spark, str(tmp_path)).filter("y > 1")._jdf.queryExecution().executedPlan().toString()
    one = some.filter(F.col("series_id").isin("M3", "M5") & (F.col("t") > 0))
    assert rows(one.select("series_id", "t", "y")) == [("M3", 1, 4.0), ("M3", 2, 5.0), ("M5", 1, 6.0), ("M5", 2, 7.0)]
    assert groups(spark, str(tmp_path)).filter("source = 'm9'").count() == 0
    assert groups(spark, str(tmp_path)).filter("source = 'm4' AND source = 'm3'").count() == 0


def test_a_path_that_is_not_there(spark, tmp_path):
    with pytest.raises(Exception, match="absent"):
        groups(spark, f"{tmp_path}/absent").collect()


def test_a_batch_is_written_once(spark, tmp_path):
    df = spark.range(50, numPartitions=4).select("id", F.array("id").alias("a"), F.lit(None).cast("string").alias("s"))
    write_batch_once(df, str(tmp_path), 0)
    write_batch_once(df.limit(0), str(tmp_path), 1)
    got = spark.read.parquet(str(tmp_path))
    assert got.filter("batch = 0").count() == 50 and got.count() == 50 and os.path.exists(f"{tmp_path}/batch=1/_SUCCESS")
    with pytest.raises(Exception, match="already exists"):
        write_batch_once(df, str(tmp_path), 0)
    with pytest.raises(Exception, match="never written over"):
        df.write.format("batch_once").option("batch", 5).mode("overwrite").save(str(tmp_path))
    assert not [f for f in os.listdir(tmp_path) if f.startswith("_")]


def test_a_task_that_dies_leaves_nothing_and_a_retry_succeeds(spark, tmp_path):
    flag = f"{tmp_path}/fail"
    put(flag, "")

    def work(batches):
        import os

        for k, b in enumerate(batches):
            yield b
            if os.path.exists(flag) and 30 in list(b["id"]):
                raise RuntimeError("the task dies after it has written rows")

    df = spark.range(60, numPartitions=4).mapInPandas(work, "id bigint")
    with pytest.raises(Exception, match="the task dies"):
        write_batch_once(df, f"{tmp_path}/out", 0)
    assert not os.path.exists(f"{tmp_path}/out/batch=0")
    assert not [f for f in (os.listdir(f"{tmp_path}/out") if os.path.exists(f"{tmp_path}/out") else []) if not f.startswith("_")]  # what readers pass over
    os.remove(flag)
    write_batch_once(df, f"{tmp_path}/out", 0)
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(60))
