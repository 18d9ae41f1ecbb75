"""The folder that all executors share, and intermediate results in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only where none is set and Spark runs on one machine (as in tests) a folder of this machine is used, until the program
    ends; on a cluster it would be another one on each executor, so that a missing setting is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="shared-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there: lost executors don't undo it, and its rows and partitions
    are the same wherever it's used.

    Spark deletes such files once nothing refers to them where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
