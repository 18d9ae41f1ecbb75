"""Run a stream to its end over a table: the table is written as files, which the stream then reads in order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tidemark.sources.shared import cut, shared_folder
from tidemark.streaming.online import OUT, forecast_stream


def over(series: DataFrame, m: int, steps: int = 3) -> DataFrame:
    """series_id, t, y -> forecasts by ``forecast_stream``; an empty table gives no rows.

    The table is worked out once and written in ``steps`` ranges of t, one after another. Within a range a series is in one
    file, and the stream takes files in the order they were written: so a batch never has values before those already seen.
    """
    spark = series.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = cut(series)
    end = (source.selectExpr("max(t)").first()[0] or 0) + 1
    for k in range(steps):
        part = source.filter((source.t >= k * end / steps) & (source.t < (k + 1) * end / steps))
        part.repartition("series_id").write.mode("append").parquet(f"{at}/in")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stream = spark.readStream.schema(series.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in")
    done = forecast_stream(stream, m).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{at}/out")
