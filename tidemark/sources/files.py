"""File sources: delimited text with checks, wide and long series files, directories of JSON results; and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that a value or a date column may have, in order of preference (fixed values).
VALUE_NAMES = ("revenue_million_yer", "value", "revenue", "tax_revenue", "amount", "y")
DATE_NAMES = ("date", "month", "period", "time", "ds")


def _require(df: DataFrame, bad, message: str) -> None:
    if not df.filter(bad).isEmpty():
        raise ValueError(message)


def validated(df: DataFrame, date: str, value: str, key: str | None = None) -> DataFrame:
    """Strict series: all columns there, all dates and numbers readable and finite, no date twice; sorted by date.

    ``key`` names the series where the table has many.
    """
    keys = [key] if key else []
    missing = {date, value, *keys} - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    out = df.select(*keys, F.try_to_date(F.col(date).cast("string")).alias(date), F.expr(f"try_cast(`{value}` AS double)").alias(value))
    v = F.col(value)
    _require(out, F.col(date).isNull() | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "a date or a value can't be read")
    if not out.groupBy(*keys, date).count().filter("count > 1").isEmpty():
        raise ValueError("a date comes twice")
    return out.orderBy(*keys, date)


def read_validated(spark: SparkSession, path: str, date: str = "date", value: str = "revenue_million_yer") -> DataFrame:
    return validated(spark.read.csv(path, header=True), date, value)


def detect_value(df: DataFrame, requested: str | None = None, least: int = 10) -> str:
    """The requested column, else a known name, else the first column with ``least`` readable numbers."""
    if requested:
        if requested not in df.columns:
            raise ValueError(f"no column {requested}")
        return requested
    by_lower = {c.lower(): c for c in reversed(df.columns)}
    for name in VALUE_NAMES:
        if name in by_lower:
            return by_lower[name]
    counts = df.agg(*(F.count(F.expr(f"try_cast(`{c}` AS double)")).alias(c) for c in df.columns)).first()
    for c in df.columns:
        if counts[c] >= least:
            return c
    raise ValueError("no column of numbers")


def detect_date(df: DataFrame, requested: str | None = None) -> str | None:
    by_lower = {c.lower(): c for c in reversed(df.columns)}
    return requested or next((by_lower[n] for n in DATE_NAMES if n in by_lower), None)


def generic(df: DataFrame, value: str | None = None, date: str | None = None, least: int = 20, key: str | None = None) -> DataFrame:
    """date, value of any series file: columns found by name, unreadable values dropped, ``least`` rows needed.

    Rows are ordered by date where at least half of the dates (three at least) can be read. ``key`` names the series where the
    table has many; each of them then needs ``least`` rows.
    """
    keys = [key] if key else []
    value, date = detect_value(df, value), detect_date(df, date)
    v = F.expr(f"try_cast(`{value}` AS double)")
    out = df.select(*keys, (F.col(date) if date else F.lit(None).cast("string")).cast("string").alias("date"), v.alias("value")).filter("value IS NOT NULL AND NOT isnan(value)")
    counts = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(F.expr("try_to_timestamp(date)")).alias("dated"))
    fewest, n, dated = counts.agg(F.coalesce(F.min("n"), F.lit(0)), F.sum("n"), F.sum("dated")).first()
    if fewest < least:
        raise ValueError(f"{fewest} rows; {least} are needed")
    return out.orderBy(*keys, F.expr("try_to_timestamp(date)")) if dated >= max(3, n / 2) else out


def narrow(wide: DataFrame, key: str, train: bool = True) -> DataFrame:
    """A row for each series with its values in columns -> key, t, y without the missing ones. Filters on key reach the scan."""
    values = [c for c in wide.columns if c != key]
    typed = wide.select(key, *(F.expr(f"try_cast(`{c}` AS double)").alias(f"v{k}") for k, c in enumerate(values)))
    long = typed.unpivot([key], [f"v{k}" for k in range(len(values))], "name", "y")
    return long.select(key, F.expr("CAST(substring(name, 2) AS int)").alias("t"), "y").filter("y IS NOT NULL")


def gather(long: DataFrame, key: str, ts: str, y: str) -> DataFrame:
    """key, y: the values of each series as an array in time order."""
    packed = F.array_sort(F.collect_list(F.struct(ts, F.col(y).alias("v"))))
    return long.groupBy(key).agg(packed.alias("p")).select(key, F.transform("p", lambda s: s["v"]).alias("y"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics files: rows whose status is ok (or missing), with source_file and a dataset name."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    if "model" not in df.columns:
        return df.limit(0)
    if "status" in df.columns:
        df = df.filter(F.lower(F.coalesce("status", F.lit("ok"))) == "ok")
    df = df.withColumn("source_file", F.input_file_name())
    return df if "dataset" in df.columns else df.withColumn("dataset", F.concat(F.lit("row_"), F.monotonically_increasing_id().cast("string")))


def read_results(spark: SparkSession, path: str, status: str = "success") -> DataFrame:
    """A directory of JSON results, one document a file, with the wanted status."""
    return spark.read.json(path, multiLine=True).filter(F.col("status") == status)


def write_once(df: DataFrame, path: str) -> None:
    """Parquet that is written whole or not at all, and never over something."""
    df.write.mode("errorifexists").parquet(path)


def verify_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """path, size and SHA-256 of the files that differ from ``expected`` (name, size, sha256) or are missing there."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return found.join(expected, ["name", "size", "sha256"], "left_anti").unionByName(expected.join(found, ["name", "size", "sha256"], "left_anti"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this engine wrote for itself; one that isn't there is fine."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def configured(spark: SparkSession, entries: list[dict], least: int = 20) -> DataFrame:
    """series_id, value of all configured folders of CSV files; a missing folder or column, or too few rows, passes one over."""
    out = None
    for entry in entries:
        if not exists(spark, entry["path"]):
            continue
        df = spark.read.csv(entry["path"], header=True)
        if entry["value"] not in df.columns:
            continue
        one = df.select("series_id", F.expr(f"try_cast(`{entry['value']}` AS double)").alias("value")).filter("value IS NOT NULL")
        if one.limit(least).count() >= least:
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no entry has a series")
    return out


def read_group(spark: SparkSession, path: str, source: str, frequency: str) -> DataFrame:
    """unique_id, y (and more) of a table stored by (source, frequency): only the group's folder is read; y must be a number."""
    df = spark.read.parquet(path)
    if missing := {"unique_id", "y"} - set(df.columns):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    group = df.filter((F.col("source") == source) & (F.col("frequency") == frequency))
    return group.withColumn("y", F.expr("try_cast(y AS double)")).filter("y IS NOT NULL")


def read_config(spark: SparkSession, path: str) -> dict:
    """The first JSON object at a path; {} where there is none."""
    return spark.read.json(path).first().asDict(recursive=True) if exists(spark, path) else {}


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    """A batch of results, written whole or not at all and never over another; what is there tells what is pending."""
    write_once(df, f"{path}/batch={batch}")


def _digest(df: DataFrame):
    """A number that any change of the rows changes; their order doesn't count."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    return df.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.conv(F.substring(row, k, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k in (1, 13, 25, 37, 49)))


def write_manifest(df: DataFrame, path: str) -> None:
    """Rows with their number and digest beside them."""
    write_once(df, f"{path}/rows")
    _digest(df.sparkSession.read.parquet(f"{path}/rows")).write.mode("errorifexists").json(f"{path}/digest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a manifest, if they are what was written."""
    rows = spark.read.parquet(f"{path}/rows")
    now = _digest(rows)
    if now.first() != spark.read.schema(now.schema).json(f"{path}/digest").first():
        raise ValueError(f"the manifest at {path} has changed")
    return rows
