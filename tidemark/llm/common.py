"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import cut, shared_folder

#: Characters of text that a Python worker handles at a time; bounds its memory whatever the batch.
CHUNK_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it: less to write than a checkpoint."""
    where = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(where)
    _stored.append(where)
    return df.sparkSession.read.parquet(where)


def release(spark: SparkSession) -> None:
    """Delete the tables that ``stored`` has written so far; call it once the results have been written."""
    while _stored:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_stored: list[str] = []

#: Bytes of an Arrow batch: with very long texts, batches of a number of rows alone would have no bound.
BATCH_BYTES = 8_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches that go to Python workers to BATCH_BYTES, unless the session already has a smaller limit."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 500_000


def text_mark():
    """Column: hash of the text as it is. A row is known by doc_id and this mark, so that a repeated doc_id does no harm."""
    return F.xxhash64(F.col("text").cast("string"))


def keep_rows(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, but for those that ``verdict`` (doc_id, mark, kept) drops.

    ``verdict`` has a row for each row of docs that is in a group of two or more. Rows that agree in doc_id and text can't
    be told apart; where one of them is kept, one of them stays. Few keys are broadcast, after a check of their number.
    """
    keys = verdict.groupBy("doc_id", "mark").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("NOT kept OR n > 1")
    keys = cut(keys.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "kept"))
    n = {r["kept"]: r["count"] for r in keys.groupBy("kept").count().collect()}
    own = "_" + "_".join(docs.columns)  # no column of docs
    keyed = docs.withColumn(own, text_mark())

    def joined(rows: DataFrame, kept: bool, how: str) -> DataFrame:
        some = keys.filter("kept" if kept else "NOT kept").select("_id", "_mark")
        some = F.broadcast(some) if n[kept] <= MOST_BROADCAST else some
        return rows.join(some, rows["doc_id"].eqNullSafe(some["_id"]) & (rows[own] == some["_mark"]), how)

    out = joined(keyed, False, "left_anti") if n.get(False) else keyed
    if not n.get(True):
        return out.select(*docs.columns)
    one = joined(out, True, "left_semi").groupBy("doc_id", own).agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*")
    return joined(out, True, "left_anti").select(*docs.columns).unionByName(one)


def filter_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of ``df``, with all columns, whose text passes a test: in one pass, without a join.

    ``make`` is called once in each Python worker's task and returns the test of many texts. Null texts arrive as "".
    """
    bounded_batches(df.sparkSession)
    at_text = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at, end in _chunks(batch.column(at_text), CHUNK_CHARS):
                part = batch.slice(at, end - at)
                yield part.filter(pa.array(f([x or "" for x in part.column(at_text).to_pylist()]), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def dealt_round(df: DataFrame) -> DataFrame:
    """The rows of an aggregation dealt out in turn, so that a join on its key shuffles both sides anew.

    Without this the join would reuse the aggregation's partitioning, and adaptive execution couldn't split a hot key.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def held_out(remainder: int, divisor: int):
    """Column: crc32 of doc_id as text, modulo ``divisor``, equals ``remainder`` (null doc_id: false)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == remainder, F.lit(False))


def sample_limit(most: int, n: int) -> int:
    """The largest hash (of 63 bits) in a sample of about ``most`` of ``n``; it doesn't come to nothing, however large n is."""
    whole = (1 << 63) - 1
    return min(whole, most * whole // max(n, 1))


def sampled(most: int, n: int):
    """Column: whether a doc_id is in a sample of about ``most`` of ``n`` rows, by its hash; all are where n is at most ``most``."""
    return F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 63) - 1)) <= F.lit(sample_limit(most, n))


def _chunks(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes of text each; a longer text is by itself."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    at = 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] <= most):
            size += sizes[end]
            end += 1
        yield at, end
        at = end


def map_texts(df: DataFrame, make: Callable[[], Callable[[list, list[str]], dict]], schema: str, id_col="doc_id", chunk: int = CHUNK_CHARS) -> DataFrame:
    """Apply a function of (ids, texts) to every row of ``df`` in bounded chunks, in Arrow batches.

    ``make`` is called once in each Python worker's task and returns the function; this returns columns named in
    ``schema``. Null texts arrive as "".
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(df.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, end in _chunks(batch.column(1), chunk):
                texts = [x or "" for x in batch.column(1).slice(at, end - at).to_pylist()]
                got = f(ids[at:end], texts)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[k.name], type=k.type) for k in out], schema=out)

    return df.select(id_col, F.col("text").cast("string")).mapInArrow(run, schema)


