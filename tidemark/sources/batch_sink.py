"""Batches that are written once, as a data sink with a commit.

``df.write.format("batch_once").option("batch", k).mode("append").save(path)`` writes Parquet to ``path/batch=k``. Tasks write to a
hidden folder beside it and report their files; when all have, files of attempts that didn't report are deleted and the folder
gets its name in one step. So a reader sees a batch whole or not at all, a task that dies leaves nothing visible, and a retry (of
the task or of the whole write) succeeds; tasks that still run when the write is given up may leave hidden files. A batch that is there is refused, before any task starts and again at the commit.

On a store where a folder can't be renamed in one step, readers must go by ``_SUCCESS``, which is written before the rename.

Defined results: an empty table gives a batch with ``_SUCCESS`` and one empty file, so that it counts as done and has a schema.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.sources.groups import uri


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, path: str, batch: int, schema: StructType):
        self.path, self.batch, self.arrow = path, batch, to_arrow_schema(schema)
        fs, root = pa.fs.FileSystem.from_uri(path)
        self.final, self.hidden = f"{root}/batch={batch}", f"{root}/_writing-{batch}-{uuid.uuid4().hex}"
        self._refuse(fs)

    def _refuse(self, fs) -> None:
        if fs.get_file_info(self.final).type != pa.fs.FileType.NotFound:
            raise ValueError(f"batch {self.batch} already exists in {self.path}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, _ = pa.fs.FileSystem.from_uri(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.parquet"
        fs.create_dir(self.hidden)
        rows = 0
        with fs.open_output_stream(f"{self.hidden}/{name}") as out, pa.parquet.ParquetWriter(out, self.arrow) as writer:
            for batch in batches:
                writer.write_batch(batch.cast(self.arrow))
                rows += batch.num_rows
        return Written(name, rows)

    def commit(self, messages: list[Written]) -> None:
        fs, _ = pa.fs.FileSystem.from_uri(self.path)
        fs.create_dir(self.hidden)
        kept = {m.file for m in messages if m is not None and m.rows}
        if not kept and messages and messages[0] is not None:
            kept = {messages[0].file}
        for info in fs.get_file_info(pa.fs.FileSelector(self.hidden)):
            if info.base_name not in kept:
                fs.delete_file(info.path)
        if not kept:
            with fs.open_output_stream(f"{self.hidden}/part-00000.parquet") as out, pa.parquet.ParquetWriter(out, self.arrow):
                pass
        with fs.open_output_stream(f"{self.hidden}/_SUCCESS"):
            pass
        self._refuse(fs)
        fs.move(self.hidden, self.final)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = pa.fs.FileSystem.from_uri(self.path)
        if fs.get_file_info(self.hidden).type != pa.fs.FileType.NotFound:
            fs.delete_dir(self.hidden)


class BatchOnce(DataSource):
    @classmethod
    def name(cls) -> str:
        return "batch_once"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("batches are never written over")
        path = self.options["path"]
        return BatchWriter(uri(path), int(self.options["batch"]), schema)


def write_batch_once(df: DataFrame, path: str, batch: int) -> None:
    df.sparkSession.dataSource.register(BatchOnce)
    df.write.format("batch_once").option("batch", batch).mode("append").save(path)
