"""Series files by group as a data source: filters on source, frequency and series reach the files.

``spark.read.format("series_groups").option("layout", "long" or "wide").load(path)`` reads ``path/source/frequency/*.csv`` (folders
may be written ``source=...``, as Spark's partitioned writers do) into source, frequency, series_id, t, y. A file is a partition.
Equality and IN filters on source and frequency choose folders before any file is opened; those on series_id drop lines before
values are taken apart. Other filters stay with Spark.

* long: a header, then series_id, t, y.
* wide: a header, then a series a line: its id, then its values; missing ones are left out and t counts columns from 0.

Defined results: a folder without files, or a group that isn't there, gives no rows; unreadable numbers count as missing; a
line without an id is left out; a path that isn't there is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

SCHEMA = "source string, frequency string, series_id string, t int, y double"
NAMES = ("source", "frequency", "series_id", "t", "y")


def uri(path: str) -> str:
    """The path with its scheme."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[5:]
    return path if "://" in path else f"file://{path}"


@dataclass
class GroupFile(InputPartition):
    source: str
    frequency: str
    path: str


class GroupReader(DataSourceReader):
    def __init__(self, path: str, layout: str):
        if layout not in ("long", "wide"):
            raise ValueError(f"there is no layout {layout}")
        self.path, self.layout = path, layout
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if column not in ("source", "frequency", "series_id"):
                yield f
                continue
            if isinstance(f, IsNotNull):  # they never are: lines without an id are left out
                continue
            values = {str(v) for v in (f.value if isinstance(f, In) else [f.value])}
            self.wanted[column] = self.wanted[column] & values if column in self.wanted else values

    def _folders(self, fs, path: str, column: str) -> list[tuple[str, str]]:
        """(value, path) of the folders under path that the filters let in."""
        found = []
        for info in fs.get_file_info(pa.fs.FileSelector(path)):
            if info.type == pa.fs.FileType.Directory and not info.base_name.startswith(("_", ".")):
                value = info.base_name.removeprefix(f"{column}=")
                if column not in self.wanted or value in self.wanted[column]:
                    found.append((value, info.path))
        return sorted(found)

    def partitions(self) -> list[GroupFile]:
        fs, path = pa.fs.FileSystem.from_uri(self.path)
        out = []
        for source, below in self._folders(fs, path, "source"):
            for frequency, folder in self._folders(fs, below, "frequency"):
                files = sorted(i.path for i in fs.get_file_info(pa.fs.FileSelector(folder)) if i.type == pa.fs.FileType.File and i.base_name.endswith(".csv"))
                out += [GroupFile(source, frequency, f) for f in files]
        return out or [GroupFile("", "", "")]

    def read(self, partition: GroupFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = pa.fs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(partition.path) as stream:
            header = stream.read(1 << 20).split(b"\n", 1)[0].decode()
        columns = [c.strip().strip('"') for c in header.split(",")]
        with fs.open_input_stream(partition.path) as stream:
            # All as text: types found from the first lines may not hold for later ones, as wide files end in empty columns.
            types = pa.csv.ConvertOptions(column_types=dict.fromkeys(columns, pa.string()), strings_can_be_null=True)
            reader = pa.csv.open_csv(stream, read_options=pa.csv.ReadOptions(block_size=4 << 20), convert_options=types)
            for batch in reader:
                ids = batch.column(0).cast(pa.string())
                keep = pc.is_in(ids, pa.array(sorted(self.wanted["series_id"]), pa.string())) if "series_id" in self.wanted else pc.is_valid(ids)
                batch, ids = batch.filter(keep), ids.filter(keep)
                for t, part_ids, y in self._values(batch, ids):
                    known = pc.and_(pc.is_valid(y), pc.is_valid(t))
                    part_ids, t, y = part_ids.filter(known), t.filter(known), y.filter(known)
                    n = len(y)
                    yield pa.RecordBatch.from_arrays([pa.array([partition.source] * n, pa.string()), pa.array([partition.frequency] * n, pa.string()), part_ids, t.cast(pa.int32()), y], NAMES)

    def _values(self, batch: pa.RecordBatch, ids: pa.Array) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
        if self.layout == "long":
            yield _numbers(batch.column(1)).cast(pa.int32(), safe=False), ids, _numbers(batch.column(2))
            return
        for k in range(1, batch.num_columns):
            yield pa.array([k - 1] * len(ids), pa.int32()), ids, _numbers(batch.column(k))


def _numbers(column: pa.Array) -> pa.Array:
    """Doubles; what can't be read is null."""
    if pa.types.is_floating(column.type) or pa.types.is_integer(column.type):
        return column.cast(pa.float64())
    text = pc.utf8_trim_whitespace(column.cast(pa.string()))
    good = pc.match_substring_regex(text, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return pc.if_else(good, text, pa.scalar(None, pa.string())).cast(pa.float64())


class SeriesGroups(DataSource):
    @classmethod
    def name(cls) -> str:
        return "series_groups"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GroupReader:
        path = self.options["path"]
        return GroupReader(uri(path), self.options.get("layout", "long"))


def groups(spark: SparkSession, path: str, layout: str = "long"):
    """The data source as a DataFrame, with its filters pushed down."""
    spark.dataSource.register(SeriesGroups)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("series_groups").option("layout", layout).load(path)
