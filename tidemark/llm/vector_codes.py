"""Compression of vectors by product codes, learnt by weighted Lloyd rounds over distinct parts.

Components become integers, floor(scale * x), and each vector is cut into equal parts. Equal parts at the same position are one
row with a weight (summed up before the shuffle), so that a part that a third of all vectors share is one row. Each round
finds the nearest entry of every distinct part, with sums and counts by entry for each task, which Spark adds up: what reaches
the driver is one row for each entry. Finally codes and errors of the distinct parts are joined back to the vectors; a hot part
is a hot key of that join, which adaptive execution splits.

All arithmetic is on integers, so that results don't depend on the order of rows or tasks.

Defined results: rows are left out whose vector is null, holds a null or non-finite component or one of LIMIT or more in size
(beyond it errors don't fit a long), or has another length than the kept vector that comes first by vec_id (nor a length that
isn't a multiple of the number of parts). A repeated vec_id is another row; for the first codebook rows are ordered by vec_id,
then by vector, null vec_ids last. With fewer vectors than entries a codebook has an entry for each vector. Null labels
are one label. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import MOST_BROADCAST, bounded_batches, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 65536
#: Rows whose distances to all entries are worked out at a time.
ROWS = 4096


def kept(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """uid, vec_id, label, x (integers): the vectors that get a code; written once, so that a uid stays that of its row."""
    some = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e")).filter("e IS NOT NULL")
    some = some.filter(F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LIMIT)) & (F.size("e") > 0) & (F.size("e") % parts == 0))
    whole = some.select("vec_id", "label", F.transform("e", lambda v: F.floor(v * scale).cast("long")).alias("x"))
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.size("x")).first()
    same = whole.filter(F.size("x") == (first[0] if first else 0))
    return stored(same.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "x"))


def cut_up(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """uid, vec_id, label, pos, part: a row for each part of each vector."""
    width = (F.size("x") / parts).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice("x", k * width + 1, width))
    return vectors.select("uid", "vec_id", "label", F.posexplode(pieces).alias("pos", "part"))


def nearest(x: np.ndarray, pos: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lower of two) and the squared distance, for each part."""
    index, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), ROWS):
        d = x[at : at + ROWS, None, :] - books[pos[at : at + ROWS]]
        d = np.einsum("ijk,ijk->ij", d, d)
        index[at : at + ROWS] = d.argmin(1)
        error[at : at + ROWS] = d.min(1)
    return index, error


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _sums(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """pos, entry, at, total, n: componentwise weighted sums of the parts that are nearest to each entry."""
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, entries, width = books.shape
        total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            pos, weight = (batch.column(k).to_numpy() for k in (0, 2))
            x = _matrix(batch.column(1), width)
            index, _ = nearest(x, pos, books)
            np.add.at(total, (pos, index), x * weight[:, None])
            np.add.at(n, (pos, index), weight)
        pos, entry = np.nonzero(n)
        for at in range(width):
            yield pa.RecordBatch.from_arrays([pa.array(pos.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(np.full(len(pos), at, np.int32)), pa.array(total[pos, entry, at]), pa.array(n[pos, entry])], ["pos", "entry", "at", "total", "n"])

    return distinct.mapInArrow(run, "pos int, entry int, at int, total bigint, n bigint").groupBy("pos", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """pos, part, entry, error of every distinct part."""
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, error = nearest(_matrix(batch.column(1), shared.value.shape[2]), batch.column(0).to_numpy(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(index.astype(np.int32)), pa.array(error)], ["pos", "part", "entry", "error"])

    return distinct.select("pos", "part", "n").mapInArrow(run, "pos int, part array<bigint>, entry int, error bigint")


def learn(vectors: DataFrame, distinct: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) after so many rounds; they start as the parts of the first vectors by vec_id."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    x = np.array([r["x"] for r in first], np.int64)
    books = x.reshape(len(x), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        new = books.copy()
        for pos, entry, at, total, n in _sums(distinct, books).collect():  # a row for each component of an entry
            new[pos, entry, at] = total // n
        books = new
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """The coded vectors (vec_id, label, entries: array of an index for each part, error) and the codebooks."""
    bounded_batches(vectors.sparkSession)
    rows = kept(vectors, parts, scale)
    distinct = stored(cut_up(rows, parts).groupBy("pos", "part").agg(F.count(F.lit(1)).alias("n")))
    books = learn(rows, distinct, parts, entries, rounds)
    coded = _coded(distinct, books)
    found = cut_up(rows, parts).join(coded, ["pos", "part"]).groupBy("uid", "vec_id", "label")
    indexes = F.transform(F.sort_array(F.collect_list(F.struct("pos", "entry"))), lambda s: s["entry"])
    return found.agg(indexes.alias("entries"), F.sum("error").alias("error")).drop("uid"), books


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that has a code."""
    rows, books = compress(vectors)
    rows = stored(rows.select("vec_id", "label", F.array_join(F.transform("entries", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "").alias("code"), "error"))
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    sums = F.broadcast(sums) if rows.select("label").distinct().count() <= MOST_BROADCAST else sums
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    joined = rows.join(sums, rows["label"].eqNullSafe(sums["_label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL, with the rounds written out; for tables whose vectors all have one length and distinct vec_ids."""
    out = [f"""k AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
p AS (SELECT vec_id, label, u.pos, x[u.pos * (len(x) // {PARTS}) + 1 : (u.pos + 1) * (len(x) // {PARTS})] AS part FROM k, (SELECT unnest(range({PARTS})) AS pos) u),
d AS (SELECT pos, part, count(*) AS n FROM p GROUP BY pos, part),
b0 AS (SELECT pos, i - 1 AS entry, part FROM (SELECT pos, part, row_number() OVER (PARTITION BY pos ORDER BY vec_id) AS i FROM p) WHERE i <= {ENTRIES})"""]  # fmt: skip
    for r in range(ROUNDS + 1):
        out.append(f"""a{r} AS (SELECT pos, part, n, min((dist, entry)) AS m FROM (SELECT d.pos, d.part, d.n, b{r}.entry,
  list_sum(list_transform(range(1, len(d.part) + 1), lambda t: (d.part[t] - b{r}.part[t]) * (d.part[t] - b{r}.part[t]))) AS dist FROM d JOIN b{r} USING (pos)) GROUP BY pos, part, n)""")
        if r < ROUNDS:
            out.append(f"""s{r} AS (SELECT pos, entry, list(CAST(floor(total / w) AS BIGINT) ORDER BY t) AS part FROM (
  SELECT pos, struct_extract_at(m, 2) AS entry, t, sum(part[t] * n) AS total, sum(n) AS w FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(part)) FROM d) + 1)) AS t) GROUP BY ALL) GROUP BY pos, entry),
b{r + 1} AS (SELECT b{r}.pos, b{r}.entry, coalesce(s{r}.part, b{r}.part) AS part FROM b{r} LEFT JOIN s{r} ON b{r}.pos = s{r}.pos AND b{r}.entry = s{r}.entry)""")
    out.append(f"""v AS (SELECT vec_id, label, string_agg(printf('%02x', struct_extract_at(m, 2)), '' ORDER BY pos) AS code, CAST(sum(struct_extract_at(m, 1)) AS BIGINT) AS error FROM p JOIN a{ROUNDS} USING (pos, part) GROUP BY vec_id, label),
c AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, entry)) AS digest FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM v, c""")
    return "WITH " + ",\n".join(out)


SQL = _sql()
