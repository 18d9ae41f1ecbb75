"""Near-duplicates by SimHash, verified through pivot distance tables.

Every distinct fingerprint carries its Hamming distances to fixed reference fingerprints (pivots). Distances obey the
triangle inequality, so two fingerprints within r bits differ by at most r in every coordinate of that table; a pair
with a larger difference is discarded, and only the survivors are compared bit by bit.

The tables alone don't tell which pairs to look at, short of all. Fingerprints meet in buckets: the bits are split
into six blocks, and two fingerprints within three bits agree in three whole blocks at least, so each is put under its
20 choices of three blocks. A bucket with more than ``MOST`` fingerprints is split again in the same way by the bits that
it leaves free, as often as needed; the free bits halve each time, so that buckets are bounded and no pair is lost.
In a bucket only the links of a spanning forest are returned, never all pairs. Equal fingerprints are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, dealt_round, keep_rows, map_texts, text_mark
from tidemark.llm.components import roots

RADIUS, BLOCKS, SEED = 3, 6, 42
ALL = 2**64 - 1
PIVOTS = np.random.default_rng(64).integers(0, 2**64, 16, dtype=np.uint64)
#: Fingerprints of a bucket that one task compares; larger buckets are split again.
MOST = 16_384
#: Free bits of a bucket at each level: 32, 16, 8. At the last one a bucket has 256 fingerprints at most.
LEVELS = 3
#: Buckets of so many fingerprints at most are compared many at a time.
FEW = 8
#: Shingles whose bits are counted at a time.
SHINGLES = 65_536


def fingerprint(text: str, width: int = 3) -> int:
    """SimHash of the word shingles: a bit is 1 if it is set in over half of their hashes; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), SHINGLES):
        hashes = b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[at : at + SHINGLES], stops[at : at + SHINGLES], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, mark (of the text), fp (the 64 bits as a signed number). Null and empty texts have fingerprint 0."""

    def run(ids: list, texts: list[str]) -> dict:
        found = np.fromiter((fingerprint(x, width) for x in texts), np.uint64, len(texts))
        return {"id": ids, "fp": found.view(np.int64)}

    found = map_texts(docs, lambda: run, "id struct<doc_id:bigint,mark:bigint>, fp bigint", id_col=F.struct("doc_id", text_mark().alias("mark")).alias("id"))
    return found.select("id.doc_id", "id.mark", "fp")


def _masks(free: int) -> list[int]:
    """Masks of the bits that a bucket shares, among the bits of ``free``: all choices of three of six blocks."""
    bits = [b for b in range(64) if free >> b & 1]
    blocks = [sum(1 << b for b in bits[k * len(bits) // BLOCKS : (k + 1) * len(bits) // BLOCKS]) for k in range(BLOCKS)]
    return [sum(c) for c in combinations(blocks, BLOCKS - RADIUS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(fp: np.ndarray, table: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Positions in ``others`` of those within RADIUS bits of i: by the pivot table first, then by the bits."""
    at = np.arange(len(others))
    for p in range(table.shape[1]):
        at = at[np.abs(table[others[at], p] - table[i, p]) <= RADIUS]
        if len(at) < 2:
            break
    return at[np.bitwise_count(fp[others[at]] ^ fp[i]) <= RADIUS]


def pivot_table(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links (index, index) of a spanning forest of the fingerprints within RADIUS bits of each other."""
    table = pivot_table(fp)
    links, rest = [], np.arange(len(fp))
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            at = _near(fp, table, i, rest)
            if len(at):
                near = rest[at].tolist()
                links += [(i, j) for j in near]
                todo += near
                rest = np.delete(rest, at)
    return links


def _link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, fp, node) sorted by bucket -> links (u, v). A bucket may go on in the next batch."""
    kept: list[np.ndarray] = []
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(bucket: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        fp = fp.view(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        size = np.diff(np.concatenate((first, [len(bucket)])))
        of_row = np.repeat(size, size)
        table = pivot_table(fp)
        u, v = [], []
        for d in range(1, FEW):  # small buckets all at once: row i with row i + d
            i = np.flatnonzero((bucket[d:] == bucket[:-d]) & (of_row[d:] <= FEW))
            i = i[np.abs(table[i] - table[i + d]).max(axis=1) <= RADIUS] if len(i) else i
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= RADIUS]
            u += i.tolist()
            v += (i + d).tolist()
        for a, n in zip(first[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
            for i, j in forest(fp[a : a + n]):
                u.append(a + i)
                v.append(a + j)
        return pa.RecordBatch.from_arrays([pa.array(node[np.array(x, np.int64)]) for x in (u, v)], schema=schema)

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if kept:
            cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
        if len(cols[0]):
            whole = len(cols[0]) - int(np.argmax((cols[0] != cols[0][-1])[::-1])) if cols[0][0] != cols[0][-1] else 0
            kept = [c[whole:] for c in cols]
            if whole:
                yield links(*(c[:whole] for c in cols))
    if kept and len(kept[0]):
        yield links(*kept)


def _split_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fp, node, fixed) of large buckets -> 20 rows each, which also fix three of six blocks of the free bits."""
    finer = lru_cache(None)(lambda fixed: np.array([_signed(fixed | m) for m in _masks(ALL & ~fixed)], np.int64))
    for batch in batches:
        fp, node, fixed = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        masks = [finer(x & ALL) for x in fixed.tolist()]
        n = [len(x) for x in masks]
        yield pa.RecordBatch.from_pydict({"fp": np.repeat(fp, n), "node": np.repeat(node, n), "fixed": np.concatenate([*masks, np.array([], np.int64)])})


def link(nodes: DataFrame) -> DataFrame:
    """Links (u, v) that connect the nodes (fp, node; distinct fp) just as all links within RADIUS bits do.

    Bucket sizes are counted with partial sums; fingerprints alone in a bucket are dropped before rows go to tasks.
    """
    masks = F.array(*(F.lit(_signed(m)).cast("bigint") for m in _masks(ALL)))
    keyed = nodes.select("fp", "node", F.explode(masks).alias("fixed"))
    found = None
    for level in range(LEVELS):
        keyed = keyed.withColumn("value", F.col("fp").bitwiseAND(F.col("fixed")))
        sizes = keyed.groupBy("fixed", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = cut(keyed.join(dealt_round(sizes), ["fixed", "value"]).select(F.xxhash64("fixed", "value").alias("bucket"), "fp", "node", "fixed", "n"))
        last = level == LEVELS - 1
        small = (shared if last else shared.filter(F.col("n") <= MOST)).select("bucket", "fp", "node")
        links = small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_link_buckets, "u bigint, v bigint")
        found = links if found is None else found.unionByName(links)
        large = shared.filter(F.col("n") > MOST).select("fp", "node", "fixed")
        if last or large.isEmpty():
            break
        keyed = large.mapInArrow(_split_again, "fp bigint, node bigint, fixed bigint")
    return found


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, mark, fp, root, component_id, size of every row of docs.

    component_id is the smallest doc_id reachable through links, its own included; root (a fingerprint) tells components
    apart and size is the number of their rows with a doc_id. Null and empty texts have fingerprint 0 and link like others.
    Rows with a null doc_id have a null component_id and link nothing. Repeated rows give repeated rows; rows that share a
    doc_id only aren't linked by that. Extra columns are ignored.
    """
    rows = cut(fingerprints(docs))
    nodes = cut(rows.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = roots(link(nodes.select("fp", F.col("fp").alias("node"))))
    rooted = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n")
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("size"))
    of_fp = rooted.select(F.col("fp").alias("of_fp"), "root").join(dealt_round(groups), "root")
    joined = rows.join(of_fp, F.col("fp") == F.col("of_fp"), "left")
    return joined.select("doc_id", "mark", "fp", *(F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("root", "component_id", "size")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group, that with the smallest doc_id, with all columns; rows with a null doc_id all stay.

    Of rows of a group that share this doc_id, that with the least hash of its text stays. A doc_id that repeats in another
    group is another row and stays there if it's the first.
    """
    found = cut(classes(docs).filter("size > 1").select("doc_id", "mark", "root", (F.col("doc_id") == F.col("component_id")).alias("kept")))
    ties = cut(found.filter("kept").groupBy("root").agg(F.min("mark").alias("first"), F.max("mark").alias("last")).filter("first < last"))
    if not ties.isEmpty():
        found = found.join(ties, "root", "left").withColumn("kept", F.col("kept") & (F.col("mark") == F.coalesce("first", "mark")))
    return keep_rows(docs, found.select("doc_id", "mark", "kept"))
