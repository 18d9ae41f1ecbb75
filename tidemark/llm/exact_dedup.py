"""Exact duplicates by two passes of a Bloom filter, with DataFrame functions only.

First pass: the hash of every normalised text gives positions in a filter; positions are counted (with partial sums
before the shuffle) and those hit more than once are packed into a bitmap of fixed size. Second pass: a row is
possibly repeated only if all its positions are in the bitmap. Such rows are grouped by their SHA-256; the others
pass straight through. The bitmap is broadcast: at most ``MOST_BITS / 8`` bytes (16 MiB) whatever the input. Beyond
about MOST_BITS / 8 rows it lets more rows through to the exact grouping, which moves about 50 bytes a row, never texts.

Defined results: null text counts as empty; empty texts are equal to each other; a null doc_id loses ties; of rows
that agree in doc_id and length too, that with the least hash of its text, or one of them, is kept. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, dealt_round, keep_rows, text_mark

LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: Positions in the filter for each row, and bits of the filter for each row as long as MOST_BITS allows.
POSITIONS, BITS_A_ROW = 2, 32


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, n (code points of the original text), sha (32 bytes), mark (of the original text), uid (tells repeated rows apart)."""
    return docs.select(
        "doc_id",
        F.char_length(F.coalesce("text", F.lit(""))).alias("n"),
        F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("sha"),
        text_mark().alias("mark"),
        F.monotonically_increasing_id().alias("uid"),
    )


def positions(bits: int) -> list:
    return [F.pmod(F.xxhash64(F.lit(k), F.col("sha")), F.lit(bits)) for k in range(POSITIONS)]


def repeat_filter(rows: DataFrame, bits: int) -> DataFrame:
    """bucket, bitmap (4 KiB each): positions that more than one row has."""
    return (
        rows.select(F.explode(F.array(*positions(bits))).alias("p"))
        .groupBy("p")
        .count()
        .filter("count > 1")
        .select(F.expr("bitmap_bucket_number(p) AS bucket"), F.expr("bitmap_bit_position(p) AS at"))
        .groupBy("bucket")
        .agg(F.expr("bitmap_construct_agg(at) AS bitmap"))
    )


def _find(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, sha, mark."""
    rows = cut(hashed(docs))
    n = rows.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n * BITS_A_ROW).bit_length()))
    bitmap = F.broadcast(repeat_filter(rows, bits))
    tested = rows
    for k, p in enumerate(positions(bits)):
        mine = bitmap.select(F.col("bucket").alias(f"b{k}"), F.col("bitmap").alias(f"m{k}"))
        tested = tested.withColumn(f"p{k}", p).join(mine, F.expr(f"bitmap_bucket_number(p{k}) = b{k}"), "left")
        byte = f"conv(hex(substring(m{k}, CAST(bitmap_bit_position(p{k}) DIV 8 AS INT) + 1, 1)), 16, 10)"
        tested = tested.withColumn(f"hit{k}", F.expr(f"coalesce(getbit(CAST({byte} AS BIGINT), CAST(bitmap_bit_position(p{k}) % 8 AS INT)) = 1, false)"))
    tested = tested.withColumn("again", F.expr(" AND ".join(f"hit{k}" for k in range(POSITIONS)))).select("doc_id", "n", "sha", "mark", "uid", "again")
    once = tested.filter("NOT again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "mark")
    again = tested.filter("again")
    first = F.min(F.struct((-F.col("n")).alias("n"), F.isnull("doc_id").alias("no_id"), "doc_id", "mark", "uid"))
    groups = again.groupBy("sha").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    grouped = again.join(dealt_round(groups), "sha").select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"), "sha", "mark")
    return once.unionByName(grouped)


def find(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return _find(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns.

    Rows are known by doc_id and text: a doc_id that repeats with another text is another row. Of rows that agree in both
    and stay, one stays. A null doc_id is an id like others, but loses ties.
    """
    return keep_rows(docs, _find(docs).filter("group_size > 1"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
