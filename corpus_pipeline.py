"""From raw documents to token ids: reject poor documents, drop exact and near copies, drop what holds benchmark items, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns
of ``documents``.

Defined results: null and empty texts are texts like others in every stage (the classifier scores them, all of them are equal,
they have no words and no tokens). A null doc_id is kept by what its text says, and near duplicates of it aren't looked for.
A doc_id that repeats with another text is another row; of rows that agree in both, one stays after the second stage. Empty
tables give empty tables. Extra columns go along up to the last stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, exact_dedup, quality, simhash
from tidemark.llm.common import shared_folder, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; without labels none do."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays, then that of the smallest doc_id (null comes last)."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest doc_id stays; rows with a null doc_id stay."""
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth of the words go; those without words stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the decoded bytes of every row; null and empty texts have no tokens."""
    return bpe.encode(docs, str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]

#: The first stage is a trained model: SQL can't express it.
ORACLE_SQL = None


def _is_done(spark: SparkSession, path: str) -> bool:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def run(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    """All stages over ``documents``; each is written to a shared folder and read again.

    ``where`` names that folder, for a run that may be resumed: a stage that was written there whole isn't run again.
    Without it each run has a folder of its own in ``spark.checkpoint.dir``.
    """
    where = where or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{where}/{k}-{name}"
        if not _is_done(spark, out):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
    return docs
