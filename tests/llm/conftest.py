import pytest

LONG = " ".join(f"word{i % 977} alpha" for i in range(12_000))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog. " * 8),
    (2, "The quick brown fox jumps over the lazy dog. " * 8),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, LONG),
    (7, "password = \"S3cretValue99\" and mail joe@mail.com or +1 (415) 555-0100, card 4111 1111 1111 1111"),
    (7, "password = \"S3cretValue99\" and mail joe@mail.com or +1 (415) 555-0100, card 4111 1111 1111 1111"),
    (None, "a row without an id " * 12),
    (9, "é漢字 😀 \x00 tail"),
    (10, "The quick  brown fox jumps over the lazy dog. " * 8),
    (11, "x" * 3000),
]
#: Names that the operators use for columns of their own.
CLASHING = ["fp", "node", "uid", "n", "sha", "key", "spans", "id", "component_id", "kept", "x", "score", "items", "bucket", "term"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, long and repeated texts, and extra columns with awkward names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id bigint, text string").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    return df.select("*", *(F.lit(7).alias(c) for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, 0), (6, None, 0), (None, 1, 0), (9, 0, 1), (11, 0, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog the quick brown fox jumps over"), (2, "lazy"), (3, None), (4, ""), (None, "fox"), (5, "lazy")], "item_id bigint, text string")
