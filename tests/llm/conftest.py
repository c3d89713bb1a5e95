import pytest

#: Rows that every operator must take: nulls, empty and blank texts, ties, repeated rows, a very long text, odd characters.
LONG = " ".join(f"word{i % 977} other{i % 13}" for i in range(30_000))
ODD = [
    (1, "the same text again and again, said one", "en", "s0"),
    (2, "the same text again and again, said one", "en", "s0"),
    (2, "the same text again and again, said one", "en", "s0"),
    (3, None, "en", "s1"),
    (4, "", None, "s1"),
    (5, " \n\t ", "de", None),
    (None, "a text without a number", "de", "s2"),
    (None, None, None, None),
    (6, LONG, "en", "s0"),
    (7, "d'été <|endoftext|> Ünïcode ☃ 12,5 \x00\x1f İ", "fr", "s1"),
    (8, "***### $$$ 123", None, "s2"),
    (-9, "tiny", "es", "s2"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    clash = ("uid", "piece", "start", "length", "fp", "score", "lang_pred", "kept", "key", "block", "n", "s", "b", "k", "recipe", "mix_x", "salt", "a.b", "mix_epoch", "_key", "_sha", "_mix_s", "salts")
    return rows.select("*", *(F.lit(i).alias(c) for i, c in enumerate(clash))).checkpoint()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def table(spark):
    """All documents of the smallest tables."""
    import os

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    return spark.read.parquet(path)
