import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("key", T.LongType()), T.StructField("row", T.LongType()),
    T.StructField("words", T.StringType()), T.StructField("size", T.LongType()), T.StructField("fp", T.LongType())])
PROSE = "the quick brown fox jumps over the lazy dog while seven small birds sing in the old green tree near a quiet river bank every calm morning"


def rows():
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names the operators use."""
    texts = [
        (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, PROSE, "en", "b"), (3, None, "en", "a"), (4, "", "en", "a"), (None, PROSE + " then", "en", None),
        (None, None, None, None), (5, "\n \t\n", "de", "b"), (6, "word " * 30_000, "en", "a"), (7, "der die das und ist nicht ein eine mit von zu auf für als auch", "de", "c"),
        (8, "der die das und ist nicht ein eine mit von zu auf für als auch sich", "de", "c"), (9, "### $$$ %%%", "en", "c"), (10, "É è ü ñ 中文 \U0001F600", "fr", "c"),
        (11, PROSE.replace("calm", "cold") + "\n" + PROSE, "en", "a"), (12, "12345 67890", None, "a")]
    return [(*t, None, "s", 1, 2, "w", 3, 4) for t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
