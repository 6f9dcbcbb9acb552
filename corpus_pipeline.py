"""From raw documents to token files: five stages, each over all that its predecessor kept, in Parquet between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.llm import classifier, decontaminate, mixing, simhash, tokens
from convoy.llm.common import scratch
from convoy.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels outside its held-out fold, gives at least one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.accepted(docs, classifier.fit(classifier.training_rows(docs, labels)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash (4-word shingles, at most 4 bits) the one with the smallest id."""
    return simhash.first_of_each(docs, width=4, distance=4)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated: under a twentieth of the words stand in benchmark windows."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture takes them."""
    return mixing.repeated(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, and per row what the files hold: doc_id, start, n_tokens, ids_crc32."""
    return tokens.token_table(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", clean_of_benchmark),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", token_files),
]

#: The classifier and the tokenizer have no SQL form; the tests hold the run against its operators applied one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = scratch(spark, f"stage{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
