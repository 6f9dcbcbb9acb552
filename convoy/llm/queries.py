"""Registered queries of the operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.llm import alignment, classifier, decontaminate, extraction, language, lines, merkle, mixing, passages, quality_rules, simhash, sketches, tokens

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents")).drop("rule")


def op2_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_read(spark, sf_dir, "documents"))


def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(_read(spark, sf_dir, "pages"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(_read(spark, sf_dir, "documents"), tokenizer_path())


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.classify(_read(spark, sf_dir, "documents"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.report(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_repeats", "n_near", "n_kept", F.array_join("removed", ",").alias("removed_lines"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_read(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_read(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model")).drop("groups")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edits(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_classifier": op2_classifier,
    "op3_passages": op3_passages,
    "op4_extraction": op4_extraction,
    "op5_tokens": op5_tokens,
    "op6_language": op6_language,
    "op7_lines": op7_lines,
    "op8_mixing": op8_mixing,
    "op9_decontaminate": op9_decontaminate,
    "op10_simhash": op10_simhash,
    "op11_merkle": op11_merkle,
    "op12_alignment": op12_alignment,
    "op13_fingerprints": op13_fingerprints,
}

SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.SQL,
    "op7_lines": lines.SQL,
    "op8_mixing": mixing.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op11_merkle": merkle.SQL,
}
