"""What the operators share: word patterns, the shared folder, stored intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoy.session import ensure_checkpoint_dir

#: A word: a run of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """All words of the text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null keys are in fold 0."""
    return F.coalesce(F.crc32(key.cast("string")) % folds, F.lit(0).cast("long"))


def documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text: other columns, whatever their names, take no part."""
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
