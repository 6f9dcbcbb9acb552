"""Trouble-code catalogue and failure signatures used by the similarity search, built from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from convoy.operators.search import upsert_catalogue


def build(stored_codes: DataFrame | None, codes: DataFrame, signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(codes upserted into the stored catalogue, signatures replaced as a whole), both with vectors of the description."""
    return upsert_catalogue(stored_codes, codes, "code", "description"), upsert_catalogue(None, signatures, "failure_type", "description")
