"""Query registry used by the entry module, the tests and the benchmark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    sql: str | None
    covers: tuple[str, ...]


ENTRIES: dict[str, Entry] = {}


def query(name: str, *covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers ``fn(spark, sf_dir)`` under ``name`` with the inventory ids it covers."""

    def register(fn: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(name, fn, sql, covers)
        return fn

    return register
