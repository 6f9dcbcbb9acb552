"""Duplicates, stale messages, loss reconciliation and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoy.operators.scan import running_max_before


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Null guard in front of sinks."""
    for name in columns:
        df = df.filter(F.col(name).isNotNull())
    return df


def first_arrival(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key by arrival.

    The ``== 1`` filter lets Spark keep one row per key in every map task before the shuffle,
    so a large group of copies never travels whole.
    """
    by_key = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(by_key)).filter("_rank = 1").drop("_rank")


def drop_stale(df: DataFrame, keys: list[str], seq: str, order: list[Column], chunk: Column) -> DataFrame:
    """Keeps a row only if its ``seq`` exceeds every ``seq`` that arrived before it for the key.

    ``chunk`` must not decrease along ``order``; it bounds how much of one key a task sorts.
    """
    ranked = running_max_before(df.withColumn("_chunk", chunk), keys, "_chunk", order, seq, "_seen")
    return ranked.filter(F.col("_seen").isNull() | (F.col(seq) > F.col("_seen"))).drop("_seen", "_chunk")


def missing_keys(sent: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct sent keys that never landed. Copies are folded before the join."""
    return sent.select(*keys).distinct().join(landed.select(*keys).distinct(), keys, "left_anti")


def loss_by_key(sent: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """One row: sent, landed, missing and loss percent, with pairs matched exactly."""
    counted = sent.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    marked = counted.join(landed.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    total = F.coalesce(F.sum("_n"), F.lit(0).cast("bigint"))
    lost = F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("_n")).otherwise(0)), F.lit(0).cast("bigint"))
    return marked.agg(total.alias("sent"), lost.alias("missing")).select(
        "sent",
        (F.col("sent") - F.col("missing")).alias("landed"),
        "missing",
        F.try_divide(F.col("missing") * F.lit(100.0), F.col("sent")).alias("loss_pct"),
    )


def loss_by_totals(totals: DataFrame, sent: str, delivered: str) -> DataFrame:
    lost = F.sum(sent) - F.sum(delivered)
    return totals.agg(
        F.sum(sent).alias("sent"),
        F.sum(delivered).alias("delivered"),
        lost.alias("lost"),
        F.coalesce(F.try_divide(lost * F.lit(100.0), F.sum(sent)), F.lit(0.0)).alias("loss_pct"),
    )


def consumer_lag(offsets: DataFrame, group: list[str], high: str, committed: str) -> DataFrame:
    """Sum of ``max(0, high - committed)``; a missing or negative committed offset counts as 0."""
    done = F.greatest(F.coalesce(F.col(committed), F.lit(0)), F.lit(0))
    return offsets.groupBy(*group).agg(F.sum(F.greatest(F.lit(0), F.col(high) - done)).alias("lag"))


def retain(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows not older than ``days``; a plain comparison, so date partitions and row groups are skipped."""
    return df.filter(F.col(ts) >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def storage_tier(df: DataFrame, ts: str, now: Column, hot_days: int = 7) -> DataFrame:
    recent = F.col(ts) >= now - F.expr(f"INTERVAL {int(hot_days)} DAYS")
    return df.withColumn("tier", F.when(recent, F.lit("hot")).otherwise(F.lit("warm")))
