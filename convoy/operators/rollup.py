"""Daily rollups, their incremental refresh and the fleet trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum}
# Columns of the daily rollup by measure: measure -> (aggregate, output).
ROLLUP_COLUMNS = {
    "coolant_c": [("avg", "avg_coolant_c"), ("max", "max_coolant_c")], "ambient_c": [("avg", "avg_ambient_c")], "load_pct": [("avg", "avg_load_pct")],
    "rpm": [("avg", "avg_rpm")], "oil_kpa": [("avg", "avg_oil_kpa"), ("min", "min_oil_kpa")], "trans_c": [("avg", "avg_trans_c"), ("max", "max_trans_c")],
    "speed_kmh": [("max", "max_speed_kmh")], "fuel_rate_lph": [("sum", "fuel_rate_sum")],
}


def daily_table(readings: DataFrame, columns: dict[str, list[tuple[str, str]]], count: str, ts: str, key: str = "vin") -> DataFrame:
    """One row per key and day: each measure's (aggregate, output) pairs, and the number of readings as ``count``."""
    outputs = [AGGREGATES[how](measure).alias(out) for measure, pairs in columns.items() for how, out in pairs]
    return readings.groupBy(key, F.to_date(ts).alias("day")).agg(*outputs, F.count("*").alias(count))


def daily_rollup(fast: DataFrame, ts: str = "event_time", key: str = "vin") -> DataFrame:
    """One row per vehicle and day. The key has no tenant, as in the stored rollup."""
    return daily_table(fast, ROLLUP_COLUMNS, "sample_count", ts, key)


def refresh_window(now: Column, start_days: int = 3, end_hours: int = 1) -> tuple[Column, Column]:
    """First and last whole day inside ``[now - start, now - end]``."""
    start = now - F.expr(f"INTERVAL {int(start_days)} DAYS")
    end = now - F.expr(f"INTERVAL {int(end_hours)} HOURS")
    first = F.when(F.date_trunc("day", start) == start, F.to_date(start)).otherwise(F.date_add(F.to_date(start), 1))
    return first, F.date_sub(F.to_date(end), 1)


def refreshed_days(raw: DataFrame, now: Column, ts: str = "event_time", start_days: int = 3, end_hours: int = 1) -> DataFrame:
    """Rollup of only the days due for a refresh; the day bounds reach the scan as a filter on ``ts``."""
    first, last = refresh_window(now, start_days, end_hours)
    due = raw.filter((F.col(ts) >= first.cast("timestamp_ntz")) & (F.col(ts) < F.date_add(last, 1).cast("timestamp_ntz")))
    return daily_rollup(due, ts)


def refresh(stored: DataFrame, raw: DataFrame, now: Column, ts: str = "event_time", start_days: int = 3, end_hours: int = 1) -> DataFrame:
    """Stored rollup with the days of the refresh window replaced."""
    first, last = refresh_window(now, start_days, end_hours)
    kept = stored.filter(~F.col("day").between(first, last))
    return kept.unionByName(refreshed_days(raw, now, ts, start_days, end_hours))


def write_refreshed(raw: DataFrame, path: str, now: Column, ts: str = "event_time", start_days: int = 3, end_hours: int = 1) -> None:
    """Replaces only the refreshed day directories of the stored rollup.

    The rebalance hint lets Spark merge small and split large days into files of even size.
    """
    days = refreshed_days(raw, now, ts, start_days, end_hours).hint("rebalance", "day")
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def fleet_trend(daily: DataFrame, columns: list[str]) -> DataFrame:
    """Mean over vehicles of their daily means (each vehicle weighs the same)."""
    return daily.groupBy("day").agg(*[F.avg(c).alias(c) for c in columns])
