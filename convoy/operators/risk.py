"""Predictions to at-risk list: latest risk, booking exclusion, pages and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CRITICAL_RISK = 0.7
DISTRIBUTION_RISK = 0.5
HORIZON_DAYS = 30
MIN_SCORE = 0.01
VECTOR_SIZE = 384


def _first_per(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    # ``= 1`` is pushed below the shuffle as a per-task group limit
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def latest_model(predictions: DataFrame) -> DataFrame:
    """Model version of the newest prediction of each tenant (highest version on ties).

    Predictions are first hashed down to one row per version; only those few rows are compared.
    """
    versions = predictions.groupBy("tenant_id", "model_version").agg(F.max("created_at").alias("_newest"))
    return versions.groupBy("tenant_id").agg(F.max_by("model_version", F.struct("_newest", "model_version")).alias("model_version"))


def latest_risk(predictions: DataFrame, tie: str, horizon: int = HORIZON_DAYS) -> DataFrame:
    """One row per vehicle: highest risk with ``0 < lead <= horizon`` from its tenant's latest model."""
    due = predictions.filter((F.col("lead_days") > 0) & (F.col("lead_days") <= horizon))
    current = due.join(latest_model(predictions), ["tenant_id", "model_version"], "left_semi")
    return _first_per(current, "vehicle_id", [F.col("risk_score").desc(), F.col("created_at").desc(), F.col(tie)])


def latest_prediction(predictions: DataFrame, tie: str) -> DataFrame:
    """Newest prediction per vehicle, then highest risk; no horizon or model filter."""
    return _first_per(predictions, "vehicle_id", [F.col("created_at").desc(), F.col("risk_score").desc(), F.col(tie)])


def not_booked_since(risk: DataFrame, bookings: DataFrame) -> DataFrame:
    """Drops vehicles with a booking created after their score.

    Bookings are reduced to the newest per vehicle, which turns the inequality anti join into
    an equality join with at most one match.
    """
    newest = bookings.groupBy("vehicle_id").agg(F.max("created_at").alias("_booked"))
    joined = risk.join(newest, "vehicle_id", "left")
    return joined.filter(F.col("_booked").isNull() | (F.col("_booked") <= F.col("created_at"))).drop("_booked")


def at_risk(risk: DataFrame, bookings: DataFrame, vehicles: DataFrame, depots: DataFrame) -> DataFrame:
    """Unbooked at-risk vehicles with their VIN and home depot."""
    return (
        not_booked_since(risk, bookings)
        .join(vehicles.select("vehicle_id", "vin", "depot_id"), "vehicle_id")
        .join(depots.select("depot_id", "depot_name", "depot_city"), "depot_id")
        .select("vehicle_id", "vin", "failure_type", "risk_score", "lead_days", "depot_name", "depot_city")
    )


def keyset_page(df: DataFrame, size: int, cursor: tuple[float, int] | None = None, score: str = "risk_score", key: str = "vehicle_id") -> DataFrame:
    """Next ``size`` rows below the cursor in (score desc, key desc); a top-n per task, then a merge."""
    if cursor is not None:
        last_score, last_key = F.lit(cursor[0]), F.lit(cursor[1])
        df = df.filter((F.col(score) < last_score) | ((F.col(score) == last_score) & (F.col(key) < last_key)))
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(key).desc_nulls_last()).limit(size)


def next_cursor(page: DataFrame, size: int, score: str = "risk_score", key: str = "vehicle_id") -> DataFrame:
    """The last row's (score, key) if the page is full; no row otherwise."""
    last = page.agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.col(score), F.col(key))).alias("_last")
    ).filter(F.col("_n") == size)
    return last.select(F.col(f"_last.{score}").alias(score), F.col(f"_last.{key}").alias(key))


def offset_page(df: DataFrame, size: int, offset: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def newest_rows(df: DataFrame, size: int, order: list[Column]) -> DataFrame:
    """Top-n report: each task keeps its own best ``size`` rows before the merge."""
    return df.orderBy(*order).limit(size)


def newest_per_group(df: DataFrame, group: str, size: int, order: list[Column]) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= size).drop("_rank")


def risk_percent(risk: Column) -> Column:
    """Percent text with one decimal. ``format_number`` rounds the exact binary value, half to even."""
    return F.concat(F.replace(F.format_number(risk.cast("double") * F.lit(100.0), 1), F.lit(",")), F.lit("%"))


def risk_distribution(risk: DataFrame, least: float = DISTRIBUTION_RISK) -> DataFrame:
    counted = risk.filter(F.col("risk_score") >= least).groupBy("failure_type")
    return counted.agg(F.count(F.lit(1)).alias("at_risk_vehicles")).orderBy(F.col("at_risk_vehicles").desc(), "failure_type")


def risk_summary(risk: DataFrame, critical: float = CRITICAL_RISK) -> DataFrame:
    """Total, critical count, mean known lead and the most common type (alphabetical on ties)."""
    per_type = risk.groupBy("failure_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("risk_score") >= critical).alias("c"),
        F.sum("lead_days").alias("lead"), F.count("lead_days").alias("known"),
    )
    return per_type.agg(
        F.sum("n").alias("total"), F.sum("c").alias("critical"),
        F.try_divide(F.sum("lead"), F.sum("known")).alias("avg_lead"),
        F.min_by("failure_type", F.struct(-F.col("n"), F.col("failure_type"))).alias("top_type"),
        F.max("n").alias("top_count"),
    )


def alerts(alerts: DataFrame, vehicles: DataFrame, open_only: bool) -> DataFrame:
    kept = alerts.filter(F.col("closed_at").isNull()) if open_only else alerts
    return kept.join(vehicles.select("vehicle_id", "vin"), "vehicle_id")


def alert_summary(alerts: DataFrame, tie: str) -> DataFrame:
    severity = F.lower("severity")
    return alerts.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(severity == "critical").alias("critical"),
        F.count_if(severity == "high").alias("high"),
        F.max_by(tie, F.struct(F.col("opened_at"), F.col(tie))).alias("newest"),
    )


def alerts_per_day(alerts: DataFrame, now: Column, days: int = 30) -> DataFrame:
    recent = alerts.filter(F.col("opened_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    return recent.groupBy(F.to_date("opened_at").alias("day")).agg(F.count(F.lit(1)).alias("alerts_opened"))


def hours_to_approval(orders: DataFrame) -> DataFrame:
    """Mean hours from creation to approval, one decimal."""
    seconds = F.timestamp_diff("SECOND", F.col("created_at"), F.col("approved_at"))
    return orders.filter(F.col("approved_at").isNotNull()).agg(
        F.round(F.avg(seconds) / F.lit(3600.0), 1).alias("avg_hours_to_approve")
    )


def long_scores(scored: DataFrame, types: list[str], features: list[str], version: str, lead: Column, least: float = MIN_SCORE, key: str = "vin") -> DataFrame:
    """One row per (vehicle, type) above ``least``: rounded risk, lead estimate, zero-padded inputs."""
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("failure_type"), F.col(t).alias("score")) for t in types]))
    vector = F.concat(
        F.array(*[F.col(f).cast("double") for f in features]),
        F.array_repeat(F.lit(0.0), VECTOR_SIZE - len(features)),
    )
    long = scored.withColumn("_s", pairs).filter(F.col("_s.score") >= least)
    return long.withColumn("failure_type", F.col("_s.failure_type")).select(
        key, "failure_type", F.round("_s.score", 5).alias("risk_score"), lead.alias("lead_days"),
        F.lit(version).alias("model_version"), vector.alias("feature_vector"),
    )


def top_scores(long: DataFrame, size: int | None = None, key: str = "vin") -> DataFrame:
    """The highest scores first; all of them unless ``size`` says how many."""
    if size is None:
        return long
    return long.orderBy(F.col("risk_score").desc(), key, "failure_type").limit(size)


def to_predictions(long: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Rows of known vehicles with their id; unknown VINs are dropped. Stored decimal types apply."""
    return long.join(vehicles.select("vin", "vehicle_id"), "vin").withColumns(
        {"risk_score": F.col("risk_score").cast("decimal(6,5)"), "lead_days": F.col("lead_days").cast("decimal(4,1)")}
    )
