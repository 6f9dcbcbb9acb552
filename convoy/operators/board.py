"""Work orders, bookings and the maintenance board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN_STATUSES = ("approved", "in_service")
CLOSED_STATUSES = ("completed", "rejected")
DEFAULT_BOOKING_HOURS = 4


def work_order_states(log: DataFrame, order: str = "work_order_id", at: str = "at", tie: str = "event_id") -> DataFrame:
    """Final state per work order from its action log (approve, reject, start, complete).

    Every order begins as proposed. The first approve or reject decides; after an approval the
    first complete closes it and a start counts only before that. An action that its state does
    not allow changes nothing. Each step is a minimum per order, so long logs combine on the
    map side instead of being gathered and replayed in one task.
    """
    point = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"))
    action = F.col("action")
    decided = log.groupBy(order).agg(
        F.min(F.when(action.isin("approve", "reject"), F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), action.alias("action")))).alias("_d")
    )
    later = log.filter(action.isin("start", "complete")).join(
        decided.filter(F.col("_d.action") == "approve").select(order, F.struct("_d.at", "_d.tie").alias("_from")), order
    ).filter(point > F.col("_from"))
    moved = later.groupBy(order).agg(
        F.min(F.when(action == "start", point)).alias("_s"), F.min(F.when(action == "complete", point)).alias("_c")
    )
    started = F.when(F.col("_c").isNull() | (F.col("_s") < F.col("_c")), F.col("_s.at"))
    status = (
        F.when(F.col("_d").isNull(), "proposed")
        .when(F.col("_d.action") == "reject", "rejected")
        .when(F.col("_c").isNotNull(), "completed")
        .when(F.col("_s").isNotNull(), "in_service")
        .otherwise("approved")
    )
    return decided.join(moved, order, "left").select(
        order, status.alias("status"),
        F.when(F.col("_d.action") == "approve", F.col("_d.at")).alias("approved_at"),
        F.when(F.col("_d.action") == "reject", F.col("_d.at")).alias("rejected_at"),
        started.alias("started_at"), F.col("_c.at").alias("completed_at"),
    )


def release_bays(bookings: DataFrame, orders: DataFrame) -> DataFrame:
    """A completed order ends its booking at the completion time if that is earlier."""
    done = orders.filter(F.col("completed_at").isNotNull()).select("work_order_id", "completed_at")
    return bookings.join(done, "work_order_id", "left").withColumn(
        "booked_until", F.least("booked_until", "completed_at")
    ).drop("completed_at")


def booked_until(start: Column, hours: Column | int = DEFAULT_BOOKING_HOURS) -> Column:
    hours = F.lit(hours) if isinstance(hours, int) else hours
    return start + F.make_dt_interval(F.lit(0), hours)


def depot_occupancy(depots: DataFrame, bookings: DataFrame, now: Column) -> DataFrame:
    """Depots with their active bookings (``booked_until`` after ``now``) and free bays."""
    active = bookings.filter(F.col("booked_until") > now).groupBy("depot_id").agg(F.count(F.lit(1)).alias("_n"))
    return depots.join(active, "depot_id", "left").withColumn(
        "active_bookings", F.coalesce(F.col("_n"), F.lit(0).cast("long"))
    ).drop("_n").withColumn("free_bays", F.col("bays") - F.col("active_bookings"))


def open_booking_vehicles(bookings: DataFrame, orders: DataFrame) -> DataFrame:
    """Vehicles that already hold a booking whose work order is still open."""
    live = orders.filter(F.col("status").isin(*OPEN_STATUSES)).select("work_order_id")
    return bookings.join(live, "work_order_id", "left_semi").select("vehicle_id").distinct()


def _with_prediction(rows: DataFrame, latest: DataFrame) -> DataFrame:
    return rows.join(latest.select("vehicle_id", "failure_type", "risk_score", "lead_days"), "vehicle_id", "left")


def pending(orders: DataFrame, vehicles: DataFrame, latest: DataFrame) -> DataFrame:
    """Proposed work orders; list them oldest first."""
    rows = orders.filter(F.col("status") == "proposed").join(vehicles.select("vehicle_id", "vin"), "vehicle_id")
    return _with_prediction(rows, latest).select(
        "work_order_id", "vehicle_id", "vin", "proposed_by", "created_at", "failure_type", "risk_score", "lead_days"
    )


def scheduled(bookings: DataFrame, orders: DataFrame, vehicles: DataFrame, depots: DataFrame, latest: DataFrame, statuses: tuple[str, ...] = ("approved",)) -> DataFrame:
    """Booked vehicles whose work order is in one of ``statuses``; list them by ``shown_at`` newest first."""
    chosen = orders.filter(F.col("status").isin(*statuses)).select("work_order_id", "status", "started_at")
    rows = (
        bookings.join(chosen, "work_order_id")
        .join(vehicles.select("vehicle_id", "vin"), "vehicle_id")
        .join(depots.select("depot_id", "depot_name", "depot_city"), "depot_id")
    )
    return _with_prediction(rows, latest).select(
        "booking_id", "work_order_id", "vehicle_id", "vin", "status", "failure_type", "risk_score", "lead_days",
        "depot_name", "depot_city", "booked_from", "booked_until", "started_at",
        F.coalesce("started_at", "booked_from").alias("shown_at"),
    )


def recently_closed(orders: DataFrame, bookings: DataFrame, vehicles: DataFrame, depots: DataFrame, latest: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Orders closed within ``days``; an order with several bookings appears once per booking."""
    closed_at = F.coalesce("completed_at", "rejected_at")
    rows = (
        orders.filter(F.col("status").isin(*CLOSED_STATUSES) & (closed_at > now - F.expr(f"INTERVAL {int(days)} DAYS")))
        .select("work_order_id", "vehicle_id", "status", closed_at.alias("closed_at"))
        .join(vehicles.select("vehicle_id", "vin"), "vehicle_id")
        .join(bookings.select("work_order_id", "depot_id"), "work_order_id", "left")
        .join(depots.select("depot_id", "depot_city"), "depot_id", "left")
    )
    return _with_prediction(rows, latest).select(
        "work_order_id", "vehicle_id", "vin", "status", "closed_at", "failure_type", "depot_city"
    )


def board_counts(orders: DataFrame) -> DataFrame:
    return orders.groupBy("status").agg(F.count(F.lit(1)).alias("orders"))


def vehicle_health(vehicles: DataFrame, models: DataFrame, depots: DataFrame, alerts: DataFrame, twin: DataFrame) -> DataFrame:
    """Vehicle, model, depot, open-alert summary and latest state, one row per vehicle.

    Alerts are summarised per vehicle; the list itself is ``risk.alerts(open_only=True)``, which
    stays one row per alert so that a noisy vehicle does not grow into one huge cell.
    """
    opened = alerts.filter(F.col("closed_at").isNull()).groupBy("vehicle_id").agg(
        F.count(F.lit(1)).alias("open_alerts"), F.max("opened_at").alias("last_opened_at"),
        F.array_sort(F.collect_set("failure_type")).alias("open_types"),
    )
    return (
        vehicles.join(models, "model_id")
        .join(depots.select("depot_id", "depot_name", "depot_city"), "depot_id")
        .join(opened, "vehicle_id", "left")
        .join(twin, "vin", "left")
        .withColumn("open_alerts", F.coalesce("open_alerts", F.lit(0).cast("long")))
    )
