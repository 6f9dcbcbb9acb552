"""Queries on predictions, bookings, work orders and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoy.operators import board, risk
from convoy.plans import derive as d
from convoy.plans.registry import query

BOARD_SQL = f"TIMESTAMP '{d.BOARD_NOW}'"
_FLEET = f"{d.VEHICLES}, {d.DEPOTS}, {d.PREDICTIONS}, {d.WORK_ORDERS}, {d.BOOKINGS}, home AS (SELECT *, model_id % 10 AS depot_id FROM vehicles)"


def board_now():
    return F.lit(d.BOARD_NOW).cast("timestamp_ntz")


# --- predictions ----------------------------------------------------------------------------------
_MODEL_SQL = "lm AS (SELECT tenant_id, arg_max(model_version, (created_at, model_version)) AS model_version FROM predictions GROUP BY tenant_id)"
_RISK_SQL = f"""{_MODEL_SQL}, lr AS (SELECT * EXCLUDE (rn) FROM (SELECT p.*, row_number() OVER (PARTITION BY vehicle_id ORDER BY risk_score DESC, created_at DESC, prediction_id) AS rn
  FROM predictions p JOIN lm USING (tenant_id, model_version) WHERE lead_days > 0 AND lead_days <= 30) WHERE rn = 1)"""
_LAST_SQL = """lp AS (SELECT * EXCLUDE (rn) FROM (SELECT p.*, row_number() OVER (PARTITION BY vehicle_id ORDER BY created_at DESC, risk_score DESC, prediction_id) AS rn
  FROM predictions p) WHERE rn = 1)"""
_AT_RISK_SQL = f"""{_RISK_SQL}, ar AS (SELECT r.vehicle_id, h.vin, r.failure_type, r.risk_score, r.lead_days, dp.depot_name, dp.depot_city
  FROM lr r JOIN home h ON h.vehicle_id = r.vehicle_id JOIN depots dp ON dp.depot_id = h.depot_id
  WHERE NOT EXISTS (SELECT 1 FROM bookings b WHERE b.vehicle_id = r.vehicle_id AND b.created_at > r.created_at))"""


def _latest(spark, sf_dir):
    return risk.latest_risk(d.predictions(spark, sf_dir), "prediction_id")


def _at_risk(spark, sf_dir):
    return risk.at_risk(_latest(spark, sf_dir), d.bookings(spark, sf_dir), d.vehicles(spark, sf_dir), d.depots(spark, sf_dir))


@query("latest_model", "O-WIN-6", sql=f"WITH {d.PREDICTIONS}, {_MODEL_SQL} SELECT * FROM lm")
def latest_model(spark, sf_dir):
    return risk.latest_model(d.predictions(spark, sf_dir))


@query("latest_risk", "O-WIN-4", sql=f"WITH {d.PREDICTIONS}, {_RISK_SQL} SELECT * FROM lr")
def latest_risk(spark, sf_dir):
    return _latest(spark, sf_dir)


@query("latest_prediction", "O-WIN-5", "O-JOIN-7", sql=f"WITH {d.PREDICTIONS}, {_LAST_SQL} SELECT * FROM lp")
def latest_prediction(spark, sf_dir):
    return risk.latest_prediction(d.predictions(spark, sf_dir), "prediction_id")


@query("at_risk", "O-MNT-5", "O-JOIN-4", "O-JOIN-5", "O-MNT-7",
       sql=f"WITH {_FLEET}, {_AT_RISK_SQL} SELECT *, printf('%.1f%%', risk_score * 100.0::DOUBLE) AS risk_percent FROM ar")
def at_risk(spark, sf_dir):
    return _at_risk(spark, sf_dir).withColumn("risk_percent", risk.risk_percent(F.col("risk_score")))


@query("at_risk_page", "O-TOP-1", "O-MNT-5",
       sql=f"WITH {_FLEET}, {_AT_RISK_SQL} SELECT * FROM ar WHERE (risk_score, vehicle_id) < (0.6, 1000000) ORDER BY risk_score DESC, vehicle_id DESC LIMIT 20")
def at_risk_page(spark, sf_dir):
    return risk.keyset_page(_at_risk(spark, sf_dir), 20, cursor=(0.6, 1000000))


@query("at_risk_cursor", "O-TOP-1",
       sql=f"""WITH {_FLEET}, {_AT_RISK_SQL}, pg AS (SELECT * FROM ar ORDER BY risk_score DESC, vehicle_id DESC LIMIT 5)
               SELECT risk_score, vehicle_id FROM pg WHERE (SELECT count(*) FROM pg) = 5 ORDER BY risk_score, vehicle_id LIMIT 1""")
def at_risk_cursor(spark, sf_dir):
    return risk.next_cursor(risk.keyset_page(_at_risk(spark, sf_dir), 5), 5)


@query("at_risk_offset", "O-TOP-3",
       sql=f"WITH {d.PREDICTIONS} SELECT prediction_id, vehicle_id, risk_score FROM predictions ORDER BY risk_score DESC, prediction_id LIMIT 20 OFFSET 40")
def at_risk_offset(spark, sf_dir):
    rows = d.predictions(spark, sf_dir).select("prediction_id", "vehicle_id", "risk_score")
    return risk.offset_page(rows, 20, 40, [F.col("risk_score").desc(), F.col("prediction_id")])


@query("risk_distribution", "O-AGG-5",
       sql=f"WITH {d.PREDICTIONS}, {_RISK_SQL} SELECT failure_type, count(*) AS at_risk_vehicles FROM lr WHERE risk_score >= 0.5 GROUP BY failure_type")
def risk_distribution(spark, sf_dir):
    return risk.risk_distribution(_latest(spark, sf_dir))


@query("risk_summary", "O-AGG-9",
       sql=f"""WITH {_FLEET}, {_AT_RISK_SQL}, t AS (SELECT failure_type, count(*) AS n FROM ar GROUP BY failure_type)
               SELECT (SELECT count(*) FROM ar) AS total, (SELECT count(*) FROM ar WHERE risk_score >= 0.7) AS critical,
                 (SELECT round(avg(lead_days), 8) FROM ar) AS avg_lead, (SELECT failure_type FROM t ORDER BY n DESC, failure_type LIMIT 1) AS top_type,
                 (SELECT max(n) FROM t) AS top_count""")
def risk_summary(spark, sf_dir):
    return risk.risk_summary(_at_risk(spark, sf_dir)).withColumn("avg_lead", F.round("avg_lead", 8))


@query("top_predictions", "O-TOP-5", "O-ML-17",
       sql=f"""WITH {d.PREDICTIONS}, {d.VEHICLES} SELECT p.prediction_id, v.vin, p.failure_type, p.risk_score FROM predictions p JOIN vehicles v USING (vehicle_id)
               WHERE p.risk_score >= 0.01 ORDER BY p.risk_score DESC, p.prediction_id LIMIT 5000""")
def top_predictions(spark, sf_dir):
    kept = d.predictions(spark, sf_dir).filter(F.col("risk_score") >= risk.MIN_SCORE)
    named = kept.join(d.vehicles(spark, sf_dir).select("vehicle_id", "vin"), "vehicle_id")
    rows = named.select("prediction_id", "vin", "failure_type", "risk_score")
    return risk.newest_rows(rows, 5000, [F.col("risk_score").desc(), F.col("prediction_id")])


# --- alerts (orders as alerts; closed once finished) ----------------------------------------------
ALERT = {
    "alert_id": "o_orderkey", "vehicle_id": "o_custkey", "failure_type": "o_orderpriority",
    "severity": "case when o_orderpriority < '2' then 'Critical' when o_orderpriority < '3' then 'HIGH' else 'low' end",
    "opened_at": "o_orderdate", "closed_at": "case when o_orderstatus = 'F' then o_orderdate + interval '1' day end",
}
_ALERTS = d._cte("alerts", ALERT, "orders")


def _alerts(spark, sf_dir):
    return d.table(spark, sf_dir, "orders").selectExpr(*d._select(ALERT))


@query("open_alerts", "O-FLT-8", "O-TOP-4",
       sql=f"""WITH {_ALERTS}, {d.VEHICLES} SELECT a.*, v.vin FROM alerts a JOIN vehicles v USING (vehicle_id) WHERE closed_at IS NULL
               ORDER BY opened_at DESC, alert_id DESC LIMIT 50""")
def open_alerts(spark, sf_dir):
    rows = risk.alerts(_alerts(spark, sf_dir), d.vehicles(spark, sf_dir), open_only=True)
    return risk.newest_rows(rows, 50, [F.col("opened_at").desc(), F.col("alert_id").desc()])


@query("alert_summary", "O-AGG-10",
       sql=f"""WITH {_ALERTS} SELECT count(*) AS total, count(*) FILTER (lower(severity) = 'critical') AS critical,
               count(*) FILTER (lower(severity) = 'high') AS high, arg_max(alert_id, (opened_at, alert_id)) AS newest FROM alerts""")
def alert_summary(spark, sf_dir):
    return risk.alert_summary(_alerts(spark, sf_dir), "alert_id")


@query("alerts_per_day", "O-AGG-6",
       sql=f"""WITH {_ALERTS} SELECT CAST(opened_at AS DATE) AS day, count(*) AS alerts_opened FROM alerts
               WHERE opened_at >= {BOARD_SQL} - INTERVAL 300 DAY GROUP BY ALL""")
def alerts_per_day(spark, sf_dir):
    return risk.alerts_per_day(_alerts(spark, sf_dir), board_now(), days=300)


# --- work orders and bookings ---------------------------------------------------------------------
@query("time_to_approval", "O-AGG-7",
       sql=f"WITH {d.WORK_ORDERS} SELECT round(avg(date_diff('second', created_at, approved_at)) / 3600, 1) AS avg_hours_to_approve FROM work_orders WHERE approved_at IS NOT NULL")
def time_to_approval(spark, sf_dir):
    return risk.hours_to_approval(d.work_orders(spark, sf_dir))


@query("depot_occupancy", "O-JOIN-8",
       sql=f"""WITH {d.DEPOTS}, {d.BOOKINGS}, a AS (SELECT depot_id, count(*) AS n FROM bookings WHERE booked_until > {BOARD_SQL} - INTERVAL 30 DAY GROUP BY depot_id)
               SELECT dp.*, coalesce(n, 0) AS active_bookings, bays - coalesce(n, 0) AS free_bays FROM depots dp LEFT JOIN a USING (depot_id)""")
def depot_occupancy(spark, sf_dir):
    return board.depot_occupancy(d.depots(spark, sf_dir), d.bookings(spark, sf_dir), board_now() - F.expr("INTERVAL 30 DAYS"))


@query("open_booking_vehicles", "O-JOIN-9", "O-JOIN-11",
       sql=f"WITH {d.WORK_ORDERS}, {d.BOOKINGS} SELECT DISTINCT b.vehicle_id FROM bookings b JOIN work_orders w USING (work_order_id) WHERE w.status IN ('approved', 'in_service')")
def open_booking_vehicles(spark, sf_dir):
    return board.open_booking_vehicles(d.bookings(spark, sf_dir), d.work_orders(spark, sf_dir))


def _board(spark, sf_dir):
    return (
        d.work_orders(spark, sf_dir), d.bookings(spark, sf_dir), d.vehicles(spark, sf_dir), d.depots(spark, sf_dir),
        risk.latest_prediction(d.predictions(spark, sf_dir), "prediction_id"),
    )


@query("board_pending", "O-MNT-4",
       sql=f"""WITH {_FLEET}, {_LAST_SQL} SELECT w.work_order_id, w.vehicle_id, v.vin, w.proposed_by, w.created_at, lp.failure_type, lp.risk_score, lp.lead_days
               FROM work_orders w JOIN vehicles v ON v.vehicle_id = w.vehicle_id LEFT JOIN lp ON lp.vehicle_id = w.vehicle_id
               WHERE w.status = 'proposed' ORDER BY w.created_at, w.work_order_id LIMIT 200""")
def board_pending(spark, sf_dir):
    orders, _, vehicles, _, latest = _board(spark, sf_dir)
    return risk.newest_rows(board.pending(orders, vehicles, latest), 200, [F.col("created_at"), F.col("work_order_id")])


def _scheduled_sql(status):
    return f"""WITH {_FLEET}, {_LAST_SQL} SELECT b.booking_id, b.work_order_id, b.vehicle_id, v.vin, w.status, lp.failure_type, lp.risk_score, lp.lead_days,
       dp.depot_name, dp.depot_city, b.booked_from, b.booked_until, w.started_at, coalesce(w.started_at, b.booked_from) AS shown_at
       FROM bookings b JOIN work_orders w ON w.work_order_id = b.work_order_id AND w.status = '{status}' JOIN vehicles v ON v.vehicle_id = b.vehicle_id
       JOIN depots dp ON dp.depot_id = b.depot_id LEFT JOIN lp ON lp.vehicle_id = b.vehicle_id"""


@query("board_scheduled", "O-MNT-4", sql=_scheduled_sql("approved"))
def board_scheduled(spark, sf_dir):
    orders, bookings, vehicles, depots, latest = _board(spark, sf_dir)
    return board.scheduled(bookings, orders, vehicles, depots, latest)


@query("board_in_service", "O-MNT-4", sql=_scheduled_sql("in_service"))
def board_in_service(spark, sf_dir):
    orders, bookings, vehicles, depots, latest = _board(spark, sf_dir)
    return board.scheduled(bookings, orders, vehicles, depots, latest, ("in_service",))


@query("board_closed", "O-MNT-4",
       sql=f"""WITH {_FLEET}, {_LAST_SQL} SELECT w.work_order_id, w.vehicle_id, v.vin, w.status, coalesce(w.completed_at, w.rejected_at) AS closed_at, lp.failure_type, dp.depot_city
               FROM work_orders w JOIN vehicles v ON v.vehicle_id = w.vehicle_id LEFT JOIN bookings b ON b.work_order_id = w.work_order_id
               LEFT JOIN depots dp ON dp.depot_id = b.depot_id LEFT JOIN lp ON lp.vehicle_id = w.vehicle_id
               WHERE w.status IN ('completed', 'rejected') AND coalesce(w.completed_at, w.rejected_at) > {BOARD_SQL} - INTERVAL 300 DAY""")
def board_closed(spark, sf_dir):
    orders, bookings, vehicles, depots, latest = _board(spark, sf_dir)
    return board.recently_closed(orders, bookings, vehicles, depots, latest, board_now(), days=300)


@query("board_counts", "O-AGG-11", sql=f"WITH {d.WORK_ORDERS} SELECT status, count(*) AS orders FROM work_orders GROUP BY status")
def board_counts(spark, sf_dir):
    return board.board_counts(d.work_orders(spark, sf_dir))


# lines of an order as the action log of a work order
_ACTION = {
    "work_order_id": "l_orderkey",
    "action": "case l_linenumber % 4 when 0 then 'reject' when 1 then 'approve' when 2 then 'start' else 'complete' end",
    "acted_at": "l_shipdate",
    "event_id": "cast(l_linenumber as bigint) * 1000000000 + l_partkey * 1000 + cast(l_quantity as bigint)",
}
_LOG_SQL = d._cte("log", _ACTION, "lineitem")


@query("work_order_state", "O-MNT-1",
       sql=f"""WITH RECURSIVE {_LOG_SQL}, n AS (SELECT work_order_id, action, acted_at, row_number() OVER (PARTITION BY work_order_id ORDER BY acted_at, event_id) AS i FROM log),
         s AS (SELECT DISTINCT work_order_id, 0 AS i, 'proposed' AS status, NULL::TIMESTAMP AS approved_at, NULL::TIMESTAMP AS rejected_at, NULL::TIMESTAMP AS started_at, NULL::TIMESTAMP AS completed_at FROM log
           UNION ALL SELECT s.work_order_id, s.i + 1,
             CASE WHEN action = 'approve' AND status = 'proposed' THEN 'approved' WHEN action = 'reject' AND status = 'proposed' THEN 'rejected'
                  WHEN action = 'start' AND status = 'approved' THEN 'in_service' WHEN action = 'complete' AND status IN ('approved', 'in_service') THEN 'completed' ELSE status END,
             CASE WHEN action = 'approve' AND status = 'proposed' THEN acted_at ELSE approved_at END,
             CASE WHEN action = 'reject' AND status = 'proposed' THEN acted_at ELSE rejected_at END,
             CASE WHEN action = 'start' AND status = 'approved' THEN acted_at ELSE started_at END,
             CASE WHEN action = 'complete' AND status IN ('approved', 'in_service') THEN acted_at ELSE completed_at END
           FROM s JOIN n ON n.work_order_id = s.work_order_id AND n.i = s.i + 1)
       SELECT work_order_id, arg_max(status, i) AS status, max(approved_at) AS approved_at, max(rejected_at) AS rejected_at, max(started_at) AS started_at, max(completed_at) AS completed_at
       FROM s GROUP BY work_order_id""")
def work_order_state(spark, sf_dir):
    return board.work_order_states(d.table(spark, sf_dir, "lineitem").selectExpr(*d._select(_ACTION)), at="acted_at")


@query("bays_released", "O-MNT-2", "O-MNT-3",
       sql=f"""WITH {d.WORK_ORDERS}, {d.BOOKINGS} SELECT b.booking_id, least(b.created_at + INTERVAL 72 HOUR, w.completed_at) AS booked_until
               FROM bookings b LEFT JOIN work_orders w USING (work_order_id)""")
def bays_released(spark, sf_dir):
    taken = d.bookings(spark, sf_dir).withColumn("booked_until", board.booked_until(F.col("created_at"), 72))
    return board.release_bays(taken, d.work_orders(spark, sf_dir)).select("booking_id", "booked_until")


@query("vehicle_health", "O-MNT-6",
       sql=f"""WITH {d.SIG}, {_FLEET}, {_ALERTS}, op AS (SELECT vehicle_id, count(*) AS n, max(opened_at) AS last_opened_at, string_agg(DISTINCT failure_type, ',' ORDER BY failure_type) AS open_types
                 FROM alerts WHERE closed_at IS NULL GROUP BY vehicle_id), tw AS (SELECT vin, max(event_time) AS updated_at FROM sig GROUP BY vin)
               SELECT h.vehicle_id, h.vin, n_name AS model, dp.depot_name, coalesce(op.n, 0) AS open_alerts, op.last_opened_at, op.open_types, tw.updated_at
               FROM home h JOIN nation ON n_nationkey = h.model_id JOIN depots dp ON dp.depot_id = h.depot_id
               LEFT JOIN op ON op.vehicle_id = h.vehicle_id LEFT JOIN tw ON tw.vin = h.vin""")
def vehicle_health(spark, sf_dir):
    models = d.table(spark, sf_dir, "nation").selectExpr("n_nationkey as model_id", "n_name as model")
    state = d.signals(spark, sf_dir).groupBy("vin").agg(F.max("event_time").alias("updated_at"))
    view = board.vehicle_health(d.vehicles(spark, sf_dir), models, d.depots(spark, sf_dir), _alerts(spark, sf_dir), state)
    return view.select(
        "vehicle_id", "vin", "model", "depot_name", "open_alerts", "last_opened_at",
        F.array_join("open_types", ",").alias("open_types"), "updated_at",
    )
