"""Telemetry-shaped frames derived by Spark from the given tables.

Every derived column is one SQL expression that Spark and DuckDB read the same way, so the
equality checks share the definition of their *input* and nothing else. Signals hold whole
numbers or binary fractions, which makes sums and means independent of summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.schemas import FAILURE_TYPES

NOW = "2024-01-31 00:00:00"
BOARD_NOW = "2001-12-31 00:00:00"

_C = "cast(round(value * 100) as bigint)"
_K = "cast(regexp_extract(props, '[0-9]+', 0) as bigint)"

SIGNAL = {
    "seq": "event_id",
    "vin": "concat('V', lpad(cast(user_id as string), 16, '0'))",
    "vehicle_id": "user_id",
    "tenant": "concat('t', cast(user_id % 3 as string))",
    "event_time": "ts",
    "msg_type": "case when event_type in ('view', 'click') then 'FAST' when event_type = 'purchase' then 'HEALTH' else 'EVENT' end",
    "kind": "event_type",
    "c": _C,
    "k": _K,
    "arrival": f"event_id + 10 * ({_K} % 5)",
}
# one row per event on top of SIGNAL
FAST = {
    "lat": "cast((c * 7919) % 18000 as double) / 1e2 - 90",
    "lon": "cast((c * 104729) % 36000 as double) / 1e2 - 180",
    "heading": "cast((c * 23) % 360 as double)",
    "gps_hdop": "cast(c % 5 as double)",
    "speed_kmh": "cast((c * 19) % 110 as double)",
    "odo_km": "cast(seq as double)",
    "accel_long_g": "cast(c % 3 as double)",
    "accel_lat_g": "cast(c % 2 as double)",
    "ambient_c": "cast(c % 45 - 5 as double)",
    "rpm": "cast((c * 13) % 2500 as double)",
    "load_pct": "cast((c * 3) % 101 as double)",
    "coolant_c": "cast(70 + c % 50 as double)",
    "oil_kpa": "cast(40 + (c * 7) % 400 as double)",
    "trans_c": "cast(80 + (c * 11) % 60 as double)",
    "fuel_rate_lph": "cast((c * 17) % 40 as double)",
}
HEALTH = {
    "charge_v": "cast(46 + c % 13 as double) / 4",
    "batt_12v_rest_v": "cast(88 + c % 17 as double) / 8",
    "cell_v_delta_mv": "cast((c * 3) % 250 as double)",
    "cell_temp_max_c": "cast(40 + (c * 5) % 25 as double)",
    "soh_pct": "cast(80 + c % 21 as double)",
    "kpa_1": "cast(500 + (c * 29) % 320 as double)",
    "kpa_2": "cast(500 + (c * 31) % 320 as double)",
    "kpa_3": "cast(500 + (c * 37) % 320 as double)",
    "tyre_c_1": "cast(25 + (c * 7) % 40 as double)",
    "tyre_c_2": "cast(25 + (c * 11) % 40 as double)",
    "pad_1": "cast((c * 41) % 101 as double)",
    "pad_2": "cast((c * 43) % 101 as double)",
    "n_dtc": "k % 3",
    "dtc_1": "concat('P030', cast(k % 10 as string))",
}
EVENT = {
    "event_name": "case when kind = 'error' then 'DTC_SET' else 'IGNITION_ON' end",
    "event_dtc": "case when kind = 'error' then concat('P0', cast(300 + k % 12 as string)) end",
}
_FAST_ONLY, _HEALTH_ONLY, _EVENT_ONLY = (f"msg_type = '{t}'" for t in ("FAST", "HEALTH", "EVENT"))


def _select(columns: dict[str, str], guard: str | None = None) -> list[str]:
    return [f"case when {guard} then {e} end as {n}" if guard else f"{e} as {n}" for n, e in columns.items()]


_PAYLOAD_SQL = ", ".join(_select(FAST, _FAST_ONLY) + _select(HEALTH, _HEALTH_ONLY) + _select(EVENT, _EVENT_ONLY))

# DuckDB side: sig = envelope columns, tel = envelope + payload columns
SIG = "sig AS (SELECT " + ", ".join(_select(SIGNAL)) + " FROM events)"
TEL = SIG + f", tel AS (SELECT *, {_PAYLOAD_SQL} FROM sig)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when a table comes in fewer splits than cores (one small test file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def signals_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(*_select(SIGNAL))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals_of(table(spark, sf_dir, "events"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_of(table(spark, sf_dir, "events"))


def telemetry_of(events: DataFrame) -> DataFrame:
    """Flat telemetry rows with the arrays of HEALTH messages, from a table or a stream."""
    flat = signals_of(events).selectExpr("*", *_select(FAST, _FAST_ONLY), *_select(HEALTH, _HEALTH_ONLY), *_select(EVENT, _EVENT_ONLY))
    healthy = F.col("msg_type") == "HEALTH"
    codes = (
        F.when(F.col("n_dtc") == 0, F.array().cast("array<string>"))
        .when(F.col("n_dtc") == 1, F.array("dtc_1"))
        .otherwise(F.array(F.lit("P0A80"), F.col("dtc_1")))
    )
    return flat.withColumns(
        {
            "tire_kpa": F.when(healthy, F.array("kpa_1", "kpa_2", "kpa_3")),
            "tire_c": F.when(healthy, F.array("tyre_c_1", "tyre_c_2")),
            "brake_pad_pct": F.when(healthy, F.array("pad_1", "pad_2")),
            "mil_on": F.when(healthy, F.col("k") % 2 == 0),
            "active_dtc": F.when(healthy, codes),
            "event_type": F.col("event_name"),
            "dtc": F.col("event_dtc"),
            "ts": F.col("event_time"),
        }
    ).drop("kpa_1", "kpa_2", "kpa_3", "tyre_c_1", "tyre_c_2", "pad_1", "pad_2", "n_dtc", "dtc_1", "event_name", "event_dtc")


def with_copies(rows: DataFrame) -> DataFrame:
    """The whole table plus a later copy of every click."""
    copies = rows.filter("kind = 'click'").withColumn("arrival", F.col("arrival") + 1000)
    return rows.unionByName(copies)


def with_copies_of(rows: DataFrame) -> DataFrame:
    """The same in one pass, for streams: clicks are exploded into two rows."""
    times = F.when(F.col("kind") == "click", F.array(F.lit(0), F.lit(1000))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_later", F.explode(times)).withColumn("arrival", F.col("arrival") + F.col("_later")).drop("_later")


COPIES = "dup AS (SELECT * FROM sig UNION ALL BY NAME SELECT * REPLACE (arrival + 1000 AS arrival) FROM sig WHERE kind = 'click')"

# --- fleet, depots, predictions, bookings, work orders --------------------------------------
VEHICLE = {
    "vehicle_id": "c_custkey",
    "vin": "concat('V', lpad(cast(c_custkey as string), 16, '0'))",
    "tenant": "concat('t', cast(c_custkey % 3 as string))",
    "model_id": "c_nationkey",
    "status": "c_mktsegment",
    "lat": "cast((c_custkey * 7919) % 18000 as double) / 1e2 - 90",
    "lon": "cast((c_custkey * 104729) % 36000 as double) / 1e2 - 180",
}
DEPOT = {
    "depot_id": "s_suppkey",
    "depot_name": "s_name",
    "depot_city": "concat('city-', cast(s_nationkey as string))",
    "lat": "cast((s_suppkey * 7919) % 18000 as double) / 1e2 - 90",
    "lon": "cast((s_suppkey * 104729) % 36000 as double) / 1e2 - 180",
    "bays": "1 + s_suppkey % 4",
}
PREDICTION = {
    "prediction_id": "o_orderkey",
    "vehicle_id": "o_custkey",
    "tenant_id": "o_custkey % 3",
    "failure_type": "o_orderpriority",
    "risk_score": "cast((o_orderkey * 37) % 100000 as double) / 1e5",
    "lead_days": "cast((o_orderkey * 13) % 400 as double) / 8",
    "model_version": "concat('m', cast(year(o_orderdate) as string))",
    "created_at": "o_orderdate",
}
WORK_ORDER = {
    "work_order_id": "o_orderkey",
    "vehicle_id": "o_custkey",
    "proposed_by": "o_orderpriority",
    "status": "case when o_orderstatus = 'P' then 'proposed' when o_orderstatus = 'F' then 'completed' "
              "when o_orderkey % 3 = 0 then 'in_service' when o_orderkey % 3 = 1 then 'rejected' else 'approved' end",
    "created_at": "o_orderdate",
    "approved_at": "case when o_orderstatus <> 'P' then o_orderdate + interval '30' hour end",
    "started_at": "case when o_orderstatus = 'O' and o_orderkey % 3 = 0 then o_orderdate + interval '2' day end",
    "completed_at": "case when o_orderstatus = 'F' then o_orderdate + interval '7' day end",
    "rejected_at": "case when o_orderstatus = 'O' and o_orderkey % 3 = 1 then o_orderdate + interval '1' day end",
}
# one booking per work order that is not just proposed
BOOKING = {
    "booking_id": "o_orderkey",
    "work_order_id": "o_orderkey",
    "vehicle_id": "o_custkey",
    "depot_id": "(o_orderkey * 31) % 10",
    "created_at": "o_orderdate + interval '5' day",
    "booked_from": "o_orderdate + interval '5' day",
    "booked_until": "o_orderdate + interval '124' hour",
}


def _cte(name: str, columns: dict[str, str], source: str, where: str = "true") -> str:
    return f"{name} AS (SELECT {', '.join(_select(columns))} FROM {source} WHERE {where})"


VEHICLES = _cte("vehicles", VEHICLE, "customer")
DEPOTS = _cte("depots", DEPOT, "supplier")
PREDICTIONS = _cte("predictions", PREDICTION, "orders")
WORK_ORDERS = _cte("work_orders", WORK_ORDER, "orders")
BOOKINGS = _cte("bookings", BOOKING, "orders", "o_orderstatus <> 'P'")


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles with a home depot by nation."""
    rows = table(spark, sf_dir, "customer").selectExpr(*_select(VEHICLE))
    return rows.withColumn("depot_id", (F.col("model_id") % 10).cast("bigint"))


def depots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*_select(DEPOT))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_select(PREDICTION))


def work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_select(WORK_ORDER))


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").selectExpr(*_select(BOOKING))


# --- labels: a vehicle fails at its last error whose k is in the list -------------------------
FAILING = "kind = 'error' and k % 6 = 0"
LABELS = f"""labels_v AS (
  SELECT vin, max(event_time) AS failure_at,
         ({FAILURE_TYPES!r})[max(c) % {len(FAILURE_TYPES)} + 1] AS failure_type
  FROM sig WHERE {FAILING} GROUP BY vin),
labels_all AS (
  SELECT v.vin, CASE v.n % 3 WHEN 0 THEN 'ICE' WHEN 1 THEN 'EV' ELSE 'HYBRID' END AS vehicle_type, l.failure_type, l.failure_at
  FROM (SELECT vin, max(vehicle_id) AS n FROM sig GROUP BY vin) v LEFT JOIN labels_v l ON l.vin = v.vin)"""


def failure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vehicle; ``failure_at`` and ``failure_type`` are NULL for healthy ones."""
    rows = signals(spark, sf_dir)
    failing = F.expr(FAILING)
    kind = F.max(F.when(failing, F.col("c"))) % len(FAILURE_TYPES)
    number = F.max("vehicle_id") % 3
    return rows.groupBy("vin").agg(
        F.when(number == 0, "ICE").when(number == 1, "EV").otherwise("HYBRID").alias("vehicle_type"),
        F.get(F.lit(FAILURE_TYPES), kind.cast("int")).alias("failure_type"),
        F.max(F.when(failing, F.col("event_time"))).alias("failure_at"),
    ).withColumns({"onset_at": F.lit(None).cast("timestamp_ntz"), "tenant": F.lit(None).cast("string")})
