"""Declared schemas and the fixed values of the telemetry model."""

from __future__ import annotations

# Message kinds, event kinds and roles.
MSG_TYPES = ["FAST", "HEALTH", "EVENT"]
EVENT_TYPES = [
    "DTC_SET", "DTC_CLEARED", "HARSH_BRAKE", "HARSH_ACCEL", "HARSH_CORNER",
    "IGNITION_ON", "IGNITION_OFF", "CHARGE_START", "CHARGE_END", "OVERSPEED",
]
EXACT_LOCATION_ROLES = ["fleet_admin", "fleet_manager"]
MISFIRE_CODES = [f"P030{n}" for n in range(9)]
FAILURE_TYPES = [
    "cooling", "lubrication", "battery", "misfire",
    "brake_wear", "tyre", "transmission", "ev_battery",
]
# Streaming rules and trained models name the 12 V failure differently.
RULE_TO_MODEL_TYPE = {"12v_battery": "battery"}

# Payload fields as (name, type).
FAST_REQUIRED = ["lat", "lon", "heading", "gps_hdop", "speed_kmh", "odo_km", "accel_long_g", "accel_lat_g", "ambient_c"]
FAST_FIELDS = [(n, "double") for n in FAST_REQUIRED] + [
    ("rpm", "double"), ("load_pct", "double"), ("throttle_pct", "double"), ("coolant_c", "double"),
    ("oil_c", "double"), ("oil_kpa", "double"), ("trans_c", "double"), ("gear", "int"),
    ("fuel_pct", "double"), ("fuel_rate_lph", "double"), ("soc_pct", "double"), ("hv_v", "double"), ("hv_a", "double"),
]
HEALTH_REQUIRED = [
    "tire_kpa", "tire_c", "brake_pad_pct", "batt_12v_rest_v", "crank_min_v", "charge_v",
    "engine_hours", "idle_s", "mil_on",
]
HEALTH_FIELDS = [
    ("tire_kpa", "array<double>"), ("tire_c", "array<double>"), ("brake_pad_pct", "array<double>"),
    ("batt_12v_rest_v", "double"), ("crank_min_v", "double"), ("charge_v", "double"),
    ("engine_hours", "double"), ("idle_s", "int"), ("mil_on", "boolean"), ("active_dtc", "array<string>"),
    ("cell_v_delta_mv", "double"), ("cell_temp_max_c", "double"), ("cell_temp_min_c", "double"), ("soh_pct", "double"),
]
EVENT_FIELDS = [
    ("event_type", "string"), ("dtc", "string"), ("freeze_frame", "map<string,double>"), ("value", "double"),
]
PAYLOAD_FIELDS = FAST_FIELDS + HEALTH_FIELDS + EVENT_FIELDS

# Inclusive bounds per field (None = open); heading is checked separately, it excludes 360.
BOUNDS = {
    "lat": (-90, 90), "lon": (-180, 180), "gps_hdop": (0, None), "speed_kmh": (0, None), "odo_km": (0, None),
    "rpm": (0, None), "load_pct": (0, 100), "throttle_pct": (0, 100), "oil_kpa": (0, None),
    "fuel_pct": (0, 100), "fuel_rate_lph": (0, None), "soc_pct": (0, 100),
    "engine_hours": (0, None), "idle_s": (0, None), "soh_pct": (0, 100),
}

PAYLOAD_DDL = "struct<" + ",".join(f"{n}:{t}" for n, t in PAYLOAD_FIELDS) + ">"
ENVELOPE_FIELDS = [
    ("vin", "string"), ("msg_type", "string"), ("seq", "bigint"), ("ts", "timestamp"),
    ("fw_version", "string"), ("schema_ver", "int"), ("driver_token", "string"), ("tenant", "string"),
]
# DDL text: accepted as is by readers, from_json and createDataFrame
MESSAGE_SCHEMA = ", ".join(f"{n} {t}" for n, t in ENVELOPE_FIELDS) + f", payload {PAYLOAD_DDL}"
ALERT_SCHEMA = (
    "vin string, tenant string, failure_type string, severity string, source string, "
    "dtc_codes array<string>, detected_at timestamp"
)
LABEL_SCHEMA = (
    "vin string, tenant string, vehicle_type string, failure_type string, onset_at string, failure_at string"
)
