"""Queries on message validation and codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoy.functions import codes
from convoy.functions.shard import md5_shard
from convoy.operators import quality
from convoy.operators.scan import once
from convoy.plans import derive as d
from convoy.plans.registry import query

SHARDS = 32
_BODY = "upper(substr(md5(cast({0} as string)), 1, 17))"


def raw_messages(spark, sf_dir):
    """Raw topic and JSON text per event, with one fault kind per value of ``k % 10``."""
    rows = d.telemetry_of(d.spread(d.table(spark, sf_dir, "events")))
    fault = F.col("k") % 10
    rows = once(rows, "_body", F.expr(_BODY.format("vehicle_id")))
    vin = codes.vin_repaired(F.col("_body"))
    fields = ["lat", "lon", "heading", "gps_hdop", "speed_kmh", "odo_km", "accel_long_g", "accel_lat_g", "ambient_c", "rpm",
              "coolant_c", "oil_kpa", "trans_c", "tire_kpa", "tire_c", "brake_pad_pct", "batt_12v_rest_v", "charge_v", "mil_on",
              "soh_pct", "event_type", "dtc"]
    health = F.col("msg_type") == "HEALTH"
    rows = once(rows.drop("vin"), "vin", vin).withColumns(
        {
            "speed_kmh": F.when(fault == 4, F.lit(-5.0)).otherwise(F.col("speed_kmh")),
            "brake_pad_pct": F.when(health & (fault == 4), F.array(F.lit(120.0))).otherwise(F.col("brake_pad_pct")),
            "event_type": F.when((F.col("msg_type") == "EVENT") & (fault == 4), "UNKNOWN").when(F.col("msg_type") == "EVENT", F.col("event_type")),
        }
    )
    extra = [F.when(health, F.lit(v)).alias(n) for n, v in (("crank_min_v", 10.5), ("engine_hours", 100.0), ("idle_s", 60))]
    codes_array = F.when(health & (fault == 5), F.array(F.lit("P9999"))).when(health, F.array(F.lit("P0300"))).alias("active_dtc")
    body = F.to_json(
        F.struct(
            F.when(fault == 3, F.lit("1M8GDM9AXKP042788")).when(fault == 6, F.translate(F.col("vin"), "0123456789", "1234567890")).otherwise(F.col("vin")).alias("vin"),
            F.when(fault == 7, F.lit("OTHER")).otherwise(F.col("msg_type")).alias("msg_type"),
            "seq", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), F.lit("1.0").alias("fw_version"),
            F.lit("ignored").alias("unknown_key"), F.struct(*fields, *extra, codes_array).alias("payload"),
        )
    )
    shard = F.when(fault == 1, md5_shard(F.col("vin"), SHARDS) + 1).otherwise(md5_shard(F.col("vin"), SHARDS))
    topic = F.when(fault == 0, F.concat(F.lit("truck/"), "vin")).otherwise(
        F.concat(F.lit("fleet/"), "tenant", F.lit("/shard-"), shard.cast("string"), F.lit("/"), "vin", F.lit("/telemetry"))
    )
    value = F.when(fault.isin(1, 2), F.substring(body, 1, 40)).otherwise(body)
    return rows.select("seq", "k", "msg_type", topic.alias("topic"), value.alias("value"))


# fault 5 (bad active code) only breaks HEALTH; fault 6 changes the VIN in the body
_REASON_SQL = """CASE k % 10 WHEN 0 THEN 'bad_topic' WHEN 1 THEN 'shard_mismatch' WHEN 2 THEN 'bad_json' WHEN 3 THEN 'topic_vin_mismatch' WHEN 4 THEN 'schema_invalid'
   WHEN 5 THEN CASE WHEN msg_type = 'HEALTH' THEN 'schema_invalid' END WHEN 6 THEN 'topic_vin_mismatch' WHEN 7 THEN 'schema_invalid' END"""


@query("quarantine", "O-VAL-1", "O-VAL-2", "O-VAL-3", "O-VAL-4", "O-VAL-5", sql=f"WITH {d.SIG} SELECT seq, {_REASON_SQL} AS reason FROM sig")
def quarantine(spark, sf_dir):
    return quality.judge(raw_messages(spark, sf_dir), SHARDS).select("seq", "reason")


@query("quarantine_counts", "O-VAL-5",
       sql=f"WITH {d.SIG} SELECT coalesce({_REASON_SQL}, 'accepted') AS reason, count(*) AS messages FROM sig GROUP BY ALL")
def quarantine_counts(spark, sf_dir):
    return quality.reason_counts(quality.judge(raw_messages(spark, sf_dir), SHARDS))


@query("accepted_messages", "O-FLT-1",
       sql=f"""WITH {d.TEL} SELECT seq, tenant, msg_type, speed_kmh, coolant_c, charge_v, date_trunc('millisecond', event_time) AS event_time FROM tel WHERE {_REASON_SQL} IS NULL""")
def accepted_messages(spark, sf_dir):
    flat = quality.flatten(quality.accepted(quality.judge(raw_messages(spark, sf_dir), SHARDS)))
    return flat.select("seq", "tenant", "msg_type", "speed_kmh", "coolant_c", "charge_v", F.col("event_time").cast("timestamp_ntz").alias("event_time"))


_VIN_SQL = """v AS (SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'O' || substr(b, 2) ELSE b END AS vin
   FROM (SELECT c_custkey, c_nationkey, upper(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 17)) AS b FROM customer)),
 t AS (SELECT *, regexp_full_match(vin, '[0-9A-HJ-NPR-Z]{17}') AS shaped, translate(vin, 'ABCDEFGHJKLMNPRSTUVWXYZ', '12345678123457923456789') AS n FROM v),
 s AS (SELECT *, CASE WHEN shaped THEN list_sum(list_transform(range(1, 18), lambda i: [8,7,6,5,4,3,2,10,0,9,8,7,6,5,4,3,2][i] * CAST(substr(n, i, 1) AS INTEGER))) % 11 END AS r FROM t),
 e AS (SELECT *, CASE WHEN r = 10 THEN 'X' ELSE CAST(CAST(r AS INTEGER) AS VARCHAR) END AS digit FROM s)"""


@query("vin_check", "O-VAL-6", sql=f"""WITH {_VIN_SQL} SELECT vin, digit, coalesce(substr(vin, 9, 1) = digit, false) AS valid,
       substr(vin, 1, 8) || digit || substr(vin, 10) AS repaired FROM e""")
def vin_check(spark, sf_dir):
    body = F.expr(_BODY.format("c_custkey"))
    vin = F.when(F.col("c_nationkey") == 3, F.concat(F.lit("O"), F.substring(body, 2, 16))).otherwise(body)
    rows = d.table(spark, sf_dir, "customer").select(vin.alias("vin"))
    return rows.select(
        "vin", codes.vin_check_digit(F.col("vin")).alias("digit"), codes.vin_valid(F.col("vin")).alias("valid"),
        codes.vin_repaired(F.col("vin")).alias("repaired"),
    )


_CODE = "concat(substr('PCBUZ', cast(1 + k % 5 as int), 1), cast(c % 5 as string), '0', cast(k % 10 as string), case when c % 7 = 0 then 'a' else 'A' end)"


@query("dtc_parse", "O-VAL-7", "O-VAL-8", "O-VAL-9",
       sql=f"""WITH {d.SIG}, x AS (SELECT seq, {_CODE} AS code FROM sig), y AS (SELECT *, regexp_full_match(code, '[PCBU][0-3][0-9A-F]{{3}}') AS valid FROM x)
       SELECT seq, code, valid, CASE WHEN valid THEN code[1] END AS "system", CASE WHEN valid THEN CASE WHEN code[2] IN ('0', '2') THEN 'generic' ELSE 'manufacturer' END END AS origin,
         CASE WHEN valid THEN substr(code, 3, 3) END AS specific, CASE WHEN valid THEN code[1] = 'P' AND substr(code, 3, 3) BETWEEN '02A' AND '06A' END AS in_range FROM y""")
def dtc_parse(spark, sf_dir):
    rows = d.signals(spark, sf_dir).selectExpr("seq", f"{_CODE} as code")
    code = F.col("code")
    return rows.select(
        "seq", "code", codes.dtc_valid(code).alias("valid"), codes.dtc_system(code).alias("system"),
        codes.dtc_origin(code).alias("origin"), codes.dtc_specific(code).alias("specific"),
        codes.dtc_between(code, "P002A", "P006A").alias("in_range"),
    )
