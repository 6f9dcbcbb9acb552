"""Validation reasons on hand-made messages."""

import json

import pytest
from pyspark.sql import functions as F

from convoy.functions.shard import md5_shard
from convoy.operators import quality

VIN = "1M8GDM9AXKP042788"
FAST = dict(lat=12.9, lon=77.6, heading=0.0, gps_hdop=1.0, speed_kmh=50.0, odo_km=10.0, accel_long_g=0.0, accel_lat_g=0.0, ambient_c=30.0, rpm=1500, gear=4)
HEALTH = dict(tire_kpa=[800, 801.5], tire_c=[40.0], brake_pad_pct=[80.0, 0], batt_12v_rest_v=12.6, crank_min_v=10.1, charge_v=14.0,
              engine_hours=100.0, idle_s=60, mil_on=False, active_dtc=["P0300"])
EVENT = dict(event_type="DTC_SET", dtc="P0301", freeze_frame={"rpm": 900.0})


def message(kind="FAST", payload=None, **changes):
    body = dict(vin=VIN, msg_type=kind, seq=5, ts="2024-01-01T00:00:00.250Z", fw_version="1.0", schema_ver=1, driver_token=None)
    body["payload"] = {"FAST": FAST, "HEALTH": HEALTH, "EVENT": EVENT}[kind] if payload is None else payload
    body.update(changes)
    return {k: v for k, v in body.items() if v != "absent"}


def with_(base, **changes):
    return {k: v for k, v in {**base, **changes}.items() if v != "absent"}


@pytest.fixture(scope="module")
def topic(spark):
    shard = spark.range(1).select(md5_shard(F.lit(VIN), 32).alias("s")).first()["s"]
    return f"fleet/demo/shard-{shard}/{VIN}/telemetry"


def judge(spark, rows):
    return quality.judge(spark.createDataFrame(rows, "topic string, value string"), 32)


GOOD = [
    message(), message("HEALTH"), message("EVENT"),
    message(payload=with_(FAST, coolant_c=None)), message(payload=with_(FAST, extra="ignored"), other=1),
    message(schema_ver="absent"), message(ts="2024-01-01T05:30:00+05:30"), message(payload=with_(FAST, speed_kmh="50.5")),
    message("HEALTH", with_(HEALTH, active_dtc="absent")), message("EVENT", dict(event_type="IGNITION_ON")),
]
BAD = [
    message(payload=with_(FAST, speed_kmh=-5)), message(payload=with_(FAST, heading=360)), message(payload=with_(FAST, lat=90.1)),
    message(payload=with_(FAST, lat="absent")), message(payload=with_(FAST, load_pct=101)), message(payload=with_(FAST, gear=2.5)),
    message(payload=with_(FAST, rpm="fast")), message(seq=-1), message(seq="absent"), message(ts="2024-01-01T00:00:00"), message(ts="noon"),
    message(fw_version="absent"), message(msg_type="OTHER"), message(msg_type="absent"), message(payload=None, msg_type="HEALTH"),
    message("HEALTH", with_(HEALTH, brake_pad_pct=[80, 101])), message("HEALTH", with_(HEALTH, active_dtc=["X1"])),
    message("HEALTH", with_(HEALTH, mil_on="maybe")), message("HEALTH", with_(HEALTH, tire_kpa=5)),
    message("EVENT", dict(event_type="DTC_SET")), message("EVENT", dict(event_type="DTC_SET", dtc="p0300")), message("EVENT", dict(event_type="X")),
    message("EVENT", with_(EVENT, freeze_frame={"rpm": "high"})), message(payload="absent"),
]


def test_accepts(spark, topic):
    rows = judge(spark, [(topic, json.dumps(m)) for m in GOOD]).select("reason").collect()
    assert [r.reason for r in rows] == [None] * len(GOOD)


def test_rejects_schema(spark, topic):
    rows = judge(spark, [(topic, json.dumps(m)) for m in BAD]).select("value", "reason").collect()
    assert [r.value for r in rows if r.reason != "schema_invalid"] == []


def test_first_failing_check_wins(spark, topic):
    wrong_shard = topic.replace("shard-", "shard-9")
    bad_vin = "1M8GDM9AXKP042789"
    bad_vin_topic = spark.range(1).select(md5_shard(F.lit(bad_vin), 32).alias("s")).first()["s"]
    cases = [
        ("truck/x", "{", "bad_topic"), ("fleet/demo/shard-x/v/telemetry", "{", "bad_topic"), (topic + "\n", "{}", "bad_topic"),
        (None, "{}", "bad_topic"), (wrong_shard, "{", "shard_mismatch"), (topic, "{", "bad_json"), (topic, None, "bad_json"),
        (topic, "[1]", "bad_json"), (topic, "", "bad_json"), (topic, "{}", "topic_vin_mismatch"),
        (topic, json.dumps(message(vin=bad_vin)), "topic_vin_mismatch"),
        (f"fleet/demo/shard-{bad_vin_topic}/{bad_vin}/telemetry", json.dumps(message(vin=bad_vin)), "schema_invalid"),
    ]
    good = json.dumps(message())
    cases += [(topic, text, "bad_json") for text in (good + good, good + " xyz}", good + "}", good + ',"end":{}', "{'vin':'x'}", good[:-1] + ",}", "\ufeff" + good)]
    cases += [(topic, f" \n{good}\t", None)]
    rows = judge(spark, [c[:2] for c in cases]).select("reason").collect()
    assert [r.reason for r in rows] == [c[2] for c in cases]


def test_split_keeps_every_message(spark, topic):
    rows = [(topic, json.dumps(m)) for m in GOOD + BAD] + [("nowhere", "text")]
    judged = judge(spark, rows)
    assert quality.accepted(judged).count() == len(GOOD)
    letters = quality.quarantined(judged).collect()
    assert len(letters) == len(BAD) + 1
    assert {r.raw for r in letters} >= {"text"}
    counts = {r.reason: r.messages for r in quality.reason_counts(judged).collect()}
    assert counts == {"accepted": len(GOOD), "schema_invalid": len(BAD), "bad_topic": 1}


def test_accepted_is_typed(spark, topic):
    rows = quality.accepted(judge(spark, [(topic, json.dumps(m)) for m in GOOD])).collect()
    assert {r.tenant for r in rows} == {"demo"}
    assert rows[7].payload.speed_kmh == 50.5 and rows[0].payload.gear == 4
    assert rows[8].payload.active_dtc == [] and rows[0].payload.active_dtc is None
    assert rows[6].ts == rows[5].ts.replace(microsecond=0)
    assert rows[2].payload.freeze_frame == {"rpm": 900.0}
