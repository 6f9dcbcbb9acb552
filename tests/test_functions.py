"""Known values of the column expressions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from convoy.functions import arrays, codes, geo, text
from convoy.functions.shard import blake2b_shard


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("vin,valid", [
    ("1M8GDM9AXKP042788", True), ("1HGCM82633A004352", True), ("1M8GDM9AXKP042789", False), ("1M8GDM9AXKP04278", False),
    ("1M8GDM9AXKP0427888", False), ("IM8GDM9AXKP042788", False), ("1M8GDM9AOKP042788", False), ("", False), ("1m8gdm9axkp042788", False),
])
def test_vin(spark, vin, valid):
    assert one(spark, codes.vin_valid(F.col("v")), v=vin) is valid


def test_vin_repair(spark):
    assert one(spark, codes.vin_repaired(F.col("v")), v="1M8GDM9A0KP042788") == "1M8GDM9AXKP042788"
    assert one(spark, codes.vin_repaired(F.col("v")), v="short") is None


@pytest.mark.parametrize("code,valid", [
    ("P0128", True), ("P0A80", True), ("P0AFA", True), ("Z0128", False), ("P4128", False), ("P012", False), ("P01288", False),
    ("p0128", False), ("", False), ("P0128\n", False),
])
def test_dtc(spark, code, valid):
    assert one(spark, codes.dtc_valid(F.col("c")), c=code) is valid


def test_dtc_parts(spark):
    c = F.col("c")
    row = lambda code: one(spark, F.struct(codes.dtc_system(c), codes.dtc_origin(c), codes.dtc_specific(c)), c=code)
    assert tuple(row("P0128")) == ("P", "generic", "128")
    assert tuple(row("P1234")) == ("P", "manufacturer", "234")
    inside = lambda code: one(spark, codes.dtc_between(c, "P0300", "P0308"), c=code)
    assert [inside(x) for x in ("P0300", "P0308", "P0310", "C0300")] == [True, True, False, False]


def test_geohash(spark):
    assert one(spark, geo.geohash(F.col("a"), F.col("b"), 11), a=57.64911, b=10.40744) == "u4pruydqqvj"
    assert one(spark, geo.geohash(F.col("a"), F.col("b"), 5), a=90.0, b=180.0) == "zzzzz"
    assert one(spark, geo.geohash(F.col("a"), F.col("b"), 5), a=90.1, b=0.0) is None


def test_haversine(spark):
    km = one(spark, geo.haversine_km(F.lit(12.9716), F.lit(77.5946), F.lit(13.0827), F.lit(80.2707)))
    assert 280 < km < 300
    assert one(spark, geo.haversine_km(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0))) == 0


def test_mask_unknown_role_is_coarse(spark):
    place = lambda role: one(spark, geo.masked_location(F.lit(57.64911), F.lit(10.40744), F.col("r")), r=role)
    assert place("fleet_admin")["lat"] == 57.64911 and place("fleet_admin")["geohash"] is None
    assert place("guest")["lat"] is None and place("guest")["geohash"] == "u4pru"


def test_sibling_delta(spark):
    delta = lambda v: one(spark, arrays.sibling_delta(F.expr(v)))
    assert delta("array(800D, 800D, 800D, 500D)") == 300
    assert delta("array(800D)") is None
    assert delta("cast(null as array<double>)") is None


def test_guarded_ratio(spark):
    assert one(spark, arrays.guarded_ratio(F.lit(100.0), F.lit(5.0), 5)) is None
    assert one(spark, arrays.guarded_ratio(F.lit(100.0), F.lit(10.0), 5)) == 10


def test_blake2b_shard(spark):
    vin = "1M8GDM9AXKP042788"
    expected = int.from_bytes(hashlib.blake2b(vin.encode(), digest_size=8).digest(), "big") % 32
    assert one(spark, blake2b_shard(F.col("v"), 32), v=vin) == expected


def test_hashed_vector(spark):
    vector = one(spark, text.hashed_vector(F.col("t")), t="Oil pressure LOW, oil!")
    assert len(vector) == 384 and abs(sum(x * x for x in vector) - 1) < 1e-12
    number = int(hashlib.sha256(b"oil").hexdigest(), 16)
    expected = 2.0 if (number // 384) % 2 == 0 else -2.0
    plain = one(spark, text.hashed_vector(F.col("t"), False), t="Oil pressure LOW, oil!")
    assert plain[number % 384] == expected
    assert set(one(spark, text.hashed_vector(F.col("t")), t="!!!")) == {0.0}
