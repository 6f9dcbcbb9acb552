"""Nearest depot and bulk booking against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from convoy.operators import routing, scan


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(h, 1.0)))


def fleet(seed, vehicles=120, depots=40, clustered=True):
    rng = random.Random(seed)

    def place(i, share):
        if clustered and i % share == 0:
            return (12.9 + rng.random() / 50, 77.6 + rng.random() / 50)
        return (rng.uniform(-90, 90), rng.uniform(-180, 180))

    return [(i, *place(i, 2)) for i in range(vehicles)], [(i, *place(i, 3), rng.choice([0, 1, 2, 3])) for i in range(depots)]


def frames(spark, cars, depots):
    return (
        spark.createDataFrame(cars, "vehicle_id long, lat double, lon double"),
        spark.createDataFrame(depots, "depot_id long, lat double, lon double, free_bays long"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_free_depot(spark, seed):
    cars, depots = fleet(seed)
    found = routing.nearest_depot(*frames(spark, cars, depots)).collect()
    expected = {}
    for car, lat, lon in cars:
        expected[car] = min((d for d in depots if d[3] > 0), key=lambda d: (km((lat, lon), d[1:3]), d[0]))[0]
    assert {r.vehicle_id: r.depot_id for r in found} == expected


def test_ties_and_full_depots(spark):
    cars = [(1, 10.0, 10.0), (2, -89.9, 179.9), (3, 89.9, -179.9)]
    depots = [(5, 10.0, 10.0, 0), (9, 10.0, 11.0, 1), (7, 10.0, 11.0, 1), (8, -89.9, -179.9, 1), (6, 89.9, 179.9, 1)]
    found = routing.nearest_depot(*frames(spark, cars, depots)).collect()
    assert {r.vehicle_id: r.depot_id for r in found} == {1: 7, 2: 8, 3: 6}
    none = routing.nearest_depot(*frames(spark, cars, [(d[0], d[1], d[2], 0) for d in depots]))
    assert none.collect() == []


@pytest.mark.parametrize("seed", [4, 5])
def test_booking_equals_one_by_one(spark, seed):
    cars, depots = fleet(seed, vehicles=60, depots=9)
    left = {d[0]: d[3] for d in depots}
    expected = {}
    for car, lat, lon in sorted(cars):
        open_depots = [d for d in depots if left[d[0]] > 0]
        if open_depots:
            best = min(open_depots, key=lambda d: (km((lat, lon), d[1:3]), d[0]))[0]
            left[best] -= 1
            expected[car] = best
    chunk = scan.number_chunk(F.col("vehicle_id"), 7)
    booked = routing.assign_bays(*frames(spark, cars, depots), "vehicle_id", chunk)
    assert {r.vehicle_id: r.depot_id for r in booked.collect()} == expected


def test_exact_ties_at_any_number_of_depots(spark):
    cars = [(i, 10 + i / 100, 20 + i / 7) for i in range(200)]
    pairs = [d for i, lat, lon in cars for d in ((2 * i, lat, lon + 0.001, 1), (2 * i + 1, lat, lon - 0.001, 1))]
    far = [(1000 + i, -80 + i / 1000, i / 200, 1) for i in range(20_000)]
    for depots in (pairs, pairs + far):
        found = routing.nearest_depot(*frames(spark, cars, depots)).collect()
        assert {r.vehicle_id: r.depot_id for r in found} == {i: 2 * i for i, _, _ in cars}


def test_plan_grows_in_line_with_the_levels(spark):
    cars, sites = frames(spark, [(1, 1.0, 1.0)], [(1, 1.0, 1.0, 1)])
    sites = sites.withColumn("cutoff", F.lit(2**63 - 1))

    def reads(n):
        plan = routing._nearest(cars, sites, n, "vehicle_id", None)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("LogicalRDD") + plan.count("LocalRelation")

    counts = [reads(800 * 9**k) for k in range(4)]
    assert len({b - a for a, b in zip(counts, counts[1:])}) == 1


def test_live_position_beats_home(spark):
    cars = spark.createDataFrame([("a", 1), ("b", 1)], "vin string, depot_id long")
    twin = spark.createDataFrame([("a", 5.0, 6.0)], "vin string, lat double, lon double")
    home = spark.createDataFrame([(1, 1.0, 2.0)], "depot_id long, lat double, lon double")
    rows = {r.vin: (r.lat, r.lon) for r in routing.live_position(cars, twin, home).collect()}
    assert rows == {"a": (5.0, 6.0), "b": (1.0, 2.0)}


def one_by_one(cars, depots):
    left, expected = {d[0]: d[3] for d in depots}, {}
    for car in sorted(cars):
        open_depots = [d for d in depots if left[d[0]] > 0]
        if open_depots:
            best = min(open_depots, key=lambda d: (round(km(car[1:], d[1:3]), 6), d[0]))[0]
            left[best] -= 1
            expected[car[0]] = best
    return expected


@pytest.mark.parametrize("per_region", [8192, 12, 3])
def test_booking_across_regions(spark, per_region):
    """Crowded places, equal distances and more requests than bays, with one region and with many."""
    cars, depots = fleet(6, vehicles=260, depots=90)
    depots = [*depots, *[(100 + i, *d[1:3], 1) for i, d in enumerate(depots[:20])], (500, None, 1.0, 3)]
    placed = [d for d in depots if d[1] is not None]
    booked = routing.assign_bays(*frames(spark, cars, depots), "vehicle_id", scan.number_chunk(F.col("vehicle_id"), 50), per_region=per_region)
    assert {r.vehicle_id: r.depot_id for r in booked.collect()} == one_by_one(cars, placed)


def test_booking_in_a_crowd_takes_few_rounds(spark):
    """All ask at one spot, so depots fill up by distance: a round per depot before."""
    cars = [(i, 10.0, 10.0) for i in range(120)]
    depots = [(i, 10.0 + i / 100, 10.0, 2) for i in range(60)]
    context = spark.sparkContext
    context.setJobGroup("crowd", "bulk booking")
    try:
        found = routing.assign_bays(*frames(spark, cars, depots), "vehicle_id", scan.number_chunk(F.col("vehicle_id"), 50)).collect()
    finally:
        context.setJobGroup("none", "")
    assert {r.vehicle_id: r.depot_id for r in found} == {i: i // 2 for i in range(120)}
    assert len(context.statusTracker().getJobIdsForGroup("crowd")) < 60
