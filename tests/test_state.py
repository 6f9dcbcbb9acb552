"""Sequence guard, twin and recurrence against plain Python, with one vehicle holding most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from convoy.operators import dedup, pattern, scan, twin

START = dt.datetime(2024, 1, 1)


def messages(seed, n=600):
    """About two thirds of the rows belong to one vehicle; sequence numbers arrive out of order."""
    rng = random.Random(seed)
    rows = []
    for arrival in range(n):
        vin = "hot" if rng.random() < 0.66 else f"v{rng.randrange(5)}"
        kind = rng.choice(["FAST", "HEALTH"])
        a = rng.choice([None, float(rng.randrange(50))]) if kind == "FAST" else None
        b = rng.choice([None, float(rng.randrange(50))]) if kind == "HEALTH" else None
        rows.append((vin, "t1", kind, max(0, arrival + rng.randrange(-40, 5)), START + dt.timedelta(seconds=arrival), arrival, a, b))
    return rows


SCHEMA = "vin string, tenant string, msg_type string, seq long, event_time timestamp, arrival long, a double, b double"


def fold(rows):
    docs, kept = {}, []
    for row in sorted(rows, key=lambda r: (r[5], r[3])):
        vin, _, kind, seq, ts, arrival, a, b = row
        doc = docs.setdefault(vin, {})
        if kind in doc and seq <= doc[kind]:
            continue
        doc[kind], doc["at"] = seq, ts
        kept.append((vin, kind, seq, arrival))
        for name, value in (("a", a), ("b", b)):
            if value is not None:
                doc[name] = value
    return docs, sorted(kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_guard_and_twin_equal_sequential_fold(spark, seed):
    rows = messages(seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    docs, kept = fold(rows)
    chunk = scan.number_chunk(F.col("arrival"), 50)
    order = [F.col("arrival"), F.col("seq")]
    ours = dedup.drop_stale(frame, ["vin", "msg_type"], "seq", order, chunk)
    assert sorted((r.vin, r.msg_type, r.seq, r.arrival) for r in ours.collect()) == kept
    state = twin.fold_twin(frame, ["a", "b"], ["arrival", "seq"], chunk).collect()
    assert {r.vin: (r.a, r.b, r.updated_at, r.last_seq_fast, r.last_seq_health) for r in state} == {
        v: (d.get("a"), d.get("b"), d["at"], d.get("FAST"), d.get("HEALTH")) for v, d in docs.items()
    }


def test_first_arrival_is_final(spark):
    rows = [("v", 1, 5, "late"), ("v", 1, 2, "first"), ("v", 2, 3, "only")] + [("v", 7, i, "copy") for i in range(10, 300)]
    frame = spark.createDataFrame(rows, "vin string, seq int, arrival int, note string")
    kept = dedup.first_arrival(frame, ["vin", "seq"], [F.col("arrival")]).collect()
    assert sorted((r.seq, r.note, r.arrival) for r in kept) == [(1, "first", 2), (2, "only", 3), (7, "copy", 10)]
    plan = frame.transform(lambda f: dedup.first_arrival(f, ["vin", "seq"], [F.col("arrival")]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def pairs(rows, within, every):
    """Adjacent matches per vehicle in (time, seq) order."""
    out = []
    by_vin = {}
    for r in rows:
        by_vin.setdefault(r[0], []).append(r)
    for events in by_vin.values():
        length, last = 0, None
        for vin, ts, seq, hit in sorted(events, key=lambda r: (r[1], r[2])):
            near = length > 0 and ts - last < within
            length = (length + 1 if near else 1) if hit else 0
            last = ts
            if length >= 2 and (every or length % 2 == 0):
                out.append((vin, seq))
    return sorted(out)


@pytest.mark.parametrize("seed", [3, 4, 5])
@pytest.mark.parametrize("skip", pattern.SKIP_POLICIES)
def test_recurrence_equals_sequential_scan(spark, seed, skip):
    rng = random.Random(seed)
    rows, now = [], START
    for i in range(500):
        now += dt.timedelta(seconds=rng.choice([0, 5, 60, 299, 300, 301, 900]))
        rows.append(("hot" if rng.random() < 0.7 else f"v{rng.randrange(3)}", now, i, rng.random() < 0.7))
    frame = spark.createDataFrame(rows, "vin string, ts timestamp, seq long, hit boolean").repartition(5)
    found = pattern.recurring(
        frame, ["vin"], "ts", ["ts", "seq"], F.col("hit"), "5 MINUTES", scan.time_chunk(F.col("ts"), "30 minutes"), skip
    )
    assert sorted((r.vin, r.seq) for r in found.collect()) == pairs(rows, dt.timedelta(minutes=5), skip == "next_row")


def test_unknown_skip_policy(spark):
    with pytest.raises(ValueError):
        pattern.recurring(spark.range(1), ["id"], "id", ["id"], F.lit(True), "1 MINUTE", F.lit(1), "other")
