"""Lead time, baseline, labels and scoring quality on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from convoy.operators import evaluate, features, risk, rules, scan


@pytest.mark.parametrize("kind,value,slope,expected", [
    ("cooling", 103.0, 5.6, 8.75), ("lubrication", 128.0, -14.0, 14.0), ("tyre", 650.0, -35.0, 20.0), ("cooling", 95.0, 3.5, 30.0),
    ("cooling", 95.0, 0.7, None), ("cooling", 112.0, 5.6, None), ("cooling", 100.0, 0.0, None), ("cooling", 100.0, -3.0, None),
    ("misfire", 1.0, 1.0, None),
])
def test_lead_days(spark, kind, value, slope, expected):
    signal, trend, _, _ = features.LEAD_RULES.get(kind, features.LEAD_RULES["cooling"])
    columns = {c: F.lit(None).cast("double") for rule in features.LEAD_RULES.values() for c in rule[:2]}
    columns |= {signal: F.lit(value), trend: F.lit(slope)}
    row = spark.range(1).withColumns(columns).select(features.lead_days(F.lit(kind)).alias("x")).first()
    assert row["x"] == (pytest.approx(expected) if expected is not None else None)


BASE = {c: None for c in ("max_coolant_c", "min_oil_kpa", "min_charge_v", "min_brake_pad_pct", "max_trans_c", "min_tire_kpa", "max_cell_temp_c")}


@pytest.mark.parametrize("name,value,flag", [
    ("max_coolant_c", 110.0, 0), ("max_coolant_c", 110.1, 1), ("min_oil_kpa", 40.0, 0), ("min_oil_kpa", 39.9, 1), ("min_charge_v", 12.4, 1),
    ("min_brake_pad_pct", 7.0, 1), ("max_trans_c", 131.0, 1), ("min_tire_kpa", 549.0, 1), ("max_cell_temp_c", 60.0, 0), ("max_cell_temp_c", 61.0, 1),
])
def test_baseline(spark, name, value, flag):
    cols = {k: F.lit(v).cast("double") for k, v in (BASE | {name: value}).items()} | {"any_dtc_today": F.lit(0)}
    assert rules.baseline_flag(spark.range(1).withColumns(cols)).first()["baseline"] == flag


def test_baseline_code_and_missing(spark):
    empty = spark.range(1).withColumns({k: F.lit(None).cast("double") for k in BASE} | {"any_dtc_today": F.lit(None).cast("int")})
    assert rules.baseline_flag(empty).first()["baseline"] == 0
    assert rules.baseline_flag(empty.withColumn("any_dtc_today", F.lit(1))).first()["baseline"] == 1


def test_slopes_count_rows_not_days(spark):
    days = [("v", dt.date(2024, 1, 1) + dt.timedelta(days=i * 2), float(i * i)) for i in range(9)]
    rows = features.row_slopes(spark.createDataFrame(days, "vin string, day date, x double"), [("s", "x")]).orderBy("day").collect()
    assert [r.s for r in rows] == [None] * 6 + [36.0, 48.0, 60.0]


def test_labels_drop_failed_days(spark):
    days = [("v", dt.date(2024, 1, d)) for d in range(1, 12)] + [("w", dt.date(2024, 1, 5))]
    labels = spark.createDataFrame(
        [("v", "t", "ICE", "cooling", None, dt.datetime(2024, 1, 10, 8)), ("w", "t", "EV", None, None, None)],
        "vin string, tenant string, vehicle_type string, failure_type string, onset_at timestamp, failure_at timestamp",
    )
    rows = features.add_labels(spark.createDataFrame(days, "vin string, day date"), labels).collect()
    kept = {r.day.day: (r.days_to_failure, r.any_failure_label) for r in rows if r.vin == "v"}
    assert kept == {d: (10 - d, int(10 - d <= 7)) for d in range(1, 10)}
    assert [(r.days_to_failure, r.any_failure_label) for r in rows if r.vin == "w"] == [(None, 0)]


SCORED = [(i, s, y) for i, (s, y) in enumerate([(0.9, 1), (0.8, 0), (0.8, 1), (0.5, 0), (0.5, 0), (0.5, 1), (0.1, 0), (0.0, 0)])]


def scored(spark, labels=None):
    rows = [(i, s, y if labels is None else labels) for i, s, y in SCORED]
    return spark.createDataFrame(rows, "id long, score double, label int").withColumn("g", F.lit("all"))


def test_average_precision_and_threshold(spark):
    ap = evaluate.average_precision(scored(spark), ["g"]).first()["average_precision"]
    assert ap == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 6)
    best = evaluate.best_f1(scored(spark), ["g"]).first()
    assert best["threshold"] == 0.5 and best["f1"] == pytest.approx(2 / 3)
    none = evaluate.best_f1(scored(spark, 0), ["g"]).first()
    assert none["threshold"] == 0.5
    assert evaluate.average_precision(scored(spark, 0), ["g"]).first()["average_precision"] is None


@pytest.mark.parametrize("k,hits", [(1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 3), (8, 3), (50, 3), (None, 2)])
def test_precision_at_k(spark, k, hits):
    chunk = scan.number_chunk(F.col("id"), 2)
    row = evaluate.precision_at_k(scored(spark), ["g"], "id", chunk, k).first()
    assert row["hits"] == hits
    assert row["k"] == min(k or 3, 8)


def test_cost(spark):
    row = evaluate.cost_saved(scored(spark), ["g"], F.col("score") >= 0.8, F.col("label")).first()
    assert row["saved"] == 2 * 147_000 - 3_000


def test_pages_cover_everything_once(spark):
    rows = spark.createDataFrame([(i, (i * 37 % 10) / 10) for i in range(25)], "vehicle_id long, risk_score double")
    seen, cursor = [], None
    while True:
        page = risk.keyset_page(rows, 10, cursor)
        seen += [(r.risk_score, r.vehicle_id) for r in page.collect()]
        last = risk.next_cursor(page, 10).first()
        if last is None:
            break
        cursor = (last["risk_score"], last["vehicle_id"])
    assert seen == sorted(((r.risk_score, r.vehicle_id) for r in rows.collect()), reverse=True)


def test_risk_percent_rounds_like_fixed_point_formatting(spark):
    rows = [(i, i / 1e5) for i in range(100_001)]
    frame = spark.createDataFrame(rows, "i long, r double").withColumn("text", risk.risk_percent(F.col("r")))
    assert [r.i for r in frame.collect() if r.text != f"{r.r * 100:.1f}%"] == []
