"""Queries on daily features, labels, lead time and scoring quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoy.operators import evaluate, features, rules, scan
from convoy.plans import derive as d
from convoy.plans.registry import query

_DAILY_SQL = """fd AS (SELECT vin, CAST(event_time AS DATE) AS day, avg(coolant_c) AS avg_coolant_c, max(coolant_c) AS max_coolant_c,
   avg(oil_kpa) AS avg_oil_kpa, min(oil_kpa) AS min_oil_kpa, avg(rpm) AS avg_rpm, avg(load_pct) AS avg_load_pct, avg(ambient_c) AS avg_ambient_c,
   avg(trans_c) AS avg_trans_c, max(trans_c) AS max_trans_c, avg(fuel_rate_lph) AS avg_fuel_rate_lph, avg(speed_kmh) AS avg_speed_kmh,
   count(*) AS fast_samples, CASE WHEN avg(speed_kmh) > 5 THEN avg(rpm) / avg(speed_kmh) END AS rpm_per_speed_kmh
   FROM tel WHERE msg_type = 'FAST' GROUP BY ALL),
 hr AS (SELECT *, kpa_1 + kpa_2 + kpa_3 AS s FROM tel WHERE msg_type = 'HEALTH'),
 hd AS (SELECT vin, CAST(event_time AS DATE) AS day, min(charge_v) AS min_charge_v, avg(charge_v) AS avg_charge_v, min(batt_12v_rest_v) AS min_batt_12v_rest_v,
   min(least(pad_1, pad_2)) AS min_brake_pad_pct,
   max(greatest(abs(kpa_1 - (s - kpa_1) / 2), abs(kpa_2 - (s - kpa_2) / 2), abs(kpa_3 - (s - kpa_3) / 2))) AS max_tyre_delta_kpa,
   min(least(kpa_1, kpa_2, kpa_3)) AS min_tire_kpa, max(greatest(tyre_c_1, tyre_c_2)) AS max_tire_c,
   max(CASE WHEN n_dtc > 0 THEN 1 ELSE 0 END) AS any_dtc_today, max(cell_v_delta_mv) AS max_cell_v_delta_mv, min(soh_pct) AS min_soh_pct,
   max(cell_temp_max_c) AS max_cell_temp_c, count(*) AS health_samples FROM hr GROUP BY ALL),
 daily AS (SELECT * FROM fd FULL JOIN hd USING (vin, day))"""
_SLOPE_SQL = ", ".join(f"{c} - lag({c}, 6) OVER w AS {out}" for out, c in features.SLOPES)
_TREND_SQL = f"""trend AS (SELECT *, {_SLOPE_SQL}, CAST(sum(any_dtc_today) OVER w7 AS BIGINT) AS dtc_recurrence_7d, max(max_tyre_delta_kpa) OVER w7 AS max_tyre_delta_7d
  FROM daily WINDOW w AS (PARTITION BY vin ORDER BY day), w7 AS (PARTITION BY vin ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""
_LABEL_SQL = """feat AS (SELECT * FROM (SELECT t.*, l.vehicle_type, l.failure_type, l.failure_at, date_diff('day', t.day, CAST(l.failure_at AS DATE))::INTEGER AS days_to_failure
  FROM trend t JOIN labels_all l ON l.vin = t.vin) WHERE failure_at IS NULL OR days_to_failure > 0),
 lab AS (SELECT *, CASE WHEN days_to_failure <= 7 THEN 1 ELSE 0 END AS any_failure_label FROM feat)"""
_FEATURES = f"{d.TEL}, {d.LABELS}, {_DAILY_SQL}, {_TREND_SQL}, {_LABEL_SQL}"


def _split(spark, sf_dir):
    rows = d.telemetry(spark, sf_dir)
    return rows.filter("msg_type = 'FAST'"), rows.filter("msg_type = 'HEALTH'")


def _daily(spark, sf_dir):
    fast, health = _split(spark, sf_dir)
    return features.daily_fast(fast).join(features.daily_health(health), ["vin", "day"], "outer")


def table(spark, sf_dir):
    """The nightly feature table."""
    fast, health = _split(spark, sf_dir)
    return features.feature_table(fast, health, d.failure_labels(spark, sf_dir))


@query("features_daily", "O-AGG-1", "O-AGG-2", "O-JOIN-2", "O-FLT-10", sql=f"WITH {d.TEL}, {_DAILY_SQL} SELECT * FROM daily")
def features_daily(spark, sf_dir):
    return _daily(spark, sf_dir)


@query("slopes_7", "O-WIN-1", sql=f"WITH {d.TEL}, {_DAILY_SQL}, {_TREND_SQL} SELECT vin, day, {', '.join(o for o, _ in features.SLOPES)} FROM trend")
def slopes_7(spark, sf_dir):
    return features.row_slopes(_daily(spark, sf_dir), features.SLOPES).select("vin", "day", *[o for o, _ in features.SLOPES])


@query("trailing_7", "O-WIN-2", sql=f"WITH {d.TEL}, {_DAILY_SQL}, {_TREND_SQL} SELECT vin, day, dtc_recurrence_7d, max_tyre_delta_7d FROM trend")
def trailing_7(spark, sf_dir):
    return features.trailing(
        _daily(spark, sf_dir), {"dtc_recurrence_7d": "any_dtc_today"}, {"max_tyre_delta_7d": "max_tyre_delta_kpa"}
    ).select("vin", "day", "dtc_recurrence_7d", "max_tyre_delta_7d")


@query(
    "feature_table", "O-ML-1", "O-ML-2", "O-JOIN-1", "O-JOIN-3", "O-AGG-13",
    sql=f"WITH {_FEATURES} SELECT * FROM lab",
)
def feature_table(spark, sf_dir):
    return table(spark, sf_dir)


@query(
    "labels_horizon", "O-ML-2",
    sql=f"WITH {_FEATURES} SELECT vin, day, failure_type, days_to_failure, any_failure_label FROM lab",
)
def labels_horizon(spark, sf_dir):
    days = _daily(spark, sf_dir).select("vin", "day")
    return features.add_labels(days, d.failure_labels(spark, sf_dir)).select("vin", "day", "failure_type", "days_to_failure", "any_failure_label")


@query(
    "feature_counts", "O-AGG-12",
    sql=f'WITH {_FEATURES} SELECT count(*) AS "rows", count(*) FILTER (any_failure_label = 1) AS positives, count(DISTINCT vin) AS vehicles FROM lab',
)
def feature_counts(spark, sf_dir):
    return features.feature_counts(table(spark, sf_dir))


@query(
    "sibling_delta", "O-AGG-2",
    sql="""WITH a AS (SELECT l_orderkey, list(l_quantity) AS q, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY l_orderkey)
           SELECT l_orderkey, CASE WHEN n >= 2 THEN list_max(list_transform(q, lambda v: abs(v - (s - v) / (n - 1)))) END AS delta FROM a""",
)
def sibling_delta_query(spark, sf_dir):
    """Lines of an order as tyres of a vehicle, in long form."""
    return features.grouped_sibling_delta(d.table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", "delta")


@query(
    "as_of_split", "O-ML-3", "O-ML-4", "O-ML-5", "O-ML-6",
    sql=f"""WITH {_FEATURES}, x AS (SELECT vin, day, coalesce(failure_type, '') AS failure_type, day + days_to_failure AS failure_day FROM lab),
     c AS (SELECT max(day) - 10 AS as_of FROM x),
     kn AS (SELECT x.* FROM x, c WHERE day < as_of AND (failure_day IS NULL OR failure_day <= as_of)),
     ds AS (SELECT list_sort(list(DISTINCT day)) AS l FROM kn),
     cut AS (SELECT l[CAST(floor(len(l) * 0.70::DOUBLE) AS INTEGER) + 1] AS a, l[CAST(floor(len(l) * 0.85::DOUBLE) AS INTEGER) + 1] AS b FROM ds)
     SELECT vin, day, CASE WHEN day < a THEN 'train' WHEN day < b THEN 'validate' ELSE 'test' END AS split,
       CASE WHEN failure_type = 'cooling' THEN 1 ELSE 0 END AS is_cooling FROM kn, cut""",
)
def as_of_split(spark, sf_dir):
    inputs = features.model_inputs(table(spark, sf_dir)).select("vin", "day", "failure_type", "failure_day")
    as_of = features.as_of_date(inputs).first()["as_of"]  # two dates steer the split
    known = features.knowable_as_of(inputs, F.lit(as_of))
    cuts = features.split_cuts(known).first()
    return known.select(
        "vin", "day",
        features.split_name(F.col("day"), F.lit(cuts["train_cut"]), F.lit(cuts["validate_cut"])).alias("split"),
        (F.col("failure_type") == "cooling").cast("int").alias("is_cooling"),
    )


def _lead_case(types):
    parts = []
    for name in types:
        value, slope, threshold, rising = features.LEAD_RULES[name]
        days = f"({threshold} - {value}) / ({slope} / 7)" if rising else f"({value} - {threshold}) / (-({slope} / 7))"
        ok = f"{slope} > 0 AND {value} < {threshold}" if rising else f"{slope} < 0 AND {value} > {threshold}"
        parts.append(f"SELECT vin, day, '{name}' AS failure_type, CASE WHEN {ok} AND {days} <= 30 THEN {days} END AS lead_days FROM tr")
    return " UNION ALL ".join(parts)


_LEAD_SQL = _lead_case(features.LEAD_RULES)


@query(
    "lead_time", "O-ML-14",
    sql=f"""WITH {d.TEL}, {_DAILY_SQL}, {_TREND_SQL}, tr AS (SELECT * FROM trend),
     l AS ({_LEAD_SQL} UNION ALL SELECT vin, day, 'misfire' AS failure_type, NULL AS lead_days FROM tr)
     SELECT vin, day, failure_type, round(lead_days, 8) AS lead_days FROM l""",
)
def lead_time(spark, sf_dir):
    fast, health = _split(spark, sf_dir)
    daily = features.daily_features(fast, health)
    kinds = F.explode(F.array(*[F.lit(t) for t in [*features.LEAD_RULES, "misfire"]]))
    long = daily.withColumn("failure_type", kinds)
    return long.select("vin", "day", "failure_type", F.round(features.lead_days(F.col("failure_type")), 8).alias("lead_days"))


_BASE_SQL = """base AS (SELECT *, CASE WHEN any_dtc_today > 0 OR max_coolant_c > 110 OR min_oil_kpa < 40 OR min_charge_v < 12.5 OR min_brake_pad_pct < 8
   OR max_trans_c > 130 OR min_tire_kpa < 550 OR max_cell_temp_c > 60 THEN 1 ELSE 0 END AS baseline FROM lab)"""


@query("baseline_flag", "O-FLT-6", sql=f"WITH {_FEATURES}, {_BASE_SQL} SELECT vin, day, baseline FROM base")
def baseline_flag(spark, sf_dir):
    return rules.baseline_flag(table(spark, sf_dir)).select("vin", "day", "baseline")


@query(
    "cost_saved", "O-ML-11",
    sql=f"""WITH {_FEATURES}, {_BASE_SQL} SELECT vehicle_type,
      count(*) FILTER (baseline = 1 AND any_failure_label = 1) * 147000 - count(*) FILTER (baseline = 1 AND any_failure_label = 0) * 3000 AS saved
      FROM base GROUP BY vehicle_type""",
)
def cost_saved(spark, sf_dir):
    flagged = rules.baseline_flag(table(spark, sf_dir))
    return evaluate.cost_saved(flagged, ["vehicle_type"], F.col("baseline"), F.col("any_failure_label"))


@query(
    "recall_at_lead", "O-ML-10",
    sql=f"""WITH {_FEATURES}, {_BASE_SQL}, g AS (SELECT vehicle_type, count(*) FILTER (baseline = 1 AND any_failure_label = 1) AS tp,
       count(*) FILTER (baseline = 1 AND any_failure_label = 0) AS fp, count(*) FILTER (baseline = 0 AND any_failure_label = 1) AS fn,
       count(*) FILTER (any_failure_label = 1 AND days_to_failure >= 5 AND baseline = 1) AS eh, count(*) FILTER (any_failure_label = 1 AND days_to_failure >= 5) AS en
       FROM base GROUP BY vehicle_type)
     SELECT vehicle_type, tp, fp, fn, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
       eh::DOUBLE / nullif(en, 0) AS recall_at_lead FROM g""",
)
def recall_at_lead(spark, sf_dir):
    flagged = rules.baseline_flag(table(spark, sf_dir))
    return evaluate.classification(
        flagged, ["vehicle_type"], F.col("baseline"), F.col("any_failure_label"), lead=F.col("days_to_failure")
    )


_SCORED_SQL = "sc AS (SELECT tenant, seq, cast((c * 37) % 997 as double) / 1024 AS score, CASE WHEN kind = 'error' THEN 1 ELSE 0 END AS label FROM sig)"


def _scored(spark, sf_dir):
    return d.signals(spark, sf_dir).selectExpr(
        "tenant", "seq", "cast((c * 37) % 997 as double) / 1024 as score", "case when kind = 'error' then 1 else 0 end as label"
    )


_CURVE_SQL = f"""{_SCORED_SQL}, pt AS (SELECT tenant, score, count(*) AS n, sum(label) AS pos FROM sc GROUP BY tenant, score),
  cv AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER (PARTITION BY tenant) AS tot FROM pt
         WINDOW w AS (PARTITION BY tenant ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(
    "average_precision", "O-ML-10",
    sql=f"""WITH {d.SIG}, {_CURVE_SQL} SELECT tenant, round(sum(pos::DOUBLE * (cp::DOUBLE / cn::DOUBLE)) / sum(pos)::DOUBLE, 9) AS average_precision,
            sum(pos)::BIGINT AS positives, sum(n)::BIGINT AS "rows" FROM cv GROUP BY tenant""",
)
def average_precision(spark, sf_dir):
    return evaluate.average_precision(_scored(spark, sf_dir), ["tenant"]).withColumn("average_precision", F.round("average_precision", 9))


@query(
    "average_precision_nulls", "O-ML-10",
    sql=f"""WITH {d.SIG}, {_CURVE_SQL.replace('FROM sc GROUP BY', "FROM (SELECT * REPLACE (nullif(tenant, (SELECT min(tenant) FROM sc)) AS tenant) FROM sc) GROUP BY")}
            SELECT tenant, round(sum(pos::DOUBLE * (cp::DOUBLE / cn::DOUBLE)) / sum(pos)::DOUBLE, 9) AS average_precision,
            sum(pos)::BIGINT AS positives, sum(n)::BIGINT AS "rows" FROM cv GROUP BY tenant""",
)
def average_precision_nulls(spark, sf_dir):
    """One tenant without a name is a group."""
    rows = _scored(spark, sf_dir)
    least = rows.agg(F.min("tenant")).first()[0]
    named = rows.withColumn("tenant", F.when(F.col("tenant") != least, F.col("tenant")))
    return evaluate.average_precision(named, ["tenant"]).withColumn("average_precision", F.round("average_precision", 9))


@query(
    "best_f1", "O-ML-9",
    sql=f"""WITH {d.SIG}, {_CURVE_SQL}, f AS (SELECT tenant, score, tot, cp::DOUBLE / cn AS p, cp::DOUBLE / tot AS r FROM cv),
       g AS (SELECT *, CASE WHEN p + r > 0 THEN 2.0::DOUBLE * p * r / (p + r + 1e-12) ELSE 0 END AS f1 FROM f)
     SELECT tenant, arg_max(score, (f1, -score)) AS threshold, round(max(f1), 9) AS f1, max(tot)::BIGINT AS positives FROM g GROUP BY tenant""",
)
def best_f1(spark, sf_dir):
    return evaluate.best_f1(_scored(spark, sf_dir), ["tenant"]).withColumn("f1", F.round("f1", 9))


@query(
    "precision_at_k", "O-TOP-6",
    sql=f"""WITH {d.SIG}, {_SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY score DESC, seq) AS rn FROM sc)
      SELECT tenant, count(*) AS k, sum(label)::BIGINT AS hits, sum(label)::DOUBLE / count(*) AS precision_at_k FROM r WHERE rn <= 100 GROUP BY tenant""",
)
def precision_at_k(spark, sf_dir):
    return evaluate.precision_at_k(_scored(spark, sf_dir), ["tenant"], "seq", scan.number_chunk(F.col("seq"), 1000), k=100)


@query(
    "precision_at_positives", "O-TOP-6", "O-ML-13",
    sql=f"""WITH {d.SIG}, {_SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY score DESC, seq) AS rn,
        sum(label) OVER (PARTITION BY tenant) AS kk FROM sc)
      SELECT tenant, count(*) AS k, sum(label)::BIGINT AS hits, sum(label)::DOUBLE / count(*) AS precision_at_k FROM r WHERE rn <= kk GROUP BY tenant""",
)
def precision_at_positives(spark, sf_dir):
    return evaluate.precision_at_k(_scored(spark, sf_dir), ["tenant"], "seq", scan.number_chunk(F.col("seq"), 1000))


@query(
    "widest_risk", "O-WIN-7", "O-ML-12",
    sql=f"""WITH {d.TEL}, x AS (SELECT vin, seq, coolant_c AS a, trans_c AS b, load_pct AS e FROM tel WHERE msg_type = 'FAST')
      SELECT vin, seq, greatest(a, b, e) AS fleet_risk, CASE greatest(a, b, e) WHEN a THEN 'a' WHEN b THEN 'b' ELSE 'e' END AS top_type FROM x""",
)
def widest_risk(spark, sf_dir):
    fast = d.telemetry(spark, sf_dir).filter("msg_type = 'FAST'").selectExpr("vin", "seq", "coolant_c as a", "trans_c as b", "load_pct as e")
    return evaluate.widest_risk(fast, ["a", "b", "e"]).select("vin", "seq", "fleet_risk", "top_type")
