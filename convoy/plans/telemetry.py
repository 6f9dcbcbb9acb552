"""Queries on the message stream: dedup, twin, rules, rollups, reconciliation, governance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.functions import arrays
from convoy.operators import dedup, governance, pattern, risk, rollup, rules, scan, twin
from convoy.plans import derive as d
from convoy.plans.registry import query

NOW_SQL = f"TIMESTAMP '{d.NOW}'"


def now():
    return F.lit(d.NOW).cast("timestamp_ntz")


def arrival_order():
    return [F.col("arrival"), F.col("seq")]


def arrival_chunk():
    """Spans of some hundred messages at test size; an hour or a day of arrivals on a live table."""
    return scan.number_chunk(F.col("arrival"), 500)


def day_chunk():
    return scan.time_chunk(F.col("event_time"), "2 days")


_ALERT_SQL = "vin, tenant, '{0}' AS failure_type, 'critical' AS severity, 'realtime' AS source, {1} AS dtc_codes, event_time AS detected_at"


def _flat(alerts: DataFrame) -> DataFrame:
    """Code arrays as comma text, so that both engines return the same scalar."""
    return alerts.withColumn("dtc_codes", F.array_join("dtc_codes", ","))


# --- dedup, sequence guard, twin ---------------------------------------------------------------
@query(
    "dedup_first_arrival", "O-DED-1", "O-VAL-11", "O-WIN-3",
    sql=f"""WITH {d.SIG}, {d.COPIES}, r AS (SELECT *, row_number() OVER (PARTITION BY vin, seq ORDER BY arrival, seq) AS rn
            FROM dup WHERE tenant IS NOT NULL AND event_time IS NOT NULL)
            SELECT vin, seq, tenant, msg_type, event_time, arrival FROM r WHERE rn = 1""",
)
def dedup_first_arrival(spark, sf_dir):
    rows = dedup.require(d.with_copies(d.signals(spark, sf_dir)), "tenant", "event_time")
    return dedup.first_arrival(rows, ["vin", "seq"], arrival_order()).select("vin", "seq", "tenant", "msg_type", "event_time", "arrival")


_GUARD_SQL = """ok AS (SELECT * FROM (SELECT *, max(seq) OVER (PARTITION BY vin, msg_type ORDER BY arrival, seq
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM dup) WHERE seen IS NULL OR seq > seen)"""


@query(
    "seq_guard", "O-DED-3",
    sql=f"WITH {d.SIG}, {d.COPIES}, {_GUARD_SQL} SELECT vin, msg_type, seq, arrival FROM ok",
)
def seq_guard(spark, sf_dir):
    rows = d.with_copies(d.signals(spark, sf_dir))
    return dedup.drop_stale(rows, ["vin", "msg_type"], "seq", arrival_order(), arrival_chunk()).select("vin", "msg_type", "seq", "arrival")


_NULL_KINDS = "cast(CASE WHEN seq % 3 = 0 THEN NULL ELSE msg_type END AS varchar)"


@query(
    "seq_guard_nulls", "O-DED-3",
    sql=f"""WITH {d.SIG}, {d.COPIES.replace('dup AS', 'dup0 AS', 1)}, dup AS (SELECT * REPLACE ({_NULL_KINDS} AS msg_type) FROM dup0), {_GUARD_SQL}
        SELECT vin, msg_type, seq, arrival FROM ok""",
)
def seq_guard_nulls(spark, sf_dir):
    """A third of the rows without a message type: they are one more kind."""
    rows = d.with_copies(d.signals(spark, sf_dir)).withColumn("msg_type", F.when(F.col("seq") % 3 != 0, F.col("msg_type")))
    return dedup.drop_stale(rows, ["vin", "msg_type"], "seq", arrival_order(), arrival_chunk()).select("vin", "msg_type", "seq", "arrival")


_TWIN_FIELDS = ["coolant_c", "oil_kpa", "speed_kmh", "lat", "lon", "charge_v", "soh_pct", "dtc"]


def _twin(spark, sf_dir):
    return twin.fold_twin(d.with_copies(d.telemetry(spark, sf_dir)), _TWIN_FIELDS, ["arrival", "seq"], arrival_chunk())


@query(
    "twin_latest", "O-STR-5", "O-SNK-5",
    sql=f"""WITH {d.TEL}, dup AS (SELECT * FROM tel UNION ALL BY NAME SELECT * REPLACE (arrival + 1000 AS arrival) FROM tel WHERE kind = 'click'),
    {_GUARD_SQL}
    SELECT vin, arg_min(tenant, (arrival, seq)) AS tenant, arg_max(event_time, (arrival, seq)) AS updated_at,
      arg_max(msg_type, (arrival, seq)) AS last_msg_type,
      max(seq) FILTER (msg_type = 'FAST') AS last_seq_fast, max(seq) FILTER (msg_type = 'HEALTH') AS last_seq_health,
      max(seq) FILTER (msg_type = 'EVENT') AS last_seq_event,
      arg_max(coolant_c, (arrival, seq)) FILTER (coolant_c IS NOT NULL) AS coolant_c,
      arg_max(oil_kpa, (arrival, seq)) FILTER (oil_kpa IS NOT NULL) AS oil_kpa,
      arg_max(speed_kmh, (arrival, seq)) FILTER (speed_kmh IS NOT NULL) AS speed_kmh,
      arg_max(lat, (arrival, seq)) FILTER (lat IS NOT NULL) AS lat, arg_max(lon, (arrival, seq)) FILTER (lon IS NOT NULL) AS lon,
      arg_max(charge_v, (arrival, seq)) FILTER (charge_v IS NOT NULL) AS charge_v,
      arg_max(soh_pct, (arrival, seq)) FILTER (soh_pct IS NOT NULL) AS soh_pct,
      arg_max(event_dtc, (arrival, seq)) FILTER (event_dtc IS NOT NULL) AS dtc
    FROM ok GROUP BY vin""",
)
def twin_latest(spark, sf_dir):
    return _twin(spark, sf_dir)


@query(
    "vehicle_lookup", "O-SRC-6",
    sql=f"""WITH {d.SIG}, {d.VEHICLES}, t AS (SELECT vin, max(seq) AS seq FROM sig GROUP BY vin)
            SELECT vin, seq FROM t WHERE vin IN (SELECT vin FROM vehicles WHERE status = 'MACHINERY')""",
)
def vehicle_lookup(spark, sf_dir):
    latest = d.signals(spark, sf_dir).groupBy("vin").agg(F.max("seq").alias("seq"))
    return twin.vehicle_state(latest, d.vehicles(spark, sf_dir).filter("status = 'MACHINERY'"))


# --- rules --------------------------------------------------------------------------------------
_THRESHOLD_SQL = f"""
  SELECT {_ALERT_SQL.format('lubrication', "'P0520,P0521,P0522,P0523,P0524'")} FROM tel WHERE oil_kpa < 100 AND rpm > 0
  UNION ALL SELECT {_ALERT_SQL.format('12v_battery', "'P0562,P0615'")} FROM tel WHERE charge_v < 12.5
  UNION ALL SELECT {_ALERT_SQL.format('ev_battery', "'P0A80,P0AFA'")} FROM tel WHERE cell_temp_max_c > 60"""
_MISFIRE_SQL = f"""
  SELECT {_ALERT_SQL.format('misfire', "CASE n_dtc WHEN 1 THEN dtc_1 ELSE 'P0A80,' || dtc_1 END")}
  FROM tel WHERE msg_type = 'HEALTH' AND k % 2 = 0 AND n_dtc > 0 AND dtc_1 <= 'P0308'"""
_ELEMENT_SQL = f"""
  SELECT {_ALERT_SQL.format('brake_wear', "'C0750'")} FROM (SELECT *, unnest([pad_1, pad_2]) AS x FROM tel WHERE msg_type = 'HEALTH') WHERE x < 20
  UNION ALL SELECT {_ALERT_SQL.format('tyre', "'C0750'")} FROM (SELECT *, unnest([kpa_1, kpa_2, kpa_3]) AS x FROM tel WHERE msg_type = 'HEALTH') WHERE x < 550
  UNION ALL SELECT {_ALERT_SQL.format('tyre', "'C0750'")} FROM (SELECT *, unnest([tyre_c_1, tyre_c_2]) AS x FROM tel WHERE msg_type = 'HEALTH') WHERE x > 60"""


@query(
    "rules_threshold", "O-FLT-1", "O-FLT-2", "O-FLT-3", "O-FLT-4", "O-FLT-5", "O-FLT-7", "O-SET-1",
    sql=f"WITH {d.TEL} {_THRESHOLD_SQL} UNION ALL {_MISFIRE_SQL}",
)
def rules_threshold(spark, sf_dir):
    return _flat(rules.row_alerts(d.telemetry(spark, sf_dir), rules.ROW_RULES))


@query("rules_array_codes", "O-FLT-4", sql=f"WITH {d.TEL} {_MISFIRE_SQL}")
def rules_array_codes(spark, sf_dir):
    chosen = [r for r in rules.ROW_RULES if r.failure_type == "misfire"]
    return _flat(rules.row_alerts(d.telemetry(spark, sf_dir), chosen))


@query("rules_element", "O-JOIN-10", sql=f"WITH {d.TEL} {_ELEMENT_SQL}")
def rules_element(spark, sf_dir):
    return _flat(rules.row_alerts(d.telemetry(spark, sf_dir), rules.ELEMENT_RULES))


# test vehicles report about twice a day, so the windows are hours instead of seconds
_HOP_SQL = """
  SELECT vin, tenant, '{0}' AS failure_type, 'critical' AS severity, 'realtime' AS source, '{1}' AS dtc_codes, w + INTERVAL 12 HOUR AS detected_at
  FROM (SELECT vin, tenant, {2} AS x, time_bucket(INTERVAL 2 HOUR, event_time) - to_hours(CAST(2 * i AS INTEGER)) AS w
        FROM tel, range(6) AS g(i) WHERE msg_type = 'FAST')
  GROUP BY vin, tenant, w HAVING min(x) > {3}"""
_HOPS_SQL = _HOP_SQL.format("cooling", "P0128,P0217", "coolant_c", 110) + " UNION ALL " + _HOP_SQL.format("transmission", "P0700,P0730", "trans_c", 130)


def _sustained(df):
    return rules.sustained_alerts(df, rules.SUSTAINED_RULES, window="12 hours", slide="2 hours")


@query("hop_min", "O-STR-3", sql=f"WITH {d.TEL} {_HOPS_SQL}")
def hop_min(spark, sf_dir):
    return _flat(_sustained(d.telemetry(spark, sf_dir)))


_RUNS_SQL = """ev AS (SELECT vin, tenant, seq, event_time, event_dtc AS dtc,
     coalesce(event_name = 'DTC_SET' AND event_dtc <= 'P0308', false) AS m FROM tel WHERE msg_type = 'EVENT'),
  st AS (SELECT *, CASE WHEN m AND coalesce(lag(m) OVER w AND event_time - lag(event_time) OVER w < INTERVAL 24 HOUR, false) THEN 0 ELSE 1 END AS fresh
     FROM ev WINDOW w AS (PARTITION BY vin, tenant ORDER BY event_time, seq)),
  gr AS (SELECT *, sum(fresh) OVER (PARTITION BY vin, tenant ORDER BY event_time, seq ROWS UNBOUNDED PRECEDING) AS g FROM st),
  ps AS (SELECT *, row_number() OVER (PARTITION BY vin, tenant, g ORDER BY event_time, seq) AS p FROM gr)"""
_PAIR_SQL = "SELECT vin, tenant, 'misfire' AS failure_type, 'critical' AS severity, 'realtime' AS source, dtc AS dtc_codes, event_time AS detected_at FROM ps WHERE m AND p >= 2"


def _recurring(df, skip):
    return pattern.misfire_recurrence(df, day_chunk(), within="24 HOURS", skip=skip)


@query("cep_pairs", "O-STR-4", sql=f"WITH {d.TEL}, {_RUNS_SQL} {_PAIR_SQL} AND p % 2 = 0")
def cep_pairs(spark, sf_dir):
    return _flat(_recurring(d.telemetry(spark, sf_dir), "past_last"))


@query("cep_null_tenant", "O-STR-4", sql=f"WITH {d.TEL.replace('tel AS', 'tel0 AS', 1)}, tel AS (SELECT * REPLACE (nullif(tenant, (SELECT min(tenant) FROM tel0)) AS tenant) FROM tel0), {_RUNS_SQL} {_PAIR_SQL} AND p % 2 = 0")
def cep_null_tenant(spark, sf_dir):
    """One tenant without a name: its vehicles' pairs stay."""
    rows = d.telemetry(spark, sf_dir)
    least = rows.agg(F.min("tenant")).first()[0]
    return _flat(_recurring(rows.withColumn("tenant", F.when(F.col("tenant") != least, F.col("tenant"))), "past_last"))


@query("cep_every", "O-STR-4", sql=f"WITH {d.TEL}, {_RUNS_SQL} {_PAIR_SQL}")
def cep_every(spark, sf_dir):
    return _flat(_recurring(d.telemetry(spark, sf_dir), "next_row"))


def all_alerts(df: DataFrame) -> DataFrame:
    """All ten rules over the raw (not deduplicated) telemetry."""
    return (
        rules.row_alerts(df, rules.ROW_RULES + rules.ELEMENT_RULES)
        .unionByName(_sustained(df))
        .unionByName(_recurring(df, "past_last"))
    )


_ALL_SQL = f"{_THRESHOLD_SQL} UNION ALL {_MISFIRE_SQL} UNION ALL {_ELEMENT_SQL} UNION ALL {_HOPS_SQL} UNION ALL {_PAIR_SQL} AND p % 2 = 0"


@query("alerts_all", "O-SET-1", "O-STR-10", sql=f"WITH {d.TEL}, {_RUNS_SQL} {_ALL_SQL}")
def alerts_all(spark, sf_dir):
    return _flat(all_alerts(d.telemetry(spark, sf_dir)))


_KNOWN = "c_acctbal >= 0"


def _known_vehicles(spark, sf_dir):
    return d.table(spark, sf_dir, "customer").filter(_KNOWN).selectExpr(
        "concat('V', lpad(cast(c_custkey as string), 16, '0')) as vin", "c_custkey as vehicle_id",
        "concat('owner-', cast(c_nationkey as string)) as tenant",
    )


_KNOWN_SQL = f"known AS (SELECT concat('V', lpad(cast(c_custkey as string), 16, '0')) AS vin, c_custkey AS vehicle_id, concat('owner-', cast(c_nationkey as string)) AS tenant FROM customer WHERE {_KNOWN})"


@query(
    "alert_enrich", "O-JOIN-6",
    sql=f"""WITH {d.TEL}, {_KNOWN_SQL}, a AS ({_THRESHOLD_SQL} UNION ALL {_MISFIRE_SQL})
            SELECT a.vin, k.vehicle_id, k.tenant, failure_type, severity, source, dtc_codes, detected_at FROM a JOIN known k ON k.vin = a.vin""",
)
def alert_enrich(spark, sf_dir):
    return rules.enrich_alerts(rules_threshold(spark, sf_dir), _known_vehicles(spark, sf_dir))


@query(
    "alert_unknown", "O-JOIN-6",
    sql=f"""WITH {d.TEL}, {_KNOWN_SQL}, a AS ({_THRESHOLD_SQL} UNION ALL {_MISFIRE_SQL})
            SELECT vin, count(*) AS alerts FROM a WHERE vin NOT IN (SELECT vin FROM known) GROUP BY vin""",
)
def alert_unknown(spark, sf_dir):
    return rules.unknown_alerts(rules_threshold(spark, sf_dir), _known_vehicles(spark, sf_dir))


# --- rollups ------------------------------------------------------------------------------------
_ROLLUP_SQL = """rollup_all AS (SELECT vin, CAST(event_time AS DATE) AS day, avg(coolant_c) AS avg_coolant_c, max(coolant_c) AS max_coolant_c,
    avg(ambient_c) AS avg_ambient_c, avg(load_pct) AS avg_load_pct, avg(rpm) AS avg_rpm, avg(oil_kpa) AS avg_oil_kpa, min(oil_kpa) AS min_oil_kpa,
    avg(trans_c) AS avg_trans_c, max(trans_c) AS max_trans_c, max(speed_kmh) AS max_speed_kmh, sum(fuel_rate_lph) AS fuel_rate_sum,
    count(*) AS sample_count FROM tel WHERE msg_type = 'FAST' GROUP BY ALL)"""


def _fast(spark, sf_dir):
    return d.telemetry(spark, sf_dir).filter("msg_type = 'FAST'")


@query("daily_rollup", "O-AGG-3", sql=f"WITH {d.TEL}, {_ROLLUP_SQL} SELECT * FROM rollup_all")
def daily_rollup(spark, sf_dir):
    return rollup.daily_rollup(_fast(spark, sf_dir))


@query(
    "rollup_incremental", "O-AGG-4",
    sql=f"WITH {d.TEL}, {_ROLLUP_SQL} SELECT * FROM rollup_all WHERE day < CAST({NOW_SQL} AS DATE) - 1",
)
def rollup_incremental(spark, sf_dir):
    """A stored rollup that stops three days back, brought up to the last complete day."""
    raw = _fast(spark, sf_dir)
    stored = rollup.daily_rollup(raw.filter(F.col("event_time") < now() - F.expr("INTERVAL 3 DAYS")))
    return rollup.refresh(stored, raw, now())


@query(
    "fleet_trend", "O-AGG-8",
    sql=f"WITH {d.TEL}, {_ROLLUP_SQL} SELECT day, round(avg(avg_coolant_c), 8) AS avg_coolant_c, round(avg(avg_oil_kpa), 8) AS avg_oil_kpa FROM rollup_all GROUP BY day",
)
def fleet_trend(spark, sf_dir):
    trend = rollup.fleet_trend(rollup.daily_rollup(_fast(spark, sf_dir)), ["avg_coolant_c", "avg_oil_kpa"])
    return trend.select("day", *[F.round(c, 8).alias(c) for c in ("avg_coolant_c", "avg_oil_kpa")])


# --- reconciliation, retention, counters --------------------------------------------------------
@query(
    "reconcile_keys", "O-DED-4", "O-SET-2",
    sql=f"WITH {d.SIG}, {d.COPIES} SELECT DISTINCT vin, seq FROM dup WHERE (vin, seq) NOT IN (SELECT vin, seq FROM sig WHERE kind <> 'signup')",
)
def reconcile_keys(spark, sf_dir):
    rows = d.signals(spark, sf_dir)
    return dedup.missing_keys(d.with_copies(rows), rows.filter("kind <> 'signup'"), ["vin", "seq"])


@query(
    "reconcile_loss", "O-DED-4",
    sql=f"""WITH {d.SIG}, {d.COPIES} SELECT count(*) AS sent, count(*) FILTER (kind <> 'signup') AS landed,
            count(*) FILTER (kind = 'signup') AS missing, count(*) FILTER (kind = 'signup') * 100.0::DOUBLE / count(*) AS loss_pct FROM dup""",
)
def reconcile_loss(spark, sf_dir):
    rows = d.signals(spark, sf_dir)
    return dedup.loss_by_key(d.with_copies(rows), rows.filter("kind <> 'signup'"), ["vin", "seq"]).withColumn(
        "loss_pct", F.col("loss_pct").cast("double")
    )


@query(
    "reconcile_totals", "O-DED-5",
    sql=f"""WITH {d.SIG}, {d.COPIES}, t AS (SELECT tenant, count(*) AS sent, count(*) FILTER (kind <> 'signup') AS delivered FROM dup GROUP BY tenant)
            SELECT sum(sent)::BIGINT AS sent, sum(delivered)::BIGINT AS delivered, (sum(sent) - sum(delivered))::BIGINT AS lost,
                   (sum(sent) - sum(delivered))::DOUBLE * 100 / sum(sent)::DOUBLE AS loss_pct FROM t""",
)
def reconcile_totals(spark, sf_dir):
    totals = d.with_copies(d.signals(spark, sf_dir)).groupBy("tenant").agg(
        F.count(F.lit(1)).alias("sent"), F.count_if(F.col("kind") != "signup").alias("delivered")
    )
    return dedup.loss_by_totals(totals, "sent", "delivered").withColumn("loss_pct", F.col("loss_pct").cast("double"))


@query(
    "reconcile_lag", "O-DED-5",
    sql=f"""WITH {d.SIG}, o AS (SELECT tenant, vin, max(seq) AS high, max(seq) FILTER (kind = 'click') - 100 AS done FROM sig GROUP BY tenant, vin)
            SELECT tenant, sum(greatest(0, high - greatest(coalesce(done, 0), 0)))::BIGINT AS lag FROM o GROUP BY tenant""",
)
def reconcile_lag(spark, sf_dir):
    offsets = d.signals(spark, sf_dir).groupBy("tenant", "vin").agg(
        F.max("seq").alias("high"), (F.max(F.when(F.col("kind") == "click", F.col("seq"))) - 100).alias("done")
    )
    return dedup.consumer_lag(offsets, ["tenant"], "high", "done")


@query(
    "retention", "O-DED-6",
    sql=f"""WITH {d.SIG} SELECT vin, seq, CASE WHEN event_time >= {NOW_SQL} - INTERVAL 7 DAY THEN 'hot' ELSE 'warm' END AS tier
            FROM sig WHERE event_time >= {NOW_SQL} - INTERVAL 20 DAY""",
)
def retention(spark, sf_dir):
    kept = dedup.retain(d.signals(spark, sf_dir), "event_time", now(), 20)
    return dedup.storage_tier(kept, "event_time", now()).select("vin", "seq", "tier")


@query(
    "pipeline_counters", "O-AGG-14",
    sql=f"""WITH {d.SIG}, {d.COPIES}, {_GUARD_SQL} SELECT (SELECT count(*) FROM dup) AS received,
            (SELECT count(*) FROM (SELECT DISTINCT vin, seq FROM dup)) AS forwarded,
            (SELECT count(*) FROM dup) - (SELECT count(*) FROM (SELECT DISTINCT vin, seq FROM dup)) AS duplicates_dropped,
            (SELECT count(*) FROM dup) - (SELECT count(*) FROM ok) AS stale_dropped""",
)
def pipeline_counters(spark, sf_dir):
    """Counted per (vin, seq) first, so copies fold before the global sums."""
    rows = d.with_copies(d.signals(spark, sf_dir))
    seen = scan.running_max_before(rows.withColumn("_chunk", arrival_chunk()), ["vin", "msg_type"], "_chunk", arrival_order(), "seq", "seen")
    per_key = seen.groupBy("vin", "seq").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("seq") <= F.col("seen")).alias("stale")
    )
    return per_key.agg(
        F.sum("n").alias("received"), F.count(F.lit(1)).alias("forwarded"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicates_dropped"), F.sum("stale").alias("stale_dropped"),
    )


# --- tenancy, feeds, erasure, stored forms ------------------------------------------------------
@query("tenant_scope", "O-FLT-9", "O-SNK-12", sql=f"WITH {d.SIG} SELECT vin, seq, tenant FROM sig WHERE tenant = 't1'")
def tenant_scope(spark, sf_dir):
    return governance.tenant_view(d.signals(spark, sf_dir), "t1").select("vin", "seq", "tenant")


@query("tenant_none", "O-FLT-9", sql=f"WITH {d.SIG} SELECT vin, seq FROM sig WHERE false")
def tenant_none(spark, sf_dir):
    return governance.tenant_view(d.signals(spark, sf_dir), None).select("vin", "seq")


@query(
    "alert_feed", "O-TOP-8", "O-SNK-12",
    sql=f"""WITH {d.SIG}, r AS (SELECT tenant, vin, seq, event_time, row_number() OVER (PARTITION BY tenant ORDER BY event_time DESC, seq DESC) AS rn
            FROM sig WHERE kind = 'error') SELECT tenant, vin, seq, event_time FROM r WHERE rn <= 200""",
)
def alert_feed(spark, sf_dir):
    errors = d.signals(spark, sf_dir).filter("kind = 'error'").select("tenant", "vin", "seq", "event_time")
    return risk.newest_per_group(errors, "tenant", 200, [F.col("event_time").desc(), F.col("seq").desc()])


@query(
    "erase_driver", "O-DED-7",
    sql="""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '[erased]' ELSE c_name END AS full_name,
           CASE WHEN c_acctbal < 0 THEN '[erased]' ELSE c_mktsegment END AS phone FROM customer""",
)
def erase_driver(spark, sf_dir):
    people = d.table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name as full_name", "c_mktsegment as phone")
    asked = d.table(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey")
    return governance.pseudonymise(people, asked, "c_custkey", ("full_name", "phone"))


@query(
    "erase_archive", "O-DED-7",
    sql=f"WITH {d.SIG} SELECT seq, vin, vehicle_id FROM sig WHERE vehicle_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def erase_archive(spark, sf_dir):
    asked = d.table(spark, sf_dir, "customer").filter("c_acctbal < 0").selectExpr("c_custkey as vehicle_id")
    return governance.erase_archive(d.signals(spark, sf_dir), asked, "vehicle_id").select("seq", "vin", "vehicle_id")


@query(
    "erase_counts", "O-DED-7",
    sql=f"""WITH {d.SIG} SELECT c_custkey AS vehicle_id, count(seq) AS erased FROM customer LEFT JOIN sig ON vehicle_id = c_custkey
            WHERE c_acctbal < 0 GROUP BY c_custkey""",
)
def erase_counts(spark, sf_dir):
    asked = d.table(spark, sf_dir, "customer").filter("c_acctbal < 0").selectExpr("c_custkey as vehicle_id")
    return governance.erased_counts(d.signals(spark, sf_dir), asked, "vehicle_id")


@query(
    "array_text", "O-SNK-10",
    sql=f"""WITH {d.TEL} SELECT vin, seq, replace(replace(replace(CAST([kpa_1, kpa_2, kpa_3] AS VARCHAR), ' ', ''), '[', '{{'), ']', '}}') AS tire_kpa
            FROM tel WHERE msg_type = 'HEALTH'""",
)
def array_text(spark, sf_dir):
    health = d.telemetry(spark, sf_dir).filter("msg_type = 'HEALTH'")
    return health.select("vin", "seq", arrays.array_literal(F.col("tire_kpa")).alias("tire_kpa"))


@query(
    "lake_days", "O-SNK-1", "O-SNK-2",
    sql=f"WITH {d.SIG} SELECT strftime(event_time, '%Y-%m-%d') AS dt, msg_type, count(*) AS n FROM sig GROUP BY ALL",
)
def lake_days(spark, sf_dir):
    rows = d.signals(spark, sf_dir).withColumn("dt", F.date_format("event_time", "yyyy-MM-dd"))
    return rows.groupBy("dt", "msg_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "audit_trail", "O-MNT-8", "O-TOP-4",
    sql=f"""WITH {d.SIG} SELECT 'system' AS actor, kind AS action, vin AS resource, '{{"seq":' || seq || ',"k":' || k || '}}' AS details, event_time AS created_at
            FROM sig ORDER BY event_time DESC, seq DESC LIMIT 100""",
)
def audit_trail(spark, sf_dir):
    newest = risk.newest_rows(d.signals(spark, sf_dir), 100, [F.col("event_time").desc(), F.col("seq").desc()])
    return governance.audit_rows(newest, F.lit("system"), F.col("kind"), F.col("vin"), ["seq", "k"], F.col("event_time"))
