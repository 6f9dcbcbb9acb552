"""Streaming forms run over the whole events table with the file source, until no data is left."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from convoy.functions import codes
from convoy.operators import rules
from convoy.plans import derive as d
from convoy.plans import quality as pq
from convoy.plans import telemetry as t
from convoy.plans.registry import query
from convoy.session import ensure_checkpoint_dir
from convoy.sources import readers
from convoy.streaming import counters, pipeline, sinks, state
from convoy.streaming import operators as so

_STATE = "spark.sql.streaming.stateStore.providerClass"


def _stream(spark, sf_dir):
    """The events file as a stream; the derived columns are the same expressions as in batch."""
    schema = d.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _workdir(spark):
    return f"{ensure_checkpoint_dir(spark)}/streams-{uuid.uuid4().hex}"


def _finish(spark, query_, path):
    query_.awaitTermination()
    return spark.read.parquet(path)


def _run(spark, stream, name):
    work = _workdir(spark)
    spark.conf.set(_STATE, so.ROCKSDB)
    query_ = sinks.start_files(stream, f"{work}/{name}", f"{work}/_checkpoint", once=True)
    return _finish(spark, query_, f"{work}/{name}")


def _zoneless(df, column="detected_at"):
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


# a window or pair is final once the watermark (newest event minus five seconds, in ms) has passed it
_CLOSED = "(SELECT date_trunc('millisecond', max(event_time) - INTERVAL 5 SECOND) FROM sig)"


@query("stream_dedup", "O-DED-1", "O-STR-9", sql=f"WITH {d.SIG}, {d.COPIES} SELECT DISTINCT vin, seq, tenant, msg_type, event_time FROM dup")
def stream_dedup(spark, sf_dir):
    rows = d.with_copies_of(d.signals_of(_stream(spark, sf_dir)))
    timed = rows.withColumn("event_time", F.col("event_time").cast("timestamp")).filter("tenant IS NOT NULL AND event_time IS NOT NULL")
    first = so.drop_duplicates(timed, ["vin", "seq"]).select("vin", "seq", "tenant", "msg_type", "event_time")
    return _zoneless(_run(spark, first, "dedup"), "event_time")


@query("stream_hop", "O-STR-1", "O-STR-3", sql=f"WITH {d.TEL}, h AS ({t._HOPS_SQL}) SELECT * FROM h WHERE detected_at <= {_CLOSED}")
def stream_hop(spark, sf_dir):
    timed = so.with_event_time(d.telemetry_of(_stream(spark, sf_dir)))
    alerts = rules.sustained_alerts(timed, rules.SUSTAINED_RULES, window="12 hours", slide="2 hours")
    return t._flat(_zoneless(_run(spark, alerts, "hop")))


@query("stream_pairs", "O-STR-4", sql=f"WITH {d.TEL}, {t._RUNS_SQL} {t._PAIR_SQL} AND p % 2 = 0 AND event_time < {_CLOSED}")
def stream_pairs(spark, sf_dir):
    timed = so.with_event_time(d.telemetry_of(_stream(spark, sf_dir)))
    return t._flat(_zoneless(_run(spark, so.misfire_recurrence(timed, 24 * 3600), "pairs")))


@query("stream_rules", "O-FLT-2", "O-STR-10", sql=f"WITH {d.TEL} {t._THRESHOLD_SQL} UNION ALL {t._MISFIRE_SQL}")
def stream_rules(spark, sf_dir):
    timed = so.with_event_time(d.telemetry_of(_stream(spark, sf_dir)))
    return t._flat(_zoneless(_run(spark, rules.row_alerts(timed, rules.ROW_RULES), "rules")))


# --- fed in several micro-batches ----------------------------------------------------------------
PARTS = 5
_FILES = 2
_FILE_ROWS = 250_000


def _feed(rows, path, fmt="parquet", file_rows=_FILE_ROWS):
    """``rows`` as files that a stream meets in PARTS micro-batches of ascending ``arrival``; the schema of the files and how many
    make a micro-batch, more for more rows (as many in each part: no part may have fewer rows than fill them)."""
    rows.write.parquet(f"{path}-rows")  # derived once, not once per part
    rows = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}-rows")
    bounds = rows.agg(F.min("arrival").alias("low"), F.max("arrival").alias("high")).first()
    low, width = bounds["low"] or 0, ((bounds["high"] or 0) - (bounds["low"] or 0)) // PARTS + 1
    part = F.floor((F.col("arrival") - low) / F.lit(width))
    counts = [r["n"] for r in rows.filter("arrival IS NOT NULL").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()]
    least = min(counts) if len(counts) == PARTS else 0
    files = max(_FILES, min(-(-max(counts, default=0) // file_rows), least // rows.rdd.getNumPartitions()))
    for number in range(PARTS):
        start = low + number * width
        some = rows.filter((F.col("arrival") >= start) & (F.col("arrival") < start + width))
        some.repartition(files).write.mode("append").format(fmt).option("compression", "snappy").save(path)
    sinks.remove(rows.sparkSession, f"{path}-rows")
    return rows.schema, files


def _fed(spark, rows, path):
    schema, files = _feed(rows, path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


#: the micro-batch of a row, as _feed deals them
_PART = f"(arrival - (SELECT min(arrival) FROM dup)) // (((SELECT max(arrival) - min(arrival) FROM dup)) // {PARTS} + 1)"
_TWIN_FIELDS = [("coolant_c", "double"), ("charge_v", "double")]
_TWIN_SQL = """SELECT vin, arg_max(event_time, (arrival, seq)) AS updated_at, max(seq) FILTER (msg_type = 'FAST') AS last_seq_fast,
      arg_max(coolant_c, (arrival, seq)) FILTER (coolant_c IS NOT NULL) AS coolant_c, arg_max(charge_v, (arrival, seq)) FILTER (charge_v IS NOT NULL) AS charge_v
    FROM ok GROUP BY vin"""
_TEL_COPIES = "dup AS (SELECT * FROM tel UNION ALL BY NAME SELECT * REPLACE (arrival + 1000 AS arrival) FROM tel WHERE kind = 'click')"


def _twin_messages(spark, sf_dir):
    """Nested messages with stale ones (arrival is shuffled against seq) and a later copy of every click."""
    rows = d.with_copies(d.telemetry(spark, sf_dir))
    return rows.select("vin", "tenant", "msg_type", "seq", "event_time", "arrival", F.struct(*[n for n, _ in _TWIN_FIELDS]).alias("payload"))


@query("stream_twin", "O-STR-5", "O-SNK-5", "O-DED-3", sql=f"WITH {d.TEL}, {_TEL_COPIES}, {t._GUARD_SQL} {_TWIN_SQL}")
def stream_twin(spark, sf_dir):
    """Five micro-batches through keyed state; the view is folded after the run and read with the changes."""
    work = _workdir(spark)
    spark.conf.set(_STATE, so.ROCKSDB)
    changes = state.twin_changes(_fed(spark, _twin_messages(spark, sf_dir), f"{work}/in"), ["arrival", "seq"])
    sinks.start(changes, f"{work}/_checkpoint", state.store_changes(f"{work}/twin", _TWIN_FIELDS), once=True).awaitTermination()
    state.fold_changes(spark, f"{work}/twin")
    return _zoneless(state.current_twin(spark, f"{work}/twin").select("vin", "updated_at", "last_seq_fast", "coolant_c", "charge_v"), "updated_at")


class _Once:
    """A batch writer that fails after it wrote one of the batches, the first time."""

    def __init__(self, writer, number):
        self.writer, self.number, self.failed = writer, number, False

    def __call__(self, batch, number):
        self.writer(batch, number)
        if number == self.number and not self.failed:
            self.failed = True
            raise RuntimeError("stopped after the write")


@query("stream_restart", "O-STR-7", sql=f"""WITH {d.TEL}, {_TEL_COPIES}, {t._GUARD_SQL}, view AS ({_TWIN_SQL})
    SELECT view.*, n AS accepted FROM view JOIN (SELECT vin, count(*) AS n FROM ok GROUP BY vin) USING (vin)""")
def stream_restart(spark, sf_dir):
    """The query dies after a batch was written but before that was noted, and starts again from its checkpoint: the batch
    runs a second time, and every message still counts once, in the twin and in the archive."""
    work = _workdir(spark)
    spark.conf.set(_STATE, so.ROCKSDB)
    rows = _twin_messages(spark, sf_dir)
    stream = _fed(spark, rows, f"{work}/in")
    schema = "vin string, msg_type string, seq bigint"
    writer = _Once(state.store_changes(f"{work}/twin", _TWIN_FIELDS, f"{work}/archive", schema), 2)
    for attempt in range(2):
        changes = state.twin_changes(stream, ["arrival", "seq"], archive=True)
        running = sinks.start(changes, f"{work}/_checkpoint", writer, once=True)
        try:
            running.awaitTermination()
        except Exception:
            if attempt or not writer.failed:
                raise
    archived = spark.read.parquet(f"{work}/archive").groupBy("vin").agg(F.count("archived_at").alias("accepted"))
    view = state.current_twin(spark, f"{work}/twin").select("vin", "updated_at", "last_seq_fast", "coolant_c", "charge_v")
    return _zoneless(view.join(archived, "vin"), "updated_at")


_LIVE_TEL = f"""{d.TEL.replace('tel AS', 'tel0 AS', 1)}, tel1 AS (SELECT * REPLACE (date_trunc('millisecond', event_time) AS event_time, NULL::DOUBLE AS cell_temp_max_c)
    FROM tel0 WHERE {pq._REASON_SQL} IS NULL), tel AS (SELECT * FROM tel1 UNION ALL SELECT * FROM tel1 WHERE seq % 7 = 0)"""
_LIVE_CLOSED = "(SELECT max(event_time) - INTERVAL 5 SECOND FROM tel)"
_LIVE_ALERTS = f"""a AS ({t._THRESHOLD_SQL}
  UNION ALL SELECT {t._ALERT_SQL.format('misfire', "'P0300'")} FROM tel WHERE msg_type = 'HEALTH' AND k % 2 = 0
  UNION ALL {t._ELEMENT_SQL} UNION ALL SELECT * FROM ({t._HOPS_SQL}) WHERE detected_at <= {_LIVE_CLOSED}
  UNION ALL {t._PAIR_SQL} AND p % 2 = 0 AND event_time < {_LIVE_CLOSED})"""


def _vehicles_by_body(spark, sf_dir):
    """Known vehicles under the VINs that the raw messages carry."""
    body = F.expr(pq._BODY.format("c_custkey"))
    rows = d.table(spark, sf_dir, "customer").filter(t._KNOWN)
    return rows.select(codes.vin_repaired(body).alias("vin"), F.col("c_custkey").alias("vehicle_id"), F.concat(F.lit("owner-"), F.col("c_nationkey").cast("string")).alias("tenant"))


def _live(spark, sf_dir, work):
    """All events as JSON text, every seventh twice, through routing in PARTS micro-batches and the live layer; the paths and
    the counters."""
    raw = pq.raw_messages(spark, sf_dir).withColumn("_copy", F.explode(F.when(F.col("seq") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    raw = raw.select("topic", "value", F.col("seq").alias("arrival"))
    _, files = _feed(raw, f"{work}/raw", "json")
    _vehicles_by_body(spark, sf_dir).write.parquet(f"{work}/vehicles")
    paths, listener = pipeline.Paths(f"{work}/out"), counters.Counters()
    spark.streams.addListener(listener)
    try:
        messages = readers.message_stream(spark, f"{work}/raw", "topic string, value string, arrival long", maxFilesPerTrigger=str(files))
        listener.wait(pipeline.start_routing(messages, paths, pq.SHARDS, once=True))
        accepted = pipeline.accepted_stream(spark, paths)
        times = {"window": "12 hours", "slide": "2 hours", "within_seconds": 24 * 3600}
        for running in pipeline.start_pipeline(accepted, paths, f"{work}/vehicles", once=True, **times):
            listener.wait(running)
    finally:
        spark.streams.removeListener(listener)
    return paths, listener


@query("stream_live", "O-SRC-1", "O-STR-8", "O-SNK-7", "O-STR-10", "O-JOIN-6", sql=f"""WITH {_LIVE_TEL}, {t._RUNS_SQL}, {t._KNOWN_SQL}, {_LIVE_ALERTS}
    SELECT k.vehicle_id, k.tenant, failure_type, severity, source, dtc_codes, detected_at FROM a JOIN known k ON k.vin = a.vin""")
def stream_live(spark, sf_dir):
    """The stored, enriched alerts of all rules."""
    paths, _ = _live(spark, sf_dir, _workdir(spark))
    alerts = spark.read.parquet(paths.data("alerts"))
    return t._flat(_zoneless(alerts.select("vehicle_id", "tenant", "failure_type", "severity", "source", "dtc_codes", "detected_at")))


@query("stream_counters", "O-AGG-14", "O-STR-6", "O-SNK-1", "O-SNK-2", "O-SNK-4", "O-SNK-6", sql=f"""WITH {_LIVE_TEL}, {t._RUNS_SQL}, {t._KNOWN_SQL}, {_LIVE_ALERTS}
    SELECT * FROM (VALUES
      ('dead_letters', (SELECT count(*) + count(*) FILTER (seq % 7 = 0) FROM tel0) - (SELECT count(*) FROM tel)),
      ('store.received', (SELECT count(*) FROM tel)), ('kept.unique', (SELECT count(*) FROM tel1)),
      ('twin.accepted', (SELECT count(*) FROM tel1)), ('twin.stale', (SELECT count(*) FROM tel1 WHERE seq % 7 = 0)), ('late', 0), ('alerts.raised', (SELECT count(*) FROM a)),
      ('unknown_alerts', (SELECT count(*) FROM a WHERE vin NOT IN (SELECT vin FROM known))), ('fast_rows', (SELECT count(*) FROM tel1 WHERE msg_type = 'FAST')),
      ('health_rows', (SELECT count(*) FROM tel1 WHERE msg_type = 'HEALTH')), ('lake_rows', (SELECT count(*) FROM tel1)), ('archived', (SELECT count(*) FROM tel1))) v(counter, rows)""")
def stream_counters(spark, sf_dir):
    """What the queries report by themselves, beside what they stored."""
    paths, listener = _live(spark, sf_dir, _workdir(spark))
    stored = {"fast_rows": "telemetry_fast", "health_rows": "telemetry_health", "lake_rows": "lake", "archived": "archive", "dead_letters": "dead_letters"}
    out = listener.table(spark)
    for name, table in stored.items():
        out = out.union(spark.read.parquet(paths.data(table)).agg(F.lit(name), F.count(F.lit(1))))
    return out.union(spark.read.parquet(paths.data("unknown_vins")).agg(F.lit("unknown_alerts"), F.coalesce(F.sum("alerts"), F.lit(0))))


_LATE_SQL = f"""dealt AS (SELECT *, {_PART} AS part FROM dup),
  marks AS (SELECT part, max(event_time) AS newest FROM dealt WHERE tenant IS NOT NULL GROUP BY part),
  judged AS (SELECT d.*, (SELECT date_trunc('millisecond', max(newest) - INTERVAL 1 HOUR) FROM marks m WHERE m.part < d.part - 1) AS mark FROM dealt d)"""


@query("stream_late", "O-STR-6", "O-STR-9", sql=f"""WITH {d.SIG}, {d.COPIES}, {_LATE_SQL}
    SELECT vin, seq, false AS dropped FROM (SELECT DISTINCT vin, seq FROM judged WHERE mark IS NULL OR event_time > mark)
    UNION ALL SELECT 'late rows', count(*), true FROM judged WHERE event_time <= mark""")
def stream_late(spark, sf_dir):
    """Dedup over five micro-batches in which copies and shuffled rows arrive behind the watermark: those are dropped and counted."""
    work = _workdir(spark)
    spark.conf.set(_STATE, so.ROCKSDB)
    listener = counters.Counters()
    spark.streams.addListener(listener)
    try:
        stream = _fed(spark, d.with_copies(d.signals(spark, sf_dir)).select("vin", "seq", F.col("event_time").cast("timestamp").alias("event_time"), "arrival"), f"{work}/in")
        listener.wait(sinks.start_files(so.drop_duplicates(stream, ["vin", "seq"]), f"{work}/out", f"{work}/_checkpoint", once=True))
    finally:
        spark.streams.removeListener(listener)
    kept = spark.read.parquet(f"{work}/out").select("vin", "seq", F.lit(False).alias("dropped"))
    return kept.union(spark.createDataFrame([("late rows", listener.totals()["late"], True)], kept.schema))
